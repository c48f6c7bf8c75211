"""Chat formatting by a small template language, compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% set %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% for x in y %}`` and ``{% generation %}``
blocks; an expression has literals, names, ``.field``, ``[key]``, filters,
``~ + - * == != < <= > >= in not and or``. Nothing else exists: no calls, no
attribute access to Python objects and no loops without a finite source.

``parse`` gives a syntax tree, ``fold`` replaces what does not depend on the
input by its value and joins neighbouring texts, and ``compile_template`` turns
each node into a closure. Closures yield pieces, and loops read their source as
a stream with one message of look-ahead, so a conversation of any length is
rendered in constant memory.

``escape`` puts a backslash into every control string inside a message and
doubles backslashes; ``unescape`` undoes it, so what was said can be read back.

Conversations are the rows of one ``conv_id`` in order of ``turn``, null first;
rows of the same turn come in order of role and text. Null texts and roles are
empty. A null ``conv_id`` is a conversation as well. Repeated rows are turns of
their own. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning of their own in the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]")

#: Users and assistants have marks of their own; any other role is named.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}[OUT]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[END]"
    "{% endif %}{% endfor %}"
)


def _check_control(control: tuple[str, ...]) -> None:
    if any(len(c) < 2 or "\\" in c for c in control):
        raise ValueError("a control string has two characters or more and no backslash")


@lru_cache(maxsize=8)
def _control_start(control: tuple[str, ...]) -> re.Pattern:
    _check_control(control)
    return re.compile(r"(\\)|(.)(?=" + "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in control) + ")", re.S)


def escape(text: str, control: tuple[str, ...] = CONTROL) -> str:
    """No control string is left whole: each gets a backslash behind its first character."""
    return _control_start(control).sub(lambda m: "\\\\" if m[1] else m[2] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# --- syntax tree -----------------------------------------------------------


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    base: object
    key: object


@dataclass(frozen=True)
class Filter:
    base: object
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    source: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template is not in the language."""


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|[-+*~<>|.()\[\]]))\s*",
    re.S,
)
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~", "+", "-"), ("*",))
_WORDS = {"or", "and", "not", "in"}
_NAMED = {"true": True, "false": False, "none": None}
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class _Expressions:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            kind = m.lastgroup or ""
            self.tokens.append(("op" if m[kind] in _WORDS else kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TemplateError(f"expected {op!r}, found {self.peek()[1]!r}")

    def whole(self) -> object:
        found = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    def level(self, n: int) -> object:
        if n == len(_LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while op := self.take(*_LEVELS[n]):
            left = Binary(op, left, self.level(n + 1))
        return left

    def unary(self) -> object:
        if self.take("not"):
            return Unary("not", self.level(2))
        if self.take("-"):
            return Unary("-", self.unary())
        return self.postfix()

    def postfix(self) -> object:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            found: object = Const(int(value))
        elif kind == "text":
            found = Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "name":
            found = Const(_NAMED[value]) if value in _NAMED else Name(value)
        elif (kind, value) == ("op", "("):
            found = self.level(0)
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "[", "|"):
            if op == "[":
                found = Item(found, self.level(0))
                self.need("]")
                continue
            kind, value = self.peek()
            if kind != "name":
                raise TemplateError(f"a name has to follow {op!r}")
            self.at += 1
            if op == "|" and value not in FILTERS:
                raise TemplateError(f"no filter {value!r}")
            found = Filter(found, value) if op == "|" else Item(found, Const(value))
        return found


def _parts(source: str) -> Iterator[tuple[str, str]]:
    at = 0
    for m in _PART.finditer(source):
        if m.start() > at:
            yield "text", source[at : m.start()]
        if m[1] is not None:
            yield "output", m[1]
        elif m[2] is not None:
            yield "tag", m[2].strip()
        at = m.end()
    if at < len(source):
        yield "text", source[at:]


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    parts = list(_parts(source))
    body, at, _ = _block(parts, 0, ())
    if at != len(parts):
        raise TemplateError("a block ends that was not begun")
    return body


def _block(parts: list, at: int, until: tuple[str, ...]) -> tuple[tuple, int, str]:
    nodes: list[object] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            nodes.append(Text(value))
            continue
        if kind == "output":
            nodes.append(Output(_Expressions(value).whole()))
            continue
        word, _, rest = value.partition(" ")
        if word in until:
            return tuple(nodes), at, value
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, re.S)
            if not m:
                raise TemplateError("set needs a name, = and a value")
            nodes.append(Assign(m[1], _Expressions(m[2]).whole()))
        elif word == "if":
            arms, condition = [], _Expressions(rest).whole()
            while True:
                body, at, end = _block(parts, at, ("elif", "else", "endif"))
                arms.append((condition, body))
                end, _, rest = end.partition(" ")
                if end == "endif":
                    break
                condition = _Expressions(rest).whole() if end == "elif" else Const(True)
            nodes.append(If(tuple(arms)))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError("for needs a name, in and a source")
            body, at, _ = _block(parts, at, ("endfor",))
            nodes.append(For(m[1], _Expressions(m[2]).whole(), body))
        elif word == "generation":
            body, at, _ = _block(parts, at, ("endgeneration",))
            nodes.append(Generation(body))
        else:
            raise TemplateError(f"no tag {word!r}")
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(nodes), at, ""


# --- folding ---------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
}

_OPERATIONS: dict[str, Callable[[object, object], object]] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _text(a) + _text(b),
    "+": operator.add,
    "-": operator.sub,
    "*": operator.mul,
}


def _item(base: object, key: object) -> object:
    """Fields of mappings and places of lists and texts; anything else, and what is missing, is none."""
    if isinstance(base, dict):
        return base.get(key)
    if isinstance(base, (list, tuple, str)) and isinstance(key, int) and -len(base) <= key < len(base):
        return base[key]
    return None


def _fold_value(node: object) -> object:
    if isinstance(node, Item):
        node = Item(_fold_value(node.base), _fold_value(node.key))
        known = isinstance(node.base, Const) and isinstance(node.key, Const)
    elif isinstance(node, Filter):
        node = Filter(_fold_value(node.base), node.name)
        known = isinstance(node.base, Const)
    elif isinstance(node, Unary):
        node = Unary(node.op, _fold_value(node.value))
        known = isinstance(node.value, Const)
    elif isinstance(node, Binary):
        node = Binary(node.op, _fold_value(node.left), _fold_value(node.right))
        known = isinstance(node.left, Const) and isinstance(node.right, Const)
        if isinstance(node.left, Const) and node.op in ("and", "or"):
            return node.right if bool(node.left.value) == (node.op == "and") else node.left
    else:
        return node
    return Const(_value(node)({})) if known else node


def fold(nodes: tuple) -> tuple:
    """Constants are computed, dead arms dropped, and neighbouring texts joined."""
    out: list[object] = []
    for node in nodes:
        if isinstance(node, Output):
            value = _fold_value(node.value)
            node = Text(_text(value.value)) if isinstance(value, Const) else Output(value)
        elif isinstance(node, Assign):
            node = Assign(node.name, _fold_value(node.value))
        elif isinstance(node, For):
            node = For(node.name, _fold_value(node.source), fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, If):
            arms = []
            for condition, body in node.arms:
                condition = _fold_value(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, fold(body)))
                if isinstance(condition, Const):
                    break
            if not arms:
                continue
            if isinstance(arms[0][0], Const):
                out.extend(arms[0][1])
                continue
            node = If(tuple(arms))
        if isinstance(node, Text) and not node.value:
            continue
        out.append(node)
    joined: list[object] = []
    for node in out:
        if isinstance(node, Text) and joined and isinstance(joined[-1], Text):
            joined[-1] = Text(joined[-1].value + node.value)
        else:
            joined.append(node)
    return tuple(joined)


# --- closures --------------------------------------------------------------

Scope = dict
#: A text and whether it is generated by the model; ``TURN`` ends what one pass of the outermost loop gave.
Piece = tuple[str, bool]


def _value(node: object) -> Callable[[Scope], object]:
    if isinstance(node, Const):
        return lambda s, v=node.value: v
    if isinstance(node, Name):
        return lambda s, n=node.name: s.get(n)
    if isinstance(node, Item):
        base, key = _value(node.base), _value(node.key)
        return lambda s: _item(base(s), key(s))
    if isinstance(node, Filter):
        base, run = _value(node.base), FILTERS[node.name]
        return lambda s: run(base(s))
    if isinstance(node, Unary):
        value = _value(node.value)
        return (lambda s: not value(s)) if node.op == "not" else (lambda s: -value(s))
    left, right = _value(node.left), _value(node.right)
    if node.op == "and":
        return lambda s: left(s) and right(s)
    if node.op == "or":
        return lambda s: left(s) or right(s)
    run = _OPERATIONS[node.op]
    return lambda s: run(left(s), right(s))


@dataclass
class _Loop:
    """Passes over a source with one item of look-ahead."""

    source: Iterable
    index: int = -1
    before: object = None
    fields: dict = field(default_factory=dict)

    def __iter__(self) -> Iterator[object]:
        items = iter(self.source or ())
        end = object()
        item = next(items, end)
        while item is not end:
            after = next(items, end)
            self.index += 1
            self.fields.update(
                index0=self.index,
                index=self.index + 1,
                first=self.index == 0,
                last=after is end,
                previtem=self.before,
                nextitem=None if after is end else after,
            )
            yield item
            self.before, item = item, after


Run = Callable[[Scope, bool], Iterator[Piece]]
#: Stands between the passes of the outermost loop.
TURN: Piece = ("", False)


def _node(node: object, depth: int) -> Run:
    if isinstance(node, Text):

        def text(scope: Scope, generated: bool, value: str = node.value) -> Iterator[Piece]:
            yield value, generated

        return text
    if isinstance(node, Output):
        value = _value(node.value)

        def output(scope: Scope, generated: bool) -> Iterator[Piece]:
            yield _text(value(scope)), generated

        return output
    if isinstance(node, Assign):
        value = _value(node.value)

        def assign(scope: Scope, generated: bool) -> Iterator[Piece]:
            scope[node.name] = value(scope)
            yield from ()

        return assign
    if isinstance(node, If):
        arms = [(_value(c), _body(b, depth)) for c, b in node.arms]

        def branch(scope: Scope, generated: bool) -> Iterator[Piece]:
            for condition, body in arms:
                if condition(scope):
                    yield from body(scope, generated)
                    return

        return branch
    if isinstance(node, For):
        source, body = _value(node.source), _body(node.body, depth + 1)

        def repeat(scope: Scope, generated: bool) -> Iterator[Piece]:
            loop = _Loop(source(scope))
            for item in loop:
                yield from body(scope | {node.name: item, "loop": loop.fields}, generated)
                if depth == 0:
                    yield TURN

        return repeat
    body = _body(node.body, depth)
    return lambda scope, generated: body(scope, True)


def _body(nodes: tuple, depth: int) -> Run:
    runs = [_node(n, depth) for n in nodes]

    def block(scope: Scope, generated: bool) -> Iterator[Piece]:
        for run in runs:
            yield from run(scope, generated)

    return block


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A closure from a stream of messages to pieces; ``TURN`` itself follows each pass of the outer loop."""
    run = _body(fold(parse(source)), 0)
    return lambda messages: run({"messages": messages}, False)


# --- conversations in Spark ------------------------------------------------

_OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("seq", pa.int64()),
        ("formatted", pa.string()),
        ("generated", pa.list_(pa.list_(pa.int64()))),
    ]
)
FORMATTED = "conv_id long, seq long, formatted string, generated array<array<long>>"


def by_key(batches: Iterator[pa.RecordBatch], key: str = "conv_id") -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows that come in order of a key, as one stream for each key."""
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    yield from groupby(rows, key=lambda row: row[key])


def _spans(pieces: list[Piece]) -> tuple[str, list[list[int]]]:
    out, spans, at = [], [], 0
    for text, generated in pieces:
        if generated and text:
            if spans and spans[-1][1] == at:
                spans[-1][1] = at + len(text)
            else:
                spans.append([at, at + len(text)])
        out.append(text)
        at += len(text)
    return "".join(out), spans


def _in_rows(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, seq, formatted, generated``: a row for each pass of the template's outer loop.

    The rows of a conversation in order of ``seq``, put together, are its text;
    ``generated`` has the [start, end) code points in the row that a model is
    trained on. What a template gives after its loop is a row of its own.
    A conversation passes through one task as a stream, whatever its length.
    """
    parse(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def rows() -> Iterator[dict]:
            for conv_id, messages in by_key(batches):
                held: list[Piece] = []
                seq = 0
                for piece in render(messages):
                    if piece is not TURN:
                        held.append(piece)
                        continue
                    text, spans = _spans(held)
                    yield {"conv_id": conv_id, "seq": seq, "formatted": text, "generated": spans}
                    held, seq = [], seq + 1
                if held:
                    text, spans = _spans(held)
                    yield {"conv_id": conv_id, "seq": seq, "formatted": text, "generated": spans}

        yield from _in_rows(rows(), _OUT)

    ordered = (
        turns.select(
            F.col("conv_id").cast("long"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(run, FORMATTED)


_MARK = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of the turns in a text that the default template made."""
    turns, at = [], 0
    marks = [(m[0], m.start(), m.end()) for m in _MARK.finditer(formatted)]

    def between(i: int) -> str:
        return unescape(formatted[marks[i][2] : marks[i + 1][1]])

    while at < len(marks):
        mark = marks[at][0]
        if mark == "<s>":
            at += 1
        elif mark == "[INST]":
            turns.append(("user", between(at)))
            at += 2
        elif mark == "[OUT]":
            turns.append(("assistant", between(at)))
            at += 2
        elif mark == "[ROLE]":
            turns.append((between(at), between(at + 1)))
            at += 3
        else:
            raise ValueError(f"{mark} is out of place")
    return turns


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of conversations that were formatted with the default template, read from the output alone.

    ``in_order`` is for rows that come straight from ``format_conversations``
    and need no second shuffle; stored rows are brought together and sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv_id, parts in by_key(batches):
                n_turns = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    text = part["formatted"]
                    chars += len(text)
                    for role, said in read_turns(text):
                        n_turns += 1
                        turns.update(_bytes(f"{role}\n{said}\n"))
                    for start, end in part["generated"]:
                        said = unescape(text[start:end])
                        loss_chars += len(said)
                        loss.update(_bytes(said))
                yield {
                    "conv_id": conv_id,
                    "n_turns": n_turns,
                    "turns_sha256": turns.hexdigest(),
                    "loss_chars": loss_chars,
                    "loss_sha256": loss.hexdigest(),
                    "formatted_chars": chars,
                }

        yield from _in_rows(rows(), _DIGESTS)

    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return formatted.mapInArrow(run, DIGESTS)
