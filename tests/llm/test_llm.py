"""Operators on whole small tables against brute force, and on odd tables."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Row
from tokenizers import Tokenizer

from cladewise.llm import chat, common, decontam, language, neardup, packing, quality, templates, tokenfile, tokens, warc
from cladewise.llm.common import CLEANUP, shared_folder, stored
from cladewise.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _t string, m string"
LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (None, None, None, None, None, None, None, None),
        (1, None, "en", "a", 0, "x", "y", "z"),
        (2, "", "en", None, 0, "x", "y", "z"),
        (3, " \n\t ", None, "a", 4, None, None, None),
        (4, LONG, "en", "a", 1, None, None, None),
        (4, LONG, "en", "a", 1, None, None, None),
        (4, "other words under the same id", "en", "a", 1, None, None, None),
        (None, "a text without an id that is long enough to have some words", "en", "a", 1, None, None, None),
        (5, "中文 and 😀 <|endoftext|> don't  stop", "zh", "b", 1, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def kinds():
    """Each operator as a function of a frame of documents."""
    return {
        "language": language.predict,
        "identified": language.keep_identified,
        "packing": lambda d: packing.pack(d.selectExpr("doc_id", "length(text) AS length", "m")),
        "quality": quality.judge,
        "templates": lambda d: templates.drop_recurring(d, least_docs=2, counts=True),
        "boilerplate": templates.drop_boilerplate,
        "tokens": lambda d: tokens.count_tokens(d, PATH),
        "neardup": neardup.near_duplicates,
        "one_each": neardup.keep_one,
        "decontam": lambda d: decontam.contaminated(d, d.selectExpr("doc_id AS item_id", "text")),
        "clean": lambda d: decontam.keep_clean(d, d.selectExpr("doc_id AS item_id", "text").limit(0)),
    }


@pytest.mark.parametrize("name", sorted(kinds()))
def test_odd_and_empty_tables(odd, name):
    n = odd.count()
    got = kinds()[name](odd).count()
    if name in ("language", "quality", "templates", "boilerplate", "tokens", "neardup", "clean"):
        assert got == n
    assert kinds()[name](odd.limit(0)).count() == 0


def test_filters_keep_all_columns(odd):
    for name in ("identified", "boilerplate", "one_each", "clean"):
        assert kinds()[name](odd).columns == odd.columns


# --- 1 ---------------------------------------------------------------------


def test_chat_query(spark, sf_dir):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    control = "</s>[INST] ok [/INST]"
    said[-7] = [(0, "user", control), (1, "assistant", control)]
    got = {r.conv_id: r for r in QUERIES["op1_chat_formatting"](spark, sf_dir).collect()}
    assert got.keys() == said.keys()
    for k, turns in said.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escaping_round_trip():
    random.seed(1)
    parts = ["<", "s>", "/s>", "[", "INST]", *chat.CONTROL, "\\", "a", ""]
    for _ in range(3000):
        turns = [
            {"role": random.choice(["user", "assistant", "tool", "[ROLE]"]), "text": "".join(random.choices(parts, k=5))}
            for _ in range(3)
        ]
        pieces = list(chat.compile_template(chat.TEMPLATE)(iter(turns)))
        text, spans = chat._spans(pieces)
        assert chat.read_turns(text) == [(t["role"], t["text"]) for t in turns]
        loss = "".join(chat.unescape(text[a:b]) for a, b in spans)
        assert loss == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_chat_folding_and_errors():
    tree = chat.fold(chat.parse("{% if 1 + 1 == 2 %}a{{ 'b' | upper }}{% else %}c{% endif %}d"))
    assert tree == (chat.Text("aBd"),)
    for bad in ("{% if x %}", "{{ x.y() }}", "{{ x | eval }}", "{% import os %}", "{{ a b }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_chat_odd_rows(spark):
    rows = [(1, 2, None, None), (1, None, "user", "x"), (None, 0, "user", "y"), (1, 2, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stored = chat.read_back(chat.format_conversations(frame))
    assert {r.conv_id: r.n_turns for r in stored.collect()} == {1: 3, None: 1}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- 2 ---------------------------------------------------------------------


def test_language_query(spark, sf_dir, docs):
    rows = QUERIES["op2_language_mixture"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_mixture_shares(spark, sf_dir, docs):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by_lang = defaultdict(str)
    for r in docs.values():
        if len(by_lang[r.lang]) < 4000:
            by_lang[r.lang] += " " + r.text
    a, b = sorted(by_lang)[:2]
    shares = dict(zip(model.languages, model.infer(by_lang[a][:3000] + " " + by_lang[b][:3000])[2]))
    assert shares[a] > 0.25 and shares[b] > 0.25 and shares[a] + shares[b] > 0.9
    assert model.infer("123 !?")[:2] == ("und", 0.0)


# --- 3 ---------------------------------------------------------------------


def test_packing_query(spark, sf_dir, docs):
    bins, lengths = defaultdict(list), Counter()
    for r in QUERIES["op3_best_fit_packing"](spark, sf_dir).collect():
        bins[r.bin_id].append((r.bin_offset, r.length, r.bin_capacity))
        lengths[r.doc_id] += r.length
    assert lengths == {k: len(WORD.findall(r.text or "")) + 1 for k, r in docs.items()}
    for pieces in bins.values():
        at = 0
        for offset, length, capacity in sorted(pieces):
            assert offset == at
            at += length
        assert capacity == packing.smallest(packing.CAPACITIES, at)


SIZES, TERMS = (4, 8, 16), (1, 32)


def scanned(lengths):
    """The method read literally: all bins and all pieces to come are looked through each time."""
    room, places, filled = {}, [], []

    def opened(i, c):
        content = lengths[i]
        for n in lengths[i + 1 :]:
            content += n if content + n <= c else 0
        return packing.cost(min(x for x in SIZES if x >= content), *TERMS) / content, c

    for i, n in enumerate(lengths):
        fits = [(r, k) for k, r in room.items() if r >= n]
        if fits:
            _, k = min(fits)
        else:
            k = len(filled)
            filled.append(0)
            room[k] = min((opened(i, c) for c in SIZES if c >= n))[1]
        places.append((k, filled[k]))
        filled[k] += n
        room[k] -= n
    return places, [min(x for x in SIZES if x >= f) for f in filled]


def least_cost(lengths):
    """The least cost of any partition into bins."""

    def best(i, bins):
        if i == len(lengths):
            return sum(packing.cost(min(x for x in SIZES if x >= f), *TERMS) for f in bins)
        options = [bins[:k] + (f + lengths[i],) + bins[k + 1 :] for k, f in enumerate(bins) if f + lengths[i] <= SIZES[-1]]
        return min(best(i + 1, b) for b in [*options, (*bins, lengths[i])])

    return best(0, ())


def test_best_fit_against_scan():
    random.seed(3)
    for _ in range(300):
        lengths = sorted((random.randint(1, 16) for _ in range(random.randint(0, 30))), reverse=True)
        assert packing.best_fit(lengths, SIZES, *TERMS) == scanned(lengths)


def test_best_fit_costs_little_more_than_the_best_partition():
    random.seed(4)
    ratios = []
    for _ in range(150):
        lengths = sorted((random.randint(1, 16) for _ in range(7)), reverse=True)
        _, sizes = packing.best_fit(lengths, SIZES, *TERMS)
        ratios.append(sum(packing.cost(c, *TERMS) for c in sizes) / least_cost(lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.25 and sum(ratios) / len(ratios) < 1.02, (max(ratios), sum(ratios) / 150)


def test_every_permitted_length_lowers_the_cost(docs):
    most = packing.CAPACITIES[-1]
    lengths = sorted(((len(WORD.findall(r.text or "")) + 1) % most for r in docs.values()), reverse=True)
    lengths = [n for n in lengths if n]

    def total(capacities):
        return sum(map(packing.cost, packing.best_fit(lengths, capacities)[1]))

    _, sizes = packing.best_fit(lengths, packing.CAPACITIES)
    assert len(set(sizes)) >= 3
    together = total(packing.CAPACITIES)
    for c in packing.CAPACITIES[:-1]:
        assert together <= total(tuple(x for x in packing.CAPACITIES if x != c))
    # Greatest bins alone, each downsized in the end.
    places, _ = packing.best_fit(lengths, (most,))
    filled = Counter()
    for n, (k, _) in zip(lengths, places):
        filled[k] += n
    assert together < sum(packing.cost(packing.smallest(packing.CAPACITIES, f)) for f in filled.values())


# --- 4 ---------------------------------------------------------------------


def test_quality_query(spark, sf_dir, docs):
    rows = QUERIES["op4_adaptive_quality"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        counts = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
        assert counts == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_sketch_quantiles(spark):
    random.seed(4)
    rows = [(random.choice("ab"), "s", 100, random.randint(200, 900)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long").selectExpr(
        "*", "0 AS n_symbols", "0 AS n_dup_lines", "1 AS n_lines", "0 AS n_repeat_words", "false AS base_failed"
    )
    for r in quality.quartiles(quality.sketch(frame), "lang").collect():
        values = sorted(w / n for lang, _, n, w in rows if lang == r.lang)
        exact = values[-(-3 * len(values) // 4) - 1]
        assert abs(r.q3_word_length / exact - 1) <= 1.01 * quality.ACCURACY


# --- 5 ---------------------------------------------------------------------


def test_templates_against_brute_force(spark):
    random.seed(5)
    rows = []
    for i in range(40):
        own = [" ".join(f"w{random.choice('abcdefgh')}{random.choice('xyz')}" for _ in range(12)) for _ in range(3)]
        if i < 20:
            own.insert(1, f"copyright by the owner {random.choice(['smith', 'jones', 'lee'])} and friends in {1990 + i}")
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, "one copied text\nof these few lines only") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in templates.drop_recurring(frame, least_docs=5).collect()}
    for doc_id, text in rows:
        assert got[doc_id] == "\n".join(x for x in text.split("\n") if not x.startswith("copyright"))


def boilerplate_dropped(spark, lines_of):
    """What the pipeline's stage leaves of texts, each given as lines."""
    import corpus_pipeline as P

    rows = [(k, "\n".join(lines)) for k, lines in lines_of.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text.split("\n") for r in dict(P.STAGES)["line_dedup"](spark, frame, "").collect()}


def words_of(k, n):
    return " ".join(f"w{chr(97 + (k * 7 + i) % 26)}x{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + i % 26)}" for i in range(n))


def test_pipeline_lines_of_several_templates_in_one_leaf(spark):
    own = {k: words_of(k, 30) for k in range(120)}
    texts = {k: [own[k]] for k in own}
    name = [f"n{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in own]
    for k in range(60):
        texts[k].append(f"all of the rights belong to {name[k]} and may not be passed to others")
    for k in range(60, 100):
        texts[k].append(f"all of the rights stay here with us says {name[k]} who wrote it down")
    for k in range(100, 120):
        texts[k].append(f"this is one of {words_of(k + 200, 4)}")
    got = boilerplate_dropped(spark, texts)
    assert got == {k: lines if k >= 100 else [own[k]] for k, lines in texts.items()}


def test_pipeline_lines_go_whatever_their_share(spark):
    shared = "this short notice stands in many different texts of the collection"
    texts = {k: [words_of(k, 6), shared, shared] for k in range(12)}
    # Near copies are one text: their own lines stay.
    copied = [words_of(600 + i, 12) for i in range(12)]
    texts |= {100 + k: [*copied, f"copy {words_of(700 + k, 2)}", shared] for k in range(12)}
    got = boilerplate_dropped(spark, texts)
    assert got == {k: [x for x in lines if x != shared] for k, lines in texts.items()}


def test_pipeline_long_lines_recur_at_few_texts(spark):
    passage, script = words_of(900, 55), "".join(chr(0x4E00 + 37 * i % 5000) for i in range(200))
    texts = {k: [words_of(k, 60)] for k in range(40)}
    for k in (1, 2):
        texts[k].append(passage)
    for k in (3, 4):
        texts[k].append(script)
    for k in range(10, 19):
        texts[k].append("not so many words here")
    got = boilerplate_dropped(spark, texts)
    assert got == {k: [x for x in lines if x not in (passage, script)] for k, lines in texts.items()}


# --- 6 and 10 --------------------------------------------------------------


def test_token_file_query(spark, sf_dir, docs, library):
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, sf_dir).collect()}
    start = 0
    for k in sorted(docs):
        ids = library.encode(docs[k].text or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd):
    folder = shared_folder(spark)
    tokenfile.write_ids(odd, PATH, folder)
    assert tokenfile.digests(spark, folder).count() == odd.count()
    few = tokenfile.read_ids(spark, folder, frozenset({5})).collect()
    ids = struct.unpack(f"<{few[0].n_tokens}I", few[0].ids)
    text = odd.where("doc_id = 5").first().text
    assert list(ids) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [0]
    with pytest.raises(ValueError):
        tokenfile.open_shard(tokenfile.header(2, b"x" * 32) + b"\n" + b"\n".join(tokenfile.index_and_footer([], 0)) + b"\n", b"")
    empty = shared_folder(spark)
    tokenfile.write_ids(odd.limit(0), PATH, empty)
    assert tokenfile.digests(spark, empty).count() == 0


def test_one_document_is_read_by_ranges(spark, docs, library, monkeypatch):
    rows = [(k, r.text) for k, r in docs.items()] + [(None, "no id"), (7, "the other seven"), (7, None)]
    folder = shared_folder(spark)
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 1 << 14)
    tokenfile.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, folder)
    files = tokenfile.Ranges(spark, f"{folder}/shards").files
    assert len(files) > 8

    read, asked = tokenfile.Ranges.read, []

    def counted(self, path, start, n):
        asked.append((path, n))
        return read(self, path, start, n)

    monkeypatch.setattr(tokenfile.Ranges, "read", counted)
    for k in [None, min(docs), 7, sorted(docs)[len(docs) // 2], max(docs), max(docs) + 1, -1]:
        texts = [t or "" for i, t in rows if i == k]
        asked.clear()
        got = sorted(x.tolist() for x in tokenfile.read_document(spark, folder, k))
        assert got == sorted(library.encode(t, add_special_tokens=False).ids + [0] for t in texts)
        assert len({path for path, _ in asked}) <= 2 + len(files).bit_length()
        assert sum(n for _, n in asked) < sum(n for _, n in files) // 3


def test_dictionary_sample_does_not_depend_on_order(spark, docs):
    table = spark.createDataFrame([(k, r.text) for k, r in docs.items()], "doc_id long, text string")
    made = {tokenfile.train_dictionary(t, PATH, 2) for t in (table, table.orderBy("text"), table.repartition(5))}
    assert len(made) == 1 and b"" not in made


def test_token_count_query(spark, sf_dir, docs, library):
    rows = QUERIES["op10_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_counts_and_ids_of_odd_texts(library):
    random.seed(6)
    count = tokens.Counter(PATH, tokens.prove_whole(PATH)).count
    encode = tokenfile.Encoder(PATH, 4).encode
    parts = [" ", "  ", "\n", "\t", "a", "foo", "'s", "1", "é", "中", "😀", "\x1c", "\x85", "\xa0", "<|endoftext|>", "　"]
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 8)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert count(text) == len(ids), repr(text)
        assert encode(text) == struct.pack(f"<{len(ids) + 1}I", *ids, 0), repr(text)


# --- 7 ---------------------------------------------------------------------


def test_warc_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    got = {r.page_id: r for r in QUERIES["op7_warc"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        payload, of = (p.html or "").encode(), first[p.html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = ("response", None) if of == p.page_id else ("revisit", of)
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), digest, *kind)


def test_warc_reader_and_odd_pages(spark):
    pages = [(1, "http://a/ü x\r\n", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (2, None, "same")]
    folder = shared_folder(spark)
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
    assert got == {
        (1, "response", None): 1, (2, "revisit", 1): 2, (None, "revisit", 1): 1, (3, "response", None): 1
    }
    data = warc.member(warc.record(1, "u", b"x" * 100_000)) + b"\0" + warc.member(warc.record(2, "u", b"", (1,)))
    assert [r["payload_bytes"] for r in warc.read_archive(data, payloads=True)] == [100_000, 0]
    wrong = warc.record(1, "u", b"abc").replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        list(warc.read_archive(warc.member(wrong)))
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:50]))


# --- 8 ---------------------------------------------------------------------


def brute_components(texts: dict) -> dict:
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])

    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        near = Counter(y for x in s for y in where[x])
        for y, n in near.items():
            if 100 * n >= 85 * (len(s) + len(sets[y]) - n):
                a, b = sorted((find(k), find(y)))
                parent[b] = a
        for x in s:
            where[x].append(k)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_neardup_query(spark, sf_dir, docs):
    expected = brute_components({k: r.text for k, r in docs.items()})
    rows = QUERIES["op8_minhash_neardup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_neardup_in_a_hot_group_near_the_threshold(spark, monkeypatch):
    random.seed(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(150):
        words = list(base)
        for i in random.sample(range(120), random.randint(0, 6)):
            words[i] = f"x{random.randint(0, 10**6)}"
        texts[k] = " ".join(words)
    texts |= {200: "two words", 201: "Two  Words", 202: "", 203: "one"}
    # Small blocks and one leader leave much to the comparison of blocks.
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame).collect()}
    assert got == brute_components(texts)


def test_pipeline_takes_near_duplicates_by_five_words_and_80_percent(spark):
    import corpus_pipeline as P

    words = [f"w{i}" for i in range(200)]
    spread = [f"x{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    texts = {1: words, 2: words + [f"more{i}" for i in range(40)], 3: [f"v{w}" for w in words], 4: [f"v{w}" for w in spread]}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    stage = dict(P.STAGES)["minhash_neardup"]
    # 1 and 2 have a similarity of 0.83 in both sizes; 3 and 4 0.86 in threes and 0.77 in fives.
    assert {r.doc_id for r in stage(spark, frame, "").collect()} == {1, 3, 4}
    assert {r.doc_id for r in neardup.keep_one(frame).collect()} == {1, 2, 3}


# --- 9 ---------------------------------------------------------------------


def test_decontamination_query_finds_every_exact_item(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    rows = QUERIES["op9_decontamination"](spark, sf_dir).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    exact = {(k, i.item_id) for k, r in docs.items() for i in items if i.text in (r.text or "")}
    assert exact <= got
    assert len(got - exact) <= 0.2 * max(1, len(exact)), "clean documents are left alone"


def test_decontamination_recall_of_paraphrases(spark, sf_dir, docs):
    """Against every window by the longest common subsequence."""
    random.seed(9)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(20).collect()
    hosts = [r.text for r in docs.values() if len(r.text) > 1500][:20]
    rows = []
    for i, (item, host) in enumerate(zip(items, hosts)):
        words = item.text.split()
        for at in random.sample(range(len(words)), len(words) // 8):
            words[at] = "changed"
        rows.append(Row(doc_id=i, text=host[:700] + " " + " ".join(words) + " " + host[700:]))
    found = decontam.contaminated(spark.createDataFrame(rows), spark.createDataFrame(items))
    hit = {(r.doc_id, r.item_id) for r in found.collect()}
    assert sum((i, item.item_id) in hit for i, item in enumerate(items)) >= 0.9 * len(rows)


def test_items_of_common_words_and_short_items_are_found_among_rare_words():
    common = [f"usual{i}" for i in range(12)]
    short = "yes, it is"
    idf = np.full(decontam.FEATURES, 7.0)
    own = np.unique(decontam.features([w.encode() for w in common]))
    idf[own] = 0.7
    basis = np.eye(decontam.FEATURES)[:, np.append(own, np.setdiff1d(np.arange(decontam.FEATURES), own))[: decontam.RANK]]
    model = decontam.Model([(1, " ".join(common)), (2, short), (3, "is yes")], basis, idf)
    host = [f"rare{i}" for i in range(300)]
    texts = [" ".join(host[:at] + common + host[at:]) for at in range(100, 140)]
    texts += [" ".join(host), f"{' '.join(host)} Yes - it is. {' '.join(host)}", "yes it", "is"]
    got = [[m["item_id"] for m in found] for found in model.matches(texts)]
    assert got == [[1]] * 40 + [[], [2], [], []]


def test_passages_are_chosen_by_position_and_not_by_order(spark):
    rows = [(0, " ".join(f"long{i}" for i in range(64 * 400)))]
    rows += [(k, " ".join(f"short{k}x{i}" for i in range(64))) for k in range(1, 401)]
    frame = spark.createDataFrame(rows, "key long, text string")
    idf = np.ones(decontam.FEATURES)
    assert decontam.document_frequency(frame)[1:] == (401, 800)
    for order in (frame, frame.orderBy("key"), frame.orderBy(frame.key.desc()).repartition(5)):
        found = sorted(tuple(r.places) for r in decontam.passages(order, idf, rate=0.25).collect())
        short = decontam.passages(order.where("key > 0"), idf, rate=0.25).count()
        assert 150 <= len(found) <= 250 and 70 <= short <= 130
        assert found == sorted(tuple(r.places) for r in decontam.passages(frame, idf, rate=0.25).collect())
    assert decontam.passages(frame, idf).count() == 800


def test_common_subsequence():
    assert decontam.common([b"a", b"b", b"c", b"d"], [b"b", b"x", b"d", b"a"]) == 2
    assert decontam.common([b"a"], []) == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as P

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = frame
    for _, stage in P.STAGES[:-1]:
        before = kept.columns
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == before
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    expected = {r.doc_id: len(WORD.findall(r.text)) + 1 for r in kept.collect()}
    got = Counter()
    for r in P.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == expected and 0 < len(got) < len(docs)


def test_item_on_both_sides_of_a_chunk_of_windows_counts_once():
    """Windows are compared in chunks of 4096; an item at their border is one match of its text."""
    item = " ".join(f"word{i}" for i in range(40))
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((decontam.FEATURES, decontam.RANK)))[0]
    model = decontam.Model([(1, item)], basis, np.ones(decontam.FEATURES))
    filler = " ".join(f"other{i % 50}" for i in range(4095 * decontam.STEP + 8))
    assert [m["item_id"] for m in model.matches([f"{filler} {item} {filler}"])[0]] == [1]


def test_the_basis_is_fitted_on_every_passage(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(64))
    frame = spark.range(3000).selectExpr("id AS doc_id", f"concat('{words} {words} x', id) AS text")
    fitted = []
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((decontam.FEATURES, decontam.RANK)))[0]
    monkeypatch.setattr(decontam, "latent_basis", lambda vectors: fitted.append(vectors.count()) or basis)
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert len(list(decontam.models(frame, items))) == 1
    assert fitted == [3000 * 3 + 1]


def test_features_of_whole_texts_are_those_of_their_words():
    import xxhash

    random.seed(3)
    alphabet = [*"abcXYZ019", *"éß語😀", *".,()-", *" \t\n\x0b\x0c\r", "\x85", " "]
    texts = ["".join(random.choices(alphabet, k=random.choice([0, 1, 3, 40, 300]))) for _ in range(300)]
    texts += [None, "", " ", "x", ".", "z" * 40, *("q" * n for n in range(1, 20))]
    words = [decontam.byte_words(t) for t in texts]
    stripped = [w.strip(decontam._MARKS) for ws in words for w in ws]
    expected = [xxhash.xxh3_64_intdigest(w) % decontam.FEATURES if w else decontam.FEATURES for w in stripped]
    places, sizes = decontam.spoken_features([decontam.in_bytes(t) for t in texts])
    assert places.tolist() == expected and sizes.tolist() == [len(ws) for ws in words]


def test_product_of_passages_and_their_number_of_parts(spark, monkeypatch):
    """Each task sends a part as large as the basis, so few passages must not be many tasks."""
    frame = spark.range(300).selectExpr("id AS key", "id AS doc_id", "concat_ws(' ', transform(sequence(0, 99), i -> concat('w', (i * i * id) % 97))) AS text")
    idf = 1 + np.random.default_rng(2).random(decontam.FEATURES)
    basis = np.random.default_rng(1).standard_normal((decontam.FEATURES, 5))
    dense = []
    for r in frame.collect():
        places = decontam.features([w.encode() for w in r.text.split()])
        for at in range(0, 100, decontam.PASSAGE):
            row = np.bincount(places[at : at + decontam.PASSAGE], minlength=decontam.FEATURES) * idf
            dense.append(row / np.linalg.norm(row))
    a = np.array(dense)
    got = decontam.gram_product(decontam.passages(frame.repartition(7), idf), basis)
    assert np.abs(got - a.T @ (a @ basis)).max() < 1e-3
    parts = []
    monkeypatch.setattr(decontam, "latent_basis", lambda vectors: parts.append(vectors.rdd.getNumPartitions()) or np.eye(decontam.FEATURES, 128))
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string").coalesce(1)
    assert len(list(decontam.models(frame.repartition(40), items))) == 1
    assert parts[0] <= 2


def test_texts_meet_dropped_lines_by_one_kind_of_join_at_every_size(spark):
    frame = spark.createDataFrame([(k, f"k{'e' * 40}p {k}\nthe same line here\nx y{k}") for k in range(40)], "doc_id long, text string")
    cut = templates.drop_recurring(frame, counts=True)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    rows = cut.collect()
    assert sum(r.lines_dropped for r in rows) == 40 and all("same" not in r.text for r in rows)


def test_texts_are_taken_apart_once_for_frequencies_and_passages(spark):
    rows = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k * 10))) for k in range(15)] + [(None, None), (3, " ,. ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    idf, corpus = decontam.weighed_corpus(frame)
    df, n, n_passages = decontam.document_frequency(frame)
    assert (n, n_passages) == (17, sum(-(-k * 10 // decontam.PASSAGE) for k in range(15))) and corpus.count() == n_passages
    said = [set(decontam.features([w.encode() for w in (t or "").split()]).tolist()) for _, t in rows]
    assert {int(k): int(df[k]) for k in np.flatnonzero(df)} == {
        k: sum(k in s for s in said) for k in set().union(*said) - {decontam.FEATURES}
    }
    assert np.allclose(idf, np.log(18 / (df + 1)) + 1e-3)
    plain = decontam.passages(frame.selectExpr("doc_id AS key", "text"), idf)
    assert sorted(map(tuple, corpus.collect())) == sorted(map(tuple, plain.collect()))


def test_shingles_of_texts_taken_together(spark):
    texts = ["a b c d e a b c", None, "", "A B", "x", " y\n\tz  ", "a b c d e", "long" * 9 + " word " * 6, "B c d e f"]
    for size in (3, 5):
        together = neardup.shingle_sets(texts, size)
        for text, found in zip(texts, together):
            assert found.tolist() == neardup.shingle_set(text, size).tolist()
            words = (text or "").lower().split()
            runs = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
            assert len(found) == len(runs)
    assert set(together[6].tolist()) <= set(together[0].tolist())
    many = ["x" * 10] * (2 * neardup.TEXTS) + ["y" * (neardup.CHARS + 1)] * 2 + [None]
    parts = list(neardup.portions(many))
    assert [k for at, end in parts for k in range(at, end)] == list(range(len(many)))
    assert max(end - at for at, end in parts) == neardup.TEXTS and len(parts) == 5
    assert list(neardup.portions([])) == []


def test_stored_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    grouped = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    frame = grouped.join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k")
    tables = [stored(frame) for _ in range(2)]
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(CLEANUP, None) == setting
    assert [t.count() for t in (*tables, frame)] == [7] * 3


def test_signatures_and_sets_go_when_the_groups_are_known(spark, monkeypatch):
    frame = spark.createDataFrame([(k, f"some words of text {k % 7} and more of {k % 3}") for k in range(40)], "doc_id long, text string")
    paths, found, plans = [], common.shared_folder, []
    monkeypatch.setattr(common, "shared_folder", lambda s: paths.append(found(s)) or paths[-1])
    monkeypatch.setattr(
        neardup, "remaining_links", lambda *a, f=neardup.remaining_links: plans.append(f(*a)) or plans[-1]
    )
    groups = neardup.labelled(frame, neardup.STAGE)
    assert groups.where("label is not null").count() == 40
    left = [p for p in paths if os.path.isdir(p.removeprefix("file:"))]
    columns = {c for p in left for c in spark.read.parquet(p).columns}
    assert len(paths) > len(left) and columns and not columns & {"sig", "set"}
    # Members meet signatures and sets in one join, not in one for each side of a pair of blocks.
    assert "Union" not in plans[0]._jdf.queryExecution().analyzed().toString()


def test_further_links_join_components(spark):
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "e")], "node string, label string")
    links = spark.createDataFrame([("b", "d"), ("g", "h"), ("d", "h")], "a string, b string")
    got = dict(map(tuple, neardup.joined(labels, links).collect()))
    assert got == dict.fromkeys("abcdgh", "a") | dict.fromkeys("ef", "e")
    assert dict(map(tuple, neardup.joined(labels, links.limit(0)).collect())) == dict(map(tuple, labels.collect()))


def test_buckets_of_words_taken_together(monkeypatch):
    words = ["a", "word", "中文字", "ünï", "a", "𝒳y", "abcdefghijkl"]
    places, sizes = language._Buckets(1024).of_words(words)
    grams = [[f" {w} "[i : i + n] for n in (1, 2, 3) for i in range(len(w) + 3 - n)] for w in words]
    assert sizes.tolist() == [len(g) for g in grams]
    assert places.tolist() == [xxhash.xxh3_64_intdigest(g) % 1024 for gs in grams for g in gs]
    assert language.pieces("Ab" * 13 + " 1x_Y") == ["ab" * 6, "ab" * 6, "ab", "x", "y"]
    model = language.Model(["x", "y"], np.log(np.random.default_rng(1).random((1024, 2))).astype(np.float32))
    texts = [" ".join(f"w{chr(97 + k % 20)}{chr(97 + j * k % 20)}" for j in range(k)) for k in range(30)] + [None, "", "12"]
    together = model.infer_all(texts)
    monkeypatch.setattr(language, "MEMORY", 25)
    model.forget(0)
    assert [model.infer(t) for t in texts] == together and together[-1] == ("und", 0.0, [0.0, 0.0])
