"""Token ids in files of compressed documents with a shared dictionary.

A folder has ``dictionary/``, one file with a zstandard dictionary trained on
serialized id arrays, and ``shards/``, whose files in order of name hold the
documents in ascending order of id. A shard is

    header   magic, bytes of an id (2 or 4), SHA-256 of the dictionary
    frames   one zstandard frame for each document: its ids, little-endian
    index    compressed table: id, null flag, ids in the document, ids before it
             in the shard, place and length of its frame
    footer   place and length of the index, number of documents, magic

with one newline byte behind each of these blocks. The index gives any document
with one read of the footer, one of the index and one of the frame:
``read_document`` does so by byte ranges and finds the shard by bisection.
``read_ids`` reads all documents, or many wanted ones, as a job.

Files are written by Spark's own writer, one for each partition, so they go to
any store, and a lost executor's part is written anew before it is committed.
Frames are compressed before the shuffle that sorts them. The dictionary is
fitted on about ``SAMPLE_DOCS`` documents, chosen by a hash of id and text, and
``SAMPLE_CHARS`` characters of each from a place that the hash gives; without
enough of them it is empty and frames stand alone.

A null text is empty and has the end id alone. Null ids come first. Rows of the
same id come in order of a hash of their text; repeated rows are kept. An empty
table gives a folder without documents. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from cladewise.llm.common import stored
from cladewise.llm.tokens import _ASTRAL, PreTokens, Units, load, pre_token_pattern, special_pattern, special_tokens

MAGIC = b"IDSHARD1"
HEADER = struct.Struct("<8sB32s")
FOOTER = struct.Struct("<QQQ8s")
INDEX = np.dtype(
    [("doc_id", "<i8"), ("null", "u1"), ("n", "<u8"), ("before", "<u8"), ("place", "<u8"), ("length", "<u8")]
)
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
LEVEL = 3
#: Shards in a block of the sums over shards.
BLOCK = 1024


def header(width: int, digest: bytes) -> bytes:
    return HEADER.pack(MAGIC, width, digest)


def index_and_footer(rows: list[tuple], place: int) -> list[bytes]:
    """The index that stands at ``place``, and what tells where it stands."""
    packed = zstandard.compress(np.array(rows, dtype=INDEX).tobytes(), LEVEL)
    return [packed, FOOTER.pack(place, len(packed), len(rows), MAGIC)]


class ByteUnits(Units):
    """Units whose bytes are looked up without a step of Python for each."""

    def of(self, text: str) -> Iterable[bytes]:
        if not self.regular(text):
            return [self.value(text)]
        first, space, rest = text.partition(" ")
        found = map(self.__getitem__, rest.split(" ")) if space else ()
        return chain([self.value(first)], found) if first else found


class Encoder:
    """Ids of texts as bytes, in one worker."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.kind = path, "H" if width == 2 else "I"
        self.cut = pre_token_pattern(path).findall
        self.special, self.names = special_pattern(path), special_tokens(path)
        self.pre_tokens = PreTokens(path, self._bytes)
        self.units = ByteUnits(self._unit)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _unit(self, text: str) -> bytes:
        if _ASTRAL.search(text):
            return self._bytes(load(self.path).encode(text, add_special_tokens=False).ids)
        cut = self.cut(text)
        return self.pre_tokens[cut[0]] if len(cut) == 1 else b"".join(map(self.pre_tokens.__getitem__, cut))

    def encode(self, text: str | None, end: int = 0) -> bytes:
        out: list[bytes] = []
        for i, part in enumerate(self.special.split(text or "")):
            if i % 2:
                out.append(self._bytes([self.names[part]]))
            else:
                out.extend(self.units.of(part))
        out.append(self._bytes([end]))
        return b"".join(out)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def id_width(path: str) -> int:
    return 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, width: int) -> bytes:
    """A dictionary from about ``SAMPLE_DOCS`` documents; the driver gets their ids, some 16 KB of each at most.

    A document is in the sample if its hash falls below a rate that the number of rows
    gives, so the sample follows from the rows alone and not from their order. Copies
    count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoder(path, width).encode(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    every = max(1, docs.count() // SAMPLE_DOCS)
    place = F.xxhash64("doc_id", "text")
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    chosen = docs.where(F.pmod(place, F.lit(every)) == 0).select(
        F.substring("text", (F.pmod(F.xxhash64(place), room) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    )
    pieces = sorted(bytes(r[0]) for r in chosen.distinct().mapInArrow(run, "ids binary").collect())
    pieces = [p for p in pieces if len(p) >= 8]
    if len(pieces) < 32:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, pieces)) // 8), pieces).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


@lru_cache(maxsize=4)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _write_bytes(rows: DataFrame, path: str) -> None:
    """Binary values as they are, each with a newline byte behind it."""
    rows.select(F.col("value").cast("string")).write.text(path)


def write_ids(docs: DataFrame, path: str, folder: str, end: int = 0) -> None:
    """Encode every text, end it with the id ``end``, and write the folder."""
    spark = docs.sparkSession
    width = id_width(path)
    raw = train_dictionary(docs, path, width)
    digest = hashlib.sha256(raw).digest()
    shared = spark.sparkContext.broadcast(raw)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        coder = encoder(path, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [coder.encode(t, end) for t in part.column(2).to_pylist()]
                n = pa.array([len(x) // width for x in ids], pa.int64())
                packed = [packer.compress(x) for x in ids]
                frames, size = pa.array(packed, pa.binary()), pa.array([len(x) for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), n, size, frames], ["doc_id", "tie", "n", "size", "frame"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    frames = stored(rows.mapInArrow(compress, "doc_id long, tie long, n long, size long, frame binary"))
    total = frames.agg(F.sum("size")).first()[0] or 0

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[tuple] = []
        place, before = len(header(width, digest)) + 1, 0
        started = False
        for batch in batches:
            out = [] if started else [header(width, digest)]
            started = True
            for doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "frame"))):
                index.append((doc_id or 0, doc_id is None, n, before, place, len(frame)))
                place, before = place + len(frame) + 1, before + n
                out.append(frame)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array(index_and_footer(index, place), pa.binary())], ["value"])

    ordered = frames.drop("size").repartitionByRange(max(1, -(-total // SHARD_BYTES)), "doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie"
    )
    _write_bytes(ordered.mapInArrow(shard, "value binary"), f"{folder}/shards")
    _write_bytes(spark.createDataFrame([(bytearray(raw),)], "value binary").coalesce(1), f"{folder}/dictionary")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    found = [bytes(r[0])[:-1] for r in spark.read.format("binaryFile").load(f"{folder}/dictionary").select("content").collect()]
    return next((x for x in found if x), b"")


def _footer(data: bytes) -> tuple[int, int, int]:
    place, length, n, end = FOOTER.unpack_from(data)
    if end != MAGIC:
        raise ValueError("not a shard")
    return place, length, n


def _width(data: bytes, dictionary: bytes) -> int:
    magic, width, digest = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    return width


def _index(packed: bytes, n: int) -> np.ndarray:
    index = np.frombuffer(zstandard.decompress(packed), dtype=INDEX)
    if len(index) != n:
        raise ValueError("the index is not whole")
    return index


def open_shard(data: bytes, dictionary: bytes) -> tuple[int, np.ndarray]:
    """Bytes of an id and the index of a shard; the dictionary has to be the one it was written with."""
    place, length, n = _footer(data[-FOOTER.size - 1 :])
    return _width(data, dictionary), _index(data[place : place + length], n)


class Ranges:
    """Byte ranges of files in any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark._jvm
        root = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        status = [f for f in self._fs.listStatus(root) if f.getPath().getName().startswith("part-")]
        #: Path and length of the files that hold something, in order of name.
        self.files = sorted((f.getPath().toString(), f.getLen()) for f in status if f.getLen())

    def read(self, path: str, start: int, n: int) -> bytes:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(path))
        try:
            stream.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()


def read_document(spark: SparkSession, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row of a document, read by byte ranges; nothing where there is none.

    Shards are in order of id, so footers and indexes of a few of them lead to the first
    one whose last id is not smaller; frames are read of the asked document alone.
    """
    ranges = Ranges(spark, f"{folder}/shards")
    wanted = (doc_id is not None, doc_id or 0)
    indexes: dict[int, np.ndarray] = {}

    def index_of(k: int) -> np.ndarray:
        if k not in indexes:
            path, size = ranges.files[k]
            place, length, n = _footer(ranges.read(path, size - FOOTER.size - 1, FOOTER.size))
            indexes[k] = _index(ranges.read(path, place, length), n)
        return indexes[k]

    def last(k: int) -> tuple[bool, int]:
        row = index_of(k)[-1]
        return not row["null"], int(row["doc_id"])

    found: list[np.ndarray] = []
    dictionary = None
    # Rows of one id may go on in the next shard.
    for k in range(bisect_left(range(len(ranges.files)), wanted, key=last), len(ranges.files)):
        index, path = index_of(k), ranges.files[k][0]
        rows = index[(index["doc_id"] == wanted[1]) & (index["null"] == (not wanted[0]))]
        if not len(rows):
            break
        if dictionary is None:
            dictionary = read_dictionary(spark, folder)
        width = _width(ranges.read(path, 0, HEADER.size), dictionary)
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for place, length in zip(rows["place"].tolist(), rows["length"].tolist()):
            found.append(np.frombuffer(unpacker.decompress(ranges.read(path, place, length)), dtype=f"<u{width}"))
    return found


def read_ids(spark: SparkSession, folder: str, wanted: frozenset[int] | None = None) -> DataFrame:
    """``shard, doc_id, before, n_tokens, ids`` of all documents, or of the few that are wanted."""
    dictionary = spark.sparkContext.broadcast(read_dictionary(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary.value))
        names = ["shard", "doc_id", "before", "n_tokens", "ids"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer().to_pybytes()
                if not data:
                    continue
                width, index = open_shard(data, dictionary.value)
                if wanted is not None:
                    index = index[np.isin(index["doc_id"], list(wanted)) & (index["null"] == 0)]
                shard = int(re.search(r"part-(\d+)", path)[1])
                for at in range(0, len(index), 512):
                    rows = index[at : at + 512]
                    ids = [
                        np.frombuffer(unpacker.decompress(data[p : p + k]), dtype=f"<u{width}").astype("<u4").tobytes()
                        for p, k in zip(rows["place"].tolist(), rows["length"].tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(rows), pa.int64()),
                            pa.array(rows["doc_id"], pa.int64(), mask=rows["null"] == 1),
                            pa.array(rows["before"].astype("i8")),
                            pa.array(rows["n"].astype("i8")),
                            pa.array(ids, pa.binary()),
                        ],
                        names,
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    return files.select("path", "content").mapInArrow(
        run, "shard long, doc_id long, before long, n_tokens long, ids binary"
    )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    A document starts after the ids of earlier shards and those before it in its own.
    Sums of shards are added up within blocks of shards, and those of blocks on top.
    """
    read = read_ids(spark, folder)
    rows = stored(read.select("shard", "doc_id", "before", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("block", F.floor(F.col("shard") / BLOCK))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))

    def before(order: WindowSpec) -> Column:
        return F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = blocks.select("block", before(Window.orderBy("block")).alias("base"))
    within = sums.select("block", "shard", before(Window.partitionBy("block").orderBy("shard")).alias("within"))
    bases = within.join(blocks, "block").select("shard", (F.col("base") + F.col("within")).alias("base"))
    return rows.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
