"""What several operators share: stored intermediate tables, words, streams of groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and words, as Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one in spark.checkpoint.dir; only where that is unset, as in tests, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_PASSING: ContextVar[list[str] | None] = ContextVar("_PASSING", default=None)


#: Shuffle files of a statement go at its end and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements run inside of the block leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it again.

    This cuts the lineage, so a lost executor costs no more than the running
    stage, and unlike ``checkpoint()`` computes the frame once only. What was
    shuffled for it is not needed any more and removed.
    """
    path = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    paths = _PASSING.get()
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside of the block are removed at its end; the given function stores one that stays.

    Frames used behind the block may read tables that stay and no others.
    """
    outer = _PASSING.get()
    paths: list[str] = []
    token = _PASSING.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        inner = _PASSING.set(outer)
        try:
            return stored(df)
        finally:
            _PASSING.reset(inner)

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def byte_words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; ``split`` cuts at exactly the six characters of SPACE."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def portions(texts: list[str | None], most: int, chars: int) -> Iterator[tuple[int, int]]:
    """From where to where texts are taken together: ``most`` at most, and ``chars`` characters unless one has more."""
    at = held = 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > at and (k - at == most or held + size > chars):
            yield at, k
            at, held = k, 0
        held += size
    if texts:
        yield at, len(texts)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
