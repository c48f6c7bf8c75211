"""Input files as a table, and checks on their names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from posixpath import basename

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.text import file_stem

#: Gives the name under which a file is read from its path.
Naming = Callable[[Column], Column]


def require_unique(spark: SparkSession, path: str, name: Callable[[str], str] = str) -> None:
    """Fail where two files would be read under one name; this lists the files and starts no job."""
    found = Counter(name(basename(f)) for f in spark.read.text(path).inputFiles())
    twice = sorted(k for k, n in found.items() if n > 1)
    if twice:
        raise ValueError(f"several files are named {', '.join(twice[:5])}")


def require_unique_names(spark: SparkSession, path: str, name: Naming) -> None:
    """As ``require_unique`` for names taken from whole paths."""
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "path string")
    twice = files.groupBy(name(F.col("path")).alias("name")).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several files are named {', '.join(sorted(r.name for r in twice))}")


def manifest(spark: SparkSession, path: str, name: Naming = file_stem) -> DataFrame:
    """``path, name, bytes`` of the files under a path, listed by Spark and not opened.

    By default a file is named as a batch job: ``G1.v1.fa`` and ``G1.v2.fa`` are two.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", name(F.col("path")).alias("name"), F.col("length").alias("bytes"))
