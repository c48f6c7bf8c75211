"""Names, keys and lists as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladewise.schema import GAP


def file_name(path: Column) -> Column:
    """Last component of a path; the trait name of a group file, extension kept."""
    return F.element_at(F.split(path, "/"), -1)


def gene_name(path: Column) -> Column:
    """Base name up to the first dot."""
    return F.split_part(file_name(path), F.lit("."), F.lit(1))


def file_stem(path: Column) -> Column:
    """Base name less its last suffix; the name of a batch job."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder_value(column: str) -> Callable[[Column], Column]:
    """The value of ``column`` in a path with folders named ``column=value``, as partitioned writers make them."""
    return lambda path: F.regexp_extract(path, f"/{column}=([^/]+)/", 1)


def position_key(gene: Column, pos: Column) -> Column:
    return F.concat(gene, F.lit("@"), pos.cast("string"))


def pair_key(a: Column, b: Column) -> Column:
    """Order-free key of two labels."""
    return F.concat(F.least(a, b), F.lit("@"), F.greatest(a, b))


def substitution(fg: Column, bg: Column) -> Column:
    """Sorted foreground symbols, a slash, sorted background symbols."""
    return F.concat(
        F.array_join(F.sort_array(fg), ""), F.lit("/"), F.array_join(F.sort_array(bg), "")
    )


def comma_list(names: Column) -> Column:
    return F.array_join(F.sort_array(names), ",")


def comma_list_or_dash(names: Column) -> Column:
    return F.when(F.size(names) == 0, F.lit("-")).otherwise(comma_list(names))


def names_in(comma_text: Column) -> Column:
    """The names of a comma list, empty names dropped."""
    return F.filter(F.split(comma_text, ","), lambda name: name != "")


def symbol_at(seq: Column, pos: Column) -> Column:
    """Symbol at a 0-based column; a sequence that ends earlier has a gap there."""
    symbol = F.substr(seq, pos + 1, F.lit(1))
    return F.when(symbol == "", F.lit(GAP)).otherwise(symbol)


def hash60(text: Column) -> Column:
    """The first 60 bits of an MD5 digest, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
