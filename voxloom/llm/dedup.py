"""Duplicates hidden by formatting differences: dictionary-encoded grouping.

Each distinct value of a column is canonicalised once and gets an integer from a
dictionary; a record becomes a tuple of integers in a fixed field order; the
compact tuples are grouped. Copies of a record never meet in one task: tuples
are pre-aggregated before the shuffle and the way back to the rows is a join in
which hot tuples are dealt over many parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.forms import bare, blank_to_null
from voxloom.plans.scale import skew_join, written


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, Decimal) and x.is_finite():
        x = x.normalize()
        return f"\x00{x}" if x else "\x000"
    return f"\x00{x}" if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


def json_form(s: str | None) -> str | None:
    """One string for all spellings of a JSON value: fields sorted, blanks gone,
    numbers by value (3, 3.0 and 30e-1 are one). Text that is no JSON stands for
    itself, apart from any JSON value."""
    if s is None:
        return None
    try:
        value = json.loads(s, parse_float=Decimal, parse_int=Decimal)
        return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError, ArithmeticError):
        return "\x01" + s


def json_canonical(c: Column) -> Column:
    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([json_form(v) for v in x], dtype=object)

    return forms(c)


def digest(c: Column) -> Column:
    """128 bits that stand for a value; null stays null."""
    return F.unhex(F.md5(c))


def encode(rows: DataFrame, fields: Mapping[str, Column], canonical: Mapping[str, object], row: str) -> DataFrame:
    """``rows`` as (row, one dictionary integer a field).

    Values travel once, to the dictionary; rows carry 16-byte digests of them."""
    narrow = written(rows.select(F.col(row).alias("_row"), *[digest(c.cast("string")).alias(f) for f, c in fields.items()]), "digests")
    coded = narrow
    for f, c in fields.items():
        values = rows.select(c.cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
        # written before it is filtered: a filter on the form would make each form twice
        forms = written(values.select(digest(F.col("v")).alias(f), digest(canonical[f](F.col("v"))).alias("form")), "forms").filter(F.col("form").isNotNull())
        ids = written(forms.select("form").distinct().select("form", F.monotonically_increasing_id().alias(f"{f}_id")), "ids")
        # both tables are smaller than the rows: a value and a form are each there once
        dictionary = forms.join(ids, "form").select(f, f"{f}_id")
        coded = skew_join(coded, dictionary, [f], "_row", "left").drop(f)
        coded = written(coded, "coded")
    return coded


def _form(c: Column) -> Column:
    return blank_to_null(bare(c))


def duplicate_sets(manifest: DataFrame, row: str = "row_no", text: str = "text", speaker: str = "speaker", extra: str = "extra") -> DataFrame:
    """(row_no, keep_no, copies): rows whose text and speaker are equal when bare
    and whose extra is the same JSON value are one set.

    keep_no is the smallest row of the set, copies its number of rows. A row whose
    text or speaker is null or empty when bare is a set of its own. Null extra
    equals null extra only. Columns of other names are ignored; an empty table
    gives an empty result."""
    coded = encode(
        manifest,
        {"t": F.col(text), "s": F.col(speaker), "x": F.col(extra)},
        {"t": _form, "s": _form, "x": json_canonical},
        row,
    )
    null = F.lit(-1).cast("long")
    tuples = coded.select("_row", "t_id", "s_id", F.coalesce("x_id", null).alias("x_id"))
    able = tuples.filter(F.col("t_id").isNotNull() & F.col("s_id").isNotNull())
    key = ["s_id", "t_id", "x_id"]
    sets = written(able.groupBy(*key).agg(F.min("_row").alias("keep_no"), F.count(F.lit(1)).alias("copies")), "sets")
    back = skew_join(able, sets, key, "_row", "inner").select("_row", "keep_no", "copies")
    alone = tuples.filter(F.col("t_id").isNull() | F.col("s_id").isNull()).select("_row", F.col("_row").alias("keep_no"), F.lit(1).cast("long").alias("copies"))
    return back.unionByName(alone).withColumnRenamed("_row", row)


def found(sets: DataFrame, row: str = "row_no") -> DataFrame:
    """(keep_no, copy_no) of all copies but the kept one."""
    return sets.filter(F.col(row) != F.col("keep_no")).select("keep_no", F.col(row).alias("copy_no"))


def collapsed(manifest: DataFrame, row: str = "row_no") -> DataFrame:
    """One row a set, with all columns of the kept row and its number of copies.

    The count is named ``n_copies``, or ``n_copies_`` if the table has that name."""
    name = "n_copies_" if "n_copies" in manifest.columns else "n_copies"
    kept = duplicate_sets(manifest, row).filter(F.col(row) == F.col("keep_no")).select(row, F.col("copies").alias(name))
    return manifest.join(kept, row)
