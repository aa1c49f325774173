"""Column types of text values, folded over all rows.

Every value is of one kind: int (32 bits), whole number (64 bits), decimal number, time or text.
Kinds form a lattice: int < whole < decimal < text, time < text.  The type of a column is the least kind that holds all its
values, and as kinds are counted, partial results of any split of the rows merge by adding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("int", "whole", "decimal", "time", "text")
TYPES = {"int": "int", "whole": "bigint", "decimal": "double", "time": "timestamp_ntz", "text": "string"}
_WHOLE = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
         r"([ T]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")


def kind_of(text: Column) -> Column:
    """The kind of a value, null for null and empty text.

    A whole number that no 64-bit integer holds is a decimal; a day that is not in the calendar
    makes a text.
    """
    t = F.trim(text)
    return (F.when(t.isNull() | (t == ""), F.lit(None))
            .when(t.rlike(_WHOLE) & t.try_cast("int").isNotNull(), "int")
            .when(t.rlike(_WHOLE) & t.try_cast("bigint").isNotNull(), "whole")
            .when(t.rlike(_DECIMAL), "decimal")
            .when(t.rlike(_TIME) & F.substring(t, 1, 10).try_cast("date").isNotNull(), "time")
            .otherwise("text"))


def column_types(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per column of `values(*keys, column, text)`: its type and what its values are.

    `n_*` counts the kinds, `missing` nulls and empty texts; `misfits` counts the values outside
    what most values are (numbers, times or texts).  A column without values is `void`.
    """
    kind = values.select(*keys, "column", kind_of(F.col("text")).alias("kind"))
    out = kind.groupBy(*keys, "column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("kind").isNull()).alias("missing"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    n = {k: F.col(f"n_{k}") for k in KINDS}
    wholes = n["int"] + n["whole"]
    numbers = wholes + n["decimal"]
    joined = (F.when((n["text"] > 0) | ((n["time"] > 0) & (numbers > 0)), "text")
              .when(n["time"] > 0, "time").when(n["decimal"] > 0, "decimal")
              .when(n["whole"] > 0, "whole").when(n["int"] > 0, "int"))
    names = F.create_map(*[F.lit(x) for kt in TYPES.items() for x in kt])
    # a whole number fits among decimals
    most = F.greatest(n["text"], n["time"], numbers)
    return out.select(
        *keys, "column", F.coalesce(F.try_element_at(names, joined), F.lit("void")).alias("type"),
        "rows", "missing", *[f"n_{k}" for k in KINDS],
        (F.col("rows") - F.col("missing") - most).alias("misfits"))


def text_values(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Wide rows to (*keys, column, text)."""
    columns = [c for c in (columns or df.columns) if c not in keys]
    wide = df.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return wide.unpivot(list(keys), [F.col(f"`{c}`") for c in columns], "column", "text")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their types; what is missing becomes null."""
    def cast(c: str) -> Column:
        t = F.col(f"`{c}`")
        kind = types.get(c, "string")
        if kind in ("string", "void"):
            return t
        t = F.nullif(F.trim(t), F.lit(""))
        return (F.regexp_replace(t, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "") if kind == "timestamp_ntz" else t).cast(kind)

    return df.select(*[cast(c).alias(c) for c in df.columns])
