"""Column profiles and type inference over rows of text cells."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.scalars import TYPES, strip

# How much of a table is looked at, and how much is shown.
PREVIEW_ROWS = 20
PROFILED_ROWS = 200
CATEGORIES = 20
SAMPLES = 10


def as_text(table: DataFrame) -> DataFrame:
    """All columns as text."""
    return table.select(*(F.col(c).cast("string").alias(c) for c in table.columns))


def cells(table: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(ordinal, name, row, value): one row per cell, value stripped, empty if null."""
    made = F.array(
        *(
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.coalesce(strip(c), F.lit("")).alias("value"))
            for i, c in enumerate(columns)
        )
    )
    return table.select(F.col(row).alias("row"), F.explode(made).alias("c")).select("row", "c.*")


def inferred_type(value: str = "value") -> Column:
    """Aggregate: the first type that all non-empty values have; unknown if there
    are none."""
    filled = F.col(value) != ""
    found = F.lit("string")
    for name, test in reversed(TYPES):
        found = F.when(F.bool_and(F.when(filled, test(value))), name).otherwise(found)
    return F.when(F.count_if(filled) == 0, "unknown").otherwise(found)


def infer_types(cells_of: DataFrame, by: list[str] = ()) -> DataFrame:
    """The type of each column; ``by`` names what tells tables apart."""
    return cells_of.groupBy(*by, "ordinal", "name").agg(inferred_type().alias("inferred_type"))


def profile(cells_of: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per column: type, nullable, distinct ratio, first distinct values and, if
    there are few, all of them, in order of their first row; n_filled, n_empty and
    ``row_ratio``, the distinct values by all rows.  ``by`` names the columns that tell
    tables apart; without it all cells are of one table.

    Values are counted before they meet by column, so a column's values are never
    gathered: only its first ``SAMPLES`` and at most ``CATEGORIES + 1`` are.
    """
    column = [*by, "ordinal", "name"]
    values = cells_of.groupBy(*column, "value").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    filled = F.col("value") != ""
    sums = values.groupBy(*column).agg(
        inferred_type().alias("inferred_type"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("n_filled"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("n_empty"),
        F.count_if(filled).alias("n_distinct"),
    )
    place = F.row_number().over(Window.partitionBy(*column).orderBy("first", "value"))
    # Spark keeps the first rows of each group in the partial step of this limit.
    heads = values.filter(filled).withColumn("place", place).filter(F.col("place") <= CATEGORIES)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    firsts = heads.groupBy(*column).agg(in_order.alias("values"))
    joined = sums.join(firsts, column, "left")
    some = F.coalesce("values", F.array().cast("array<string>"))
    return joined.select(
        *column,
        "inferred_type",
        (F.col("n_empty") > 0).alias("nullable"),
        F.try_divide(F.col("n_distinct"), F.col("n_filled")).alias("distinct_ratio"),
        F.slice(some, 1, SAMPLES).alias("sample_values"),
        F.when(F.col("n_distinct") <= CATEGORIES, some).otherwise(F.array().cast("array<string>")).alias("categorical_values"),
        "n_filled",
        "n_empty",
        F.try_divide(F.col("n_distinct"), F.col("n_filled") + F.col("n_empty")).alias("row_ratio"),
    )


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """(left_column, right_column, r) for each pair: one pass, a row per pair.
    Rows with a null in one of the two don't count for that pair."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("a correlation takes two columns")
    one = table.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(
        *(
            F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        )
    )
    return one.select(F.inline(rows))


def typed(rows: DataFrame, cell_array: str, columns: list[tuple[str, str]], rescued: str | None = None) -> DataFrame:
    """A table from rows of cells: each column cast to the type inferred for it.  What
    doesn't fit is null; the column ``rescued``, if it is asked for, is a map from names to
    the cells that didn't fit, null in rows where all did."""
    kinds = {"boolean": "boolean", "integer": "bigint", "float": "double", "date": "date", "datetime": "timestamp"}

    def raw(i: int) -> Column:
        return F.nullif(strip(F.get(F.col(cell_array), F.lit(i))), F.lit(""))

    def cast(i: int, kind: str) -> Column:
        text = F.replace(raw(i), F.lit("_"), F.lit("")) if kind in ("integer", "float") else raw(i)
        return text.try_cast(kinds[kind]) if kind in kinds else text

    made = [cast(i, k).alias(n) for i, (n, k) in enumerate(columns)]
    if rescued is not None:
        wrong = [F.struct(F.lit(n).alias("key"), F.when(cast(i, k).isNull(), raw(i)).alias("value")) for i, (n, k) in enumerate(columns) if k in kinds]
        kept = F.filter(F.array(*wrong), lambda x: x["value"].isNotNull()) if wrong else F.array().cast("array<struct<key:string,value:string>>")
        made.append(F.when(F.size(kept) > 0, F.map_from_entries(kept)).alias(rescued))
    return rows.select(*made)


def register(found: DataFrame, types: DataFrame, names: dict[str, str], cell_array: str = "body", rescued: str | None = None) -> None:
    """Typed temporary views of some tables, to be asked by ``spark.sql``.

    ``found``: table_id, header and ``cell_array`` (rows of cells); ``types``: table_id,
    ordinal, inferred_type; ``names``: table_id to the view's name, a few tables that
    a user picked, of which only headers and types come to the driver.  ``rescued``: see
    :func:`typed`.
    """
    wanted = found.filter(F.col("table_id").isin(*names))
    headers = {r.table_id: r.header for r in wanted.select("table_id", "header").collect()}
    kinds = {(r.table_id, r.ordinal): r.inferred_type for r in types.filter(F.col("table_id").isin(*names)).collect()}
    for table_id, view in names.items():
        if table_id not in headers:
            raise ValueError(f"no table {table_id}")
        rows = wanted.filter(F.col("table_id") == table_id).select(F.explode(cell_array).alias("cells"))
        columns = [(n, kinds.get((table_id, i), "string")) for i, n in enumerate(headers[table_id])]
        typed(rows, "cells", columns, rescued).createOrReplaceTempView(view)
