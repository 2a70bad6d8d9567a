"""Work along an order of all rows, without one task that sees them all: ranges, numbers, running sums, and folds whose state is small.

Rows are dealt by ranges of the order and written once with their place, so a stream or a hot key that holds most rows is many tasks. Of each
range a few numbers go to the driver, which is where one range's end meets the next one's beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.tables import settled

#: Rows of a range, about.
RANGE_ROWS = 100_000
RANGE, AT = "__range", "__at"


def ranges(rows: DataFrame, order: Sequence[str | Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows, written, with __range (0, 1, ... along the order, some may be empty) and __at (increases along the order). Ties have some order, which stays."""
    pieces = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return settled(dealt.withColumn(RANGE, F.shiftright(AT, 33).cast("int")), "ranges")


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "number", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their number (from 0) along the order."""
    dealt = ranges(rows, order, range_rows)
    counts = dealt.groupBy(F.col(RANGE).alias("__r")).agg(F.count(F.lit(1)).alias("__n"), F.min(AT).alias("__first"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = dealt.join(before, F.col(RANGE) == F.col("__r"))
    return joined.withColumn(name, F.col(AT) - F.col("__first") + F.col("__before")).select(*rows.columns, name)


def key_ranges(rows: DataFrame, key: str, order: Sequence[str | Column], carried: dict[str, Column], *entering: dict[str, Column], local: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with __range and __at, in ranges of (key, order), and what each key's rows of a range begin with, from its rows in the ranges before.

    local: columns over within(key). carried: aggregates over a key's rows of one range, which may read those. entering: from these, columns over the window
    before(), all ranges of the key before this one; later ones may read earlier ones. A key that holds most rows is many ranges, and of each only its
    aggregates meet. Null is a key.
    """
    dealt = ranges(rows, [F.asc_nulls_first(key), *order], range_rows).withColumns(local or {})
    sums = dealt.groupBy(F.col(key).alias("__key"), F.col(RANGE).alias("__r")).agg(*(c.alias(n) for n, c in carried.items()))
    for columns in entering:
        sums = sums.withColumns(columns)
    sums = sums.select("__key", "__r", *(n for columns in entering for n in columns))
    return dealt.join(sums, dealt[key].eqNullSafe(sums["__key"]) & (dealt[RANGE] == sums["__r"])).drop("__key", "__r")


def before() -> W:
    """For entering: a key's ranges before this one."""
    return W.partitionBy("__key").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)


def within(key: str) -> W:
    """A key's rows of one range, in order."""
    return W.partitionBy(key, RANGE).orderBy(AT)


def numbered_within(rows: DataFrame, key: str, order: Sequence[str | Column], name: str = "number", range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with their number (from 0) along the order among those of their key."""
    dealt = key_ranges(rows, key, order, {"__n": F.count(F.lit(1))}, {"__before": F.coalesce(F.sum("__n").over(before()), F.lit(0))}, range_rows=range_rows)
    return dealt.withColumn(name, F.row_number().over(within(key)) - 1 + F.col("__before")).select(*rows.columns, name)


def fold_ranges(dealt: DataFrame, columns: Sequence[str], tables: Callable[[pa.Table], dict], table_schema: str, entries: Callable[[list], dict[int, tuple]], apply: Callable[[pa.Table, tuple], pa.Array], out: str, out_type: str) -> DataFrame:
    """dealt (from ranges) with a column `out`, for a fold along the order whose state is small.

    tables: of one range's rows (columns, in order), what it does to every state that it may be entered with, as a row of table_schema. entries: of all ranges'
    rows (with __range, in order), on the driver, the state in which each is entered, by range. apply: of a range's rows and that state,
    the column's values. Both passes see one range at a time.
    """
    spark = dealt.sparkSession
    own = dealt.select(RANGE, AT, *columns)

    def summed(group: pa.Table) -> pa.Table:
        group = group.sort_by(AT)
        row = {RANGE: group.column(RANGE)[0].as_py(), **tables(group)}
        return pa.Table.from_pylist([row], schema)

    kind = f"{RANGE} int, {table_schema}"
    schema = _arrow_schema(spark, kind)
    found = sorted((r.asDict() for r in own.groupBy(RANGE).applyInArrow(summed, kind).collect()), key=lambda r: r[RANGE])
    states = spark.sparkContext.broadcast(entries(found))

    def folded(group: pa.Table) -> pa.Table:
        group = group.sort_by(AT)
        return pa.table({AT: group.column(AT), out: apply(group, states.value[group.column(RANGE)[0].as_py()])})

    values = own.groupBy(RANGE).applyInArrow(folded, f"{AT} long, {out} {out_type}").withColumnRenamed(AT, "__of")
    return dealt.join(values, F.col(AT) == F.col("__of")).drop("__of")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema
