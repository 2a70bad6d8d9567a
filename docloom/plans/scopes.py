"""An index of predicates: which rows lie in which scopes, for any number of scopes in one plan.

A scope sets some of a number of fields, each to one or more allowed values; a row lies in it if all of these allow its value. Scopes
are exploded into one key per combination of allowed values, points into one key per combination of fields that some scope sets (few:
the subsets of the fields in use), and an equi-join finds the pairs. The plan grows with the combinations of fields, never with the scopes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_set(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def fields_in_use(scopes: DataFrame, fields: Sequence[str]) -> list[int]:
    """The combinations of set fields, as bits; 2**len(fields) at most, whatever the number of scopes."""
    bits = sum((_is_set(F.col(f)).cast("int") * (1 << i) for i, f in enumerate(fields)), F.lit(0))
    return sorted(scopes.agg(F.collect_set(bits)).first()[0])


def scope_keys(scopes: DataFrame, fields: Sequence[str], *columns: str) -> DataFrame:
    """(columns, bits, values, key): a row for each combination of allowed values; a field that is not set has null in values."""
    bits = sum((_is_set(F.col(f)).cast("int") * (1 << i) for i, f in enumerate(fields)), F.lit(0))
    out = scopes.select(*columns, bits.alias("bits"), *(F.when(_is_set(F.col(f)), F.array_distinct(f)).otherwise(F.array(F.lit(None).cast("string"))).alias(f"f{i}") for i, f in enumerate(fields)))
    for i in range(len(fields)):
        out = out.withColumn(f"f{i}", F.explode(f"f{i}"))
    values = F.array(*(F.col(f"f{i}") for i in range(len(fields))))
    return out.select(*columns, "bits", values.alias("values"), F.xxhash64("bits", values).alias("key"))


def point_keys(points: DataFrame, fields: Sequence[str], used: Sequence[int]) -> DataFrame:
    """points with bits, values and key: a row for each combination in use whose fields all have a value."""

    def entry(bits: int) -> Column:
        within = [F.col(f).cast("string") if bits >> i & 1 else F.lit(None).cast("string") for i, f in enumerate(fields)]
        filled = [F.col(f).isNotNull() for i, f in enumerate(fields) if bits >> i & 1]
        values = F.array(*within)
        every = F.lit(True)
        for x in filled:
            every = every & x
        return F.when(every, F.struct(F.lit(bits).alias("bits"), values.alias("values"), F.xxhash64(F.lit(bits), values).alias("key")))

    entries = F.filter(F.array(*(entry(b) for b in used)), lambda x: x.isNotNull())
    return points.withColumn("__entry", F.explode(entries)).select(*points.columns, "__entry.*")


def in_scopes(points: DataFrame, scopes: DataFrame, fields: Sequence[str], scope: Sequence[str], by: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """points with the scope's columns: one row for each scope that a point lies in.

    by: columns that points and scopes share and must agree in, such as the question whose scopes are meant. A scope that sets nothing
    takes every point (of its question). more: further columns of scopes to hand on. Keys are hashes, the values are compared in full.
    """
    # Without any scope, the combination of none, which meets nothing.
    used = fields_in_use(scopes, fields) or [0]
    keyed = scope_keys(scopes, fields, *by, *scope, *more)
    keyed = keyed.select(*(F.col(c).alias(f"__{c}") for c in by), *scope, *more, F.col("bits").alias("__bits"), F.col("values").alias("__values"), F.col("key").alias("__key"))
    rows = point_keys(points, fields, used)
    met = rows.join(keyed, [rows["key"] == keyed["__key"], rows["bits"] == keyed["__bits"], rows["values"] == keyed["__values"], *(rows[c] == keyed[f"__{c}"] for c in by)])
    return met.select(*points.columns, *scope, *more)
