"""What an embedding service answers: whether batches came whole, vectors in the order asked for, schemas of tables of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_schema(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """table, if it has all columns with the types given (names as Spark writes them); else an error that names every fault. Reads no rows."""
    types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    faults = [f"{name}: {types.get(name, 'missing')}, not {kind}" for name, kind in columns.items() if types.get(name) != kind]
    if faults:
        raise ValueError("; ".join(faults))
    return table


def vector_faults(batches: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """(batch, expected, received, fault, position, length) of batches (batch, expected) whose vectors (batch, position, vector) can't be used.

    fault is count if another number came than expected, none included; else that of the first bad position: null, or dimension for a vector of
    another length. Counts are made before the shuffle, so a batch that holds most rows is no hot key.
    """
    length = F.when(F.col("vector").isNotNull(), F.size("vector"))
    bad = F.when(F.col("vector").isNull(), "null").when(length != dimension, "dimension")
    first = F.min(F.when(bad.isNotNull(), F.struct("position", bad.alias("fault"), length.alias("length"))))
    came = vectors.groupBy("batch").agg(F.count(F.lit(1)).alias("received"), first.alias("first"))
    joined = batches.join(came, "batch", "left").withColumn("received", F.coalesce("received", F.lit(0).cast("long")))
    whole = F.col("received") == F.col("expected")
    judged = joined.select(
        "batch",
        "expected",
        "received",
        F.when(whole, F.col("first.fault")).otherwise("count").alias("fault"),
        F.when(whole, F.col("first.position")).alias("position"),
        F.when(whole, F.col("first.length")).alias("length"),
    )
    return judged.where("fault IS NOT NULL")


def declared_order(responses: DataFrame, entries: DataFrame) -> DataFrame:
    """(response, fault, at, vectors) of responses (response, expected), with the vectors of entries (response, entry, index, vector) by declared index.

    An entry without an index stands at its own number. The fault is that of the first entry that lies out of bounds, repeats an index, or has no
    numbers (bounds, duplicate, empty; at: its number); else missing, at the first index without a vector; a response without
    entries: none. Without a fault it is null and vectors are in order. A response answers one request, so its entries are few.
    """
    place = F.coalesce("index", "entry").cast("int")
    item = F.struct(F.col("entry").cast("int").alias("entry"), place.alias("place"), "vector")
    of_response = entries.groupBy("response").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = responses.join(of_response, "response", "left").withColumn("places", F.transform("items", lambda x: x["place"]))

    def judged(x, i):
        out_of_bounds = (x["place"] < 0) | (x["place"] >= F.col("expected"))
        before = F.array_position("places", x["place"]) <= i
        no_numbers = F.coalesce(F.size(x["vector"]), F.lit(0)) <= 0
        return F.struct(x["entry"].alias("at"), F.when(out_of_bounds, "bounds").when(before, "duplicate").when(no_numbers, "empty").alias("fault"))

    first = F.get(F.filter(F.transform("items", judged), lambda x: x["fault"].isNotNull()), F.lit(0))
    missing = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("expected").cast("int") - 1), "places"))
    faults = joined.withColumn("first", first).withColumn("missing", missing)
    fault = F.when(F.col("items").isNull(), "none").otherwise(F.coalesce("first.fault", F.when(F.col("missing").isNotNull(), "missing")))
    ordered = F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x["place"].alias("place"), x["vector"].alias("vector")))), lambda x: x["vector"])
    out = faults.withColumn("fault", fault)
    at = F.when(F.col("items").isNotNull(), F.coalesce("first.at", "missing"))
    return out.select("response", "fault", at.alias("at"), F.when(F.col("fault").isNull(), ordered).alias("vectors"))
