"""Fitting evidence and conversation turns into a token budget, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: how a prompt begins of which something was left out.
NOTICE = "[Context truncated due to model input limit]\n\n"


def newest_that_fit(turns: DataFrame, by: str, order: str, tokens: str, budget: Column | int) -> DataFrame:
    """turns up to the first misfit, from the newest back. Tokens are not negative, so a running sum decides."""
    back = W.partitionBy(by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    return turns.withColumn("__sum", F.sum(tokens).over(back)).where(F.col("__sum") <= budget).drop("__sum")


def greedy_fit(items: Column, budget: Column) -> Column:
    """The items (structs with tokens) that fit one after the other; a misfit is skipped and the next one tried."""
    start = F.struct(budget.cast("long").alias("left"), F.slice(items, 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["left"]
        return F.when(fits, F.struct((acc["left"] - x["tokens"]).alias("left"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def fitted_prompt(prompts: DataFrame, limit: int) -> DataFrame:
    """For (id, system_tokens, query_tokens, docs, turns): id, docs and turns that are kept, minimal, error, truncated (whether anything was left out).

    docs: array of (index, url, text, tokens, priority), turns: array of (index, role, text, tokens), both in order. System and query are
    always in; if they alone fill the limit the prompt is minimal. HIGH documents come first, and if there are any, one at least must fit,
    else error; then turns from the newest back to the first misfit; then LOW documents. Kept documents are numbered anew, from 1, in
    their old order. A prompt's documents are a top-k and its turns one conversation, so rows are bounded.
    """
    used = F.col("system_tokens") + F.col("query_tokens")
    of = lambda p: F.filter("docs", lambda d: d["priority"] == p)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    a = prompts.withColumn("left0", F.greatest(F.lit(limit) - used, F.lit(0)).cast("long")).withColumn("minimal", used >= limit)
    b = a.withColumn("high", greedy_fit(of("HIGH"), F.col("left0"))).withColumn("left1", F.col("left0") - total(F.col("high")))
    start = F.struct(F.col("left1").alias("left"), F.lit(True).alias("open"), F.slice("turns", 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (x["tokens"] <= acc["left"])
        more = F.struct((acc["left"] - x["tokens"]).alias("left"), F.lit(True).alias("open"), F.concat(F.array(x), acc["kept"]).alias("kept"))
        return F.when(fits, more).otherwise(F.struct(acc["left"].alias("left"), F.lit(False).alias("open"), acc["kept"].alias("kept")))

    c = b.withColumn("kept_turns", F.aggregate(F.reverse("turns"), start, step, lambda acc: acc["kept"])).withColumn("left2", F.col("left1") - total(F.col("kept_turns")))
    d = c.withColumn("low", greedy_fit(of("LOW"), F.col("left2")))
    kept = F.array_sort(F.concat("high", "low"))
    numbered = F.transform(kept, lambda x, i: F.struct((i + 1).alias("index"), x["url"].alias("url"), x["text"].alias("text"), x["tokens"].alias("tokens"), x["priority"].alias("priority")))
    error = ~F.col("minimal") & (F.size(of("HIGH")) > 0) & (F.size("high") == 0)
    empty = lambda xs: F.when(F.col("minimal"), F.slice(xs, 1, 0)).otherwise(xs)
    truncated = F.col("minimal") | (F.size(kept) < F.size("docs")) | (F.size("kept_turns") < F.size("turns"))
    return d.select("id", empty(numbered).alias("docs"), empty(F.col("kept_turns")).alias("turns"), "minimal", error.alias("error"), truncated.alias("truncated"))


def noticed(prompt: Column, truncated: Column) -> Column:
    """The prompt, behind the notice if something was left out."""
    return F.when(truncated, F.concat(F.lit(NOTICE), prompt)).otherwise(prompt)


def render(system: Column, docs: Column, turns: Column, query: Column) -> Column:
    """System, documents as [CTX n] url and text, turns with a prefix for replies only, and the query, parted by blank lines. Without documents or turns nothing stands in their place."""
    contexts = F.transform(docs, lambda d: F.concat(F.lit("[CTX "), d["index"].cast("string"), F.lit("] "), d["url"], F.lit("\n"), d["text"]))
    said = F.transform(turns, lambda t: F.concat(F.when(t["role"] == "assistant", "Assistant: ").otherwise(""), t["text"]))
    return F.array_join(F.concat(F.array(system), contexts, said, F.array(query)), "\n\n")


def last_answer(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, answer): the text of the last turn whose trimmed, lower-cased role is assistant."""
    replies = turns.where(F.lower(F.trim("role")) == "assistant")
    return replies.groupBy(by).agg(F.max_by("text", "turn").alias("answer"))


def transcripts(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, transcript): ### User and ### Assistant blocks in order; whoever is not the user counts as the assistant. One conversation is one row."""
    block = F.concat(F.when(F.lower(F.trim("role")) == "user", "### User\n\n").otherwise("### Assistant\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", block.alias("block"))))
    return turns.groupBy(by).agg(ordered.alias("x")).select(by, F.array_join(F.transform("x", lambda t: t["block"]), "").alias("transcript"))
