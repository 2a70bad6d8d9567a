"""Quality levels and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text of more characters counts as of high quality.
HIGH_QUALITY_CHARS = 100


def search_quality(results: DataFrame, by: str, text: str = "text", url: str = "url") -> DataFrame:
    """(by, results, high, level): NONE without results (a null text is none), KEYWORD_SEARCH if a URL has a marker of it, HIGH_QUALITY if all are, else MIXED_QUALITY."""
    high = F.length(text) > HIGH_QUALITY_CHARS
    counted = results.groupBy(by).agg(F.count(text).alias("results"), F.count_if(high).alias("high"), F.coalesce(F.max(F.col(url).contains("local-search") | F.col(url).contains("keyword")), F.lit(False)).alias("keyword"))
    level = F.when(F.col("results") == 0, "NONE").when(F.col("keyword"), "KEYWORD_SEARCH").when(F.col("high") == F.col("results"), "HIGH_QUALITY").otherwise("MIXED_QUALITY")
    return counted.withColumn("level", level).drop("keyword")


def backlog_counters(files: DataFrame, run: str, status: str = "status") -> DataFrame:
    """Counts of a run by status, with conserved: inspected is processed, skipped and failed; eligible is that, pending and in progress."""
    n = lambda s: F.count_if(F.col(status) == s)
    names = ["processed", "skipped", "failed", "pending", "in_progress"]
    counted = files.groupBy(run).agg(F.count(F.lit(1)).alias("eligible"), *(n(s).alias(s) for s in names))
    inspected = F.col("processed") + F.col("skipped") + F.col("failed")
    out = counted.withColumn("inspected", inspected)
    return out.withColumn("conserved", F.col("eligible") == F.col("inspected") + F.col("pending") + F.col("in_progress"))


def percent_complete(done: Column, total: Column) -> Column:
    """0 to 100; 0 if there is nothing to do."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), done * 100.0 / total))).otherwise(0.0)


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def backoff_seconds(failures: Column, first: int = 60, most: int = 86400) -> Column:
    """Doubles from `first` with each failure after the first, up to `most`."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(40)))).cast("long")


def duration_seconds(x: Column, strict: bool = False) -> Column:
    """Of 1ms, 2d, 3h, 4m, 5s in either case, or plain seconds: whole numbers only; none is 0. Milliseconds are cut to seconds, of 1 at least.

    Anything else is null, or with strict ends the job with an error.
    """
    t = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    number, unit = (F.regexp_extract(t, r"^([0-9]+)\s*(ms|d|h|m|s)?$", i) for i in (1, 2))
    plain = t.rlike("^[0-9]+$")
    n = number.cast("long")
    seconds = F.when(unit == "ms", F.greatest(F.lit(1), F.floor(n / 1000))).when(unit == "d", n * 86400).when(unit == "h", n * 3600).when(unit == "m", n * 60).when((unit == "s") | plain, n)
    bad = F.raise_error(F.concat(F.lit("no duration: "), x)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(t == "", 0).when(number != "", seconds).otherwise(bad).cast("long")


# Months and days of HTTP dates.
MONTHS, DAYS = "jan feb mar apr may jun jul aug sep oct nov dec", "sun mon tue wed thu fri sat"
HTTP_DATE = r"(?i)^(?:(sun|mon|tue|wed|thu|fri|sat), )?([0-9]{1,2}) (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) ([0-9]{4}) ([0-9]{2}):([0-9]{2})(?::([0-9]{2}))? (gmt|[+-][0-9]{4})$"


def _or_error(value: Column, x: Column, what: str, strict: bool) -> Column:
    """value; where there is none of a filled x null, or with strict an error."""
    if not strict:
        return value
    return F.when((F.trim(F.coalesce(x, F.lit(""))) != "") & value.isNull(), F.raise_error(F.concat(F.lit(f"Invalid {what} header: "), F.trim(x)))).otherwise(value)


def reset_instant(x: Column, strict: bool = False) -> Column:
    """Of a reset header, as a timestamp: digits are seconds of the epoch, else an ISO-8601 instant. None for no header; for another text null, or with strict an error."""
    t = F.trim(x)
    instant = F.when(t.rlike(r"(?i)^[+-]?[0-9]{4,10}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$"), F.try_to_timestamp(t))
    return _or_error(F.when(t.rlike("^[0-9]+$"), F.timestamp_seconds(t.try_cast("long"))).otherwise(instant), x, "X-RateLimit-Reset", strict)


def http_date(x: Column) -> Column:
    """Of a date as in HTTP headers (RFC 1123): epoch seconds; null for another text, and if the day of the week is not the date's."""
    part = lambda i: F.regexp_extract(F.trim(x), HTTP_DATE, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    month = ((F.position(F.lower(part(3)), F.lit(MONTHS)) + 3) / 4).cast("int")
    date = F.try_to_timestamp(F.when(part(4) != "", F.concat_ws("-", part(4), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))), F.lit("yyyy-MM-dd"))
    seconds = number(5) * 3600 + number(6) * 60 + F.coalesce(number(7), F.lit(0))
    zone = F.when(F.lower(part(8)) == "gmt", 0).otherwise(F.concat(F.substring(part(8), 1, 1), F.lit("1")).try_cast("int") * (F.substring(part(8), 2, 2).try_cast("int") * 3600 + F.substring(part(8), 4, 2).try_cast("int") * 60))
    days = F.datediff(date.cast("date"), F.lit("1970-01-01").cast("date"))
    fits = (number(5) < 24) & (number(6) < 60) & (F.coalesce(number(7), F.lit(0)) < 60) & ((part(1) == "") | (F.position(F.lower(part(1)), F.lit(DAYS)) == F.dayofweek(date) * 4 - 3))
    return F.when(fits, days.cast("long") * 86400 + seconds - zone)


def retry_after_seconds(x: Column, now: Column, strict: bool = False) -> Column:
    """Of a Retry-After header: seconds, or those from now to an HTTP date, 0 if it has passed; 0 for no header; for another text null, or with strict an error."""
    t = F.trim(x)
    until = F.greatest(F.lit(0).cast("long"), F.floor(http_date(x) - F.unix_micros(now) / F.lit(1_000_000)).cast("long"))
    value = F.when(F.coalesce(t, F.lit("")) == "", F.lit(0).cast("long")).when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(http_date(x).isNotNull(), until)
    return _or_error(value, x, "Retry-After", strict)


def duration_text(seconds: Column) -> Column:
    """1d 0h 3m, 2h 0m or 0m: from the first part that is not 0 on, minutes always."""
    d, h, m = (x.cast("long").cast("string") for x in (F.floor(seconds / 86400), F.floor(F.pmod(seconds, F.lit(86400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)))
    minutes = F.concat(m, F.lit("m"))
    return F.when(seconds >= 86400, F.concat(d, F.lit("d "), h, F.lit("h "), minutes)).when(seconds >= 3600, F.concat(h, F.lit("h "), minutes)).otherwise(minutes)


def latest_reset_seconds(*headers: Column) -> Column:
    """The largest positive duration of several headers; null if none has one."""
    largest = F.greatest(*(F.coalesce(duration_seconds(h), F.lit(0)) for h in headers), F.lit(0).cast("long"))
    return F.when(largest > 0, largest)


def is_spam(honeypot: Column, rendered_at: Column, received_at: Column, least_ms: int = 3000) -> Column:
    """A form that has the hidden field filled, no time of rendering, or was sent sooner than a person could."""
    filled = F.trim(F.coalesce(honeypot, F.lit(""))) != ""
    return filled | F.coalesce(rendered_at <= 0, F.lit(True)) | F.coalesce(received_at - rendered_at < least_ms, F.lit(True))


def chunk_outcome(hashes: Column, total: Column, skipped: Column) -> Column:
    """(generated_none, skipped_all, valid) of a page's chunks: valid if no count is negative, none exceeds the total and every chunk has a hash."""
    valid = (total >= 0) & (skipped >= 0) & (skipped <= total) & (F.size(hashes) == total)
    return F.struct((total == 0).alias("generated_none"), ((total > 0) & (skipped == total)).alias("skipped_all"), valid.alias("valid"))


def run_totals(files: DataFrame, run: str) -> DataFrame:
    """(run, files, tokens, seconds, per_second) of files (seconds, tokens)."""
    out = files.groupBy(run).agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return out.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("files") / F.col("seconds")).otherwise(0.0))


def joined_notices(notices: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """(by, notice): texts in order, parted by semicolons. An answer's notices are few."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    return notices.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("notice"))
