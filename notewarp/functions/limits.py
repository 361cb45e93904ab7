"""Rate limiting, batch adaptation and retries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings

#: Parts of header names that tell about rate limits.
HEADER_TAGS = ("retry-after", "ratelimit", "rate-limit", "x-goog-", "x-ratelimit")
#: Ranges of keys that rows are dealt into to be numbered: hardly more than twice as many.
RANGES = 1024


def placed(rows: DataFrame, by: str, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``place``: how many rows with the same ``by`` come before by ``key``, nulls last, and then ``ties``.

    Rows are dealt by ``by`` and ranges of ``key``, numbered in each range, and the counts of the ranges before are added, so
    that no task gets all rows of one ``by`` unless they share one key. The ranges end at keys that a hash chooses: they are the
    same each time they are found, and where they end decides who does the work, not what comes out.
    """
    step = F.greatest(F.lit(1), F.floor(rows.agg(F.count(F.lit(1))).scalar() / RANGES).cast("long"))
    ends = rows.where(F.pmod(F.xxhash64(key), step) == 0).agg(F.sort_array(F.collect_set(key))).scalar()
    # how many ends the key has reached, to an octal digit at a time
    rows = rows.withColumns({"_ends": ends, "_range": F.lit(0)})
    for h in (512, 64, 8, 1):
        digit = [f"if(get(_ends, _range + {k * h - 1}) <= `{key}`, {h}, 0)" for k in range(1, 8)]
        rows = rows.withColumn("_range", F.expr(" + ".join(["_range", *digit])))
    rows = rows.withColumn("_range", F.when(F.col(key).isNull(), 4096).otherwise(F.col("_range"))).drop("_ends")
    up = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_by", "_of", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_range").orderBy(F.col(key).asc_nulls_last(), *ties)
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    rows = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return rows.withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_by", "_of", "_before")


def pace(calls: DataFrame, rpm: float, last: float = 0.0, by: tuple[str, ...] = (), order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Adds ``emit``: when each call (arrival in seconds, n items) may be sent.

    emit_i = max(arrival_i, emit_(i-1) + cost_i) with cost = n * 60 / rpm unrolls to S_i + max(last, max_(j<=i)(arrival_j - S_j)),
    S being the running cost: two window functions. ``by`` paces groups apart, on as many tasks.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.col("n") * F.lit(60.0 / max(rpm, 0.001))).over(w)
    calls = calls.withColumn("_spent", spent).withColumn("_slack", F.col("arrival") - F.col("_spent"))
    return calls.withColumn("emit", F.col("_spent") + F.greatest(F.lit(last), F.max("_slack").over(w))).drop("_spent", "_slack")


def adapt(calls: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = (), order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Adds (batch, failures, successes), the state after each call, to ordered calls with a boolean ``hit``: it was limited.

    A limited call shrinks the batch by the factor down to the least; after enough successes in a row it is restored. So
    the state is told by two counts, which windows give in time linear in the calls: successes since the last hit, and hits
    since the batch was last restored.
    """
    up = lambda *key: Window.partitionBy(*by, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = F.coalesce(F.col("hit"), F.lit(False))
    calls = calls.withColumn("_hits", one(hit).over(up())).withColumn("_calm", one(~hit).over(up("_hits")))
    restored = (F.col("_calm") == s.recovery) if s.recovery > 0 else F.lit(False)
    calls = calls.withColumn("_epoch", one(restored).over(up())).withColumn("failures", one(hit).over(up("_epoch")))
    ladder = [s.batch]
    while len(ladder) < 64 and (less := max(s.min_batch, int(ladder[-1] * s.factor))) != ladder[-1]:
        ladder.append(less)
    batch = F.get(F.array(*[F.lit(b) for b in ladder]), F.least(F.col("failures"), F.lit(len(ladder) - 1)).cast("int"))
    calm = F.col("_calm") % s.recovery if s.recovery > 0 else F.col("_calm")
    return calls.withColumns({"batch": batch, "successes": calm}).drop("_hits", "_calm", "_epoch")


def retryable(message: Column) -> Column:
    return message.contains("429") | message.contains("RESOURCE_EXHAUSTED")


def retry_after(headers: Column, now: Column) -> Column:
    """Seconds to wait by the first header named so that can be read, as a number or an HTTP date; else null."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]).contains("retry-after"))

    def seconds(v: Column) -> Column:
        at = F.try_to_timestamp(F.substr(v, F.lit(6)), F.lit("dd MMM yyyy HH:mm:ss z"))
        return F.coalesce(F.trim(v).try_cast("double"), F.greatest(F.lit(0.0), (F.unix_seconds(at) - now).cast("double")))

    # greatest() skips nulls, so a date that cannot be read must stay null by itself
    def read(v: Column) -> Column:
        is_date = F.try_to_timestamp(F.substr(v, F.lit(6)), F.lit("dd MMM yyyy HH:mm:ss z")).isNotNull()
        return F.when(F.trim(v).try_cast("double").isNotNull() | is_date, seconds(v))

    return F.get(F.filter(F.transform(named, lambda e: read(e["value"])), lambda x: x.isNotNull()), F.lit(0))


def backoff(attempt: Column, least: Column, s: Settings = Settings(), jitter: Column | None = None) -> Column:
    """Delay before the next attempt: exponential, capped, not under ``least``, times a jitter of 0.8 to 1.2."""
    jitter = F.lit(0.8) + F.rand() * 0.4 if jitter is None else jitter
    return F.greatest(F.least(F.lit(s.base_delay) * F.pow(F.lit(2.0), attempt), F.lit(s.max_delay)), least) * jitter


def limit_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: F.lower(k).rlike("|".join(HEADER_TAGS)))


def short_error(message: Column, most: int = 300) -> Column:
    return F.left(message, F.lit(most))


def token_estimate(length: Column) -> Column:
    return F.floor(length / 4).cast("long")
