"""Run manifests and session logs: audits, filters, listings, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.ordering import buckets, first_row, number_rows


def recent(runs: DataFrame, now: Column, since: str | None = None, script: str | None = None) -> DataFrame:
    """Runs started within '7d' / '24h' / '30m', and whose script name contains a text."""
    out = runs
    if script:
        out = out.filter(F.coalesce(F.contains("script", F.lit(script)), F.lit(False)))
    if since:
        seconds = int(since[:-1]) * {"d": 86400, "h": 3600, "m": 60}[since[-1]]
        out = out.filter(F.col("started_at") >= now - F.make_dt_interval(secs=F.lit(seconds)))
    return out


def by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def script_audit(runs: DataFrame) -> DataFrame:
    """Per script: runs, successes, failures, mean, median and p95 duration (negative and missing ones left out).

    The p95 is the exclusive 20-quantile for 20 or more durations, else the largest. It needs the values at two
    ranks only, so durations are ranked in buckets and two rows per script are kept; no list of durations is built.
    """
    r = runs.withColumn("script", F.coalesce("script", F.lit("unknown")))
    d = F.when(F.col("duration_s") >= 0, F.col("duration_s"))
    base = r.groupBy("script").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "failed").alias("failures"), F.count(d).alias("n"), F.avg(d).alias("mean"), F.max(d).alias("longest"))
    timed = r.filter("duration_s >= 0").select("script", "duration_s")
    values = timed.groupBy("script", "duration_s").agg(F.count("*").alias("k"))
    from canopy.operators.ordering import running_sum

    ranked = running_sum(values, ["script"], ["duration_s"], F.floor(F.log2(F.col("duration_s") + 1) * 64), F.col("k"), "upto").join(
        base.select("script", "n"), "script").withColumn("from_", F.col("upto") - F.col("k") + 1)
    at = lambda rank: F.max(F.when((F.col("from_") <= rank) & (rank <= F.col("upto")), F.col("duration_s")))
    m = F.col("n") + 1
    j = F.greatest(F.lit(1), F.least(F.floor(m * 19 / 20), F.col("n") - 1))
    picks = ranked.groupBy("script").agg(
        at(F.floor((F.col("n") + 1) / 2)).alias("mid_a"), at(F.ceil((F.col("n") + 1) / 2)).alias("mid_b"), at(j).alias("a"), at(j + 1).alias("b"))
    out = base.join(picks, "script", "left")
    delta = m * 19 - j * 20
    p95 = F.when(F.col("n") >= 20, (F.col("a") * (20 - delta) + F.col("b") * delta) / 20).otherwise(F.col("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("script", "runs", "successes", "failures", zero(F.col("mean")).alias("avg_s"),
                      zero((F.col("mid_a") + F.col("mid_b")) / 2).alias("p50_s"), zero(p95).alias("p95_s"))


def recent_failures(runs: DataFrame, now: Column) -> DataFrame:
    """Failures less than eight full days old."""
    age = F.floor((F.unix_micros(now) - F.unix_micros("started_at")) / F.lit(86_400_000_000))
    return runs.filter((F.col("status") == "failed") & (age <= 7))


def sessions(log: DataFrame) -> DataFrame:
    """Per session: processed, time, mean time per file, last status and remaining. log: session_id, started_at,
    processed, elapsed_seconds, remaining, stop_reason."""
    s = log.groupBy("session_id").agg(
        F.sum("processed").alias("processed"), F.sum("elapsed_seconds").alias("seconds"),
        F.max_by("stop_reason", F.struct("started_at", "seq")).alias("last_reason"), F.max_by("remaining", F.struct("started_at", "seq")).alias("remaining"))
    return s.withColumn("per_file", F.when(F.col("processed") > 0, F.col("seconds") / F.col("processed")).otherwise(0.0))


def posts_listing(rows: DataFrame) -> DataFrame:
    return rows.groupBy("post_url").agg(F.count("*").alias("comments"), F.max("scraped_at").alias("last_scraped"))


def reusable_job(jobs: DataFrame) -> DataFrame:
    """Newest job per (key, size) that has not failed."""
    return first_row(jobs.filter("status <> 'failed'"), ["job_key", "max_comments"], [F.col("created_at").desc(), F.col("job_id").desc()])


def queue_positions(jobs: DataFrame) -> DataFrame:
    """How many active or queued jobs stand before each queued one. jobs: job_id, created_at, status, seq (creation
    order)."""
    live = jobs.filter(F.col("status").isin("queued", "crawling", "analyzing"))
    return number_rows(live, [], ["seq"], buckets("seq"), "place").withColumn("ahead", F.col("place") - 1).drop("place").filter("status = 'queued'")
