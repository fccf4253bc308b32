"""Writers: tables, flat exports, event documents, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from canopy.functions.text import record_key


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, replacing what is there; optionally one folder per value of a column."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def flat_records(raw: DataFrame, time_iso: Column, source_file: str) -> DataFrame:
    """Crawl records as flat text rows with a stable id. raw: post_url, type, author, author_id, profile_url, text,
    timestamp_raw, reactions_total, images (array of links), parent_comment_id, scraped_at."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    images = F.coalesce("images", F.array().cast("array<string>"))
    return raw.select(
        record_key(F.col("post_url"), F.col("author"), F.col("text")).alias("record_id"), s("post_url").alias("post_url"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("comment")).alias("type"), s("author").alias("author"), s("author_id").alias("author_id"),
        F.split(s("profile_url"), r"\?")[0].alias("profile_url"), s("text").alias("text"), s("timestamp_raw").alias("timestamp_raw"),
        F.coalesce(time_iso.cast("string"), F.lit("")).alias("time_iso"), s("reactions_total").alias("reactions_total"), F.size(images).alias("n_images"),
        F.array_join(F.transform(images, lambda x: F.coalesce(x, F.lit(""))), "|").alias("image_urls"), s("parent_comment_id").alias("parent_comment_id"),
        s("scraped_at").alias("scraped_at"), F.lit(source_file).alias("source_file"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """csv (with header), json (lines) or parquet."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.option("header", True).option("escape", '"').csv(path), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()


def write_events(full: DataFrame, summary: DataFrame, path: str) -> None:
    """Comments and summaries by domain; the full table first, so a summary means the event is complete. Each
    write is committed as a whole."""
    write_table(full, f"{path}/full", "domain")
    write_table(summary, f"{path}/summary", "domain")


def pending_events(events: DataFrame, full: DataFrame, summary: DataFrame) -> DataFrame:
    """Events not yet in both outputs."""
    done = full.select("event_id").distinct().join(summary.select("event_id").distinct(), "event_id")
    return events.join(done, "event_id", "left_anti")


def observed(df: DataFrame, noise: Column, name: str = "metrics") -> tuple[DataFrame, Observation]:
    """df with row counts measured while it is written: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("n_raw"), F.count_if(noise).alias("n_trash"), F.count_if(~noise).alias("n_clean")), seen
