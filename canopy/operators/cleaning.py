"""The cleaning job: validate, normalise, drop copies, drop spam, redact; one status per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import cleaning as cl
from canopy.functions.noise import is_light_noise
from canopy.functions.text import hash16, strip


def invalid_reason(c: Column) -> Column:
    return (F.when(c.isNull() | (c == ""), "missing_field:text").when(F.length(c) < 2, "text_too_short"))


def mark_records(df: DataFrame, seq: str = "seq", text: str = "text", prior: DataFrame | None = None,
                 compose: bool = True) -> DataFrame:
    """Every record with its normal text, hash, status and details.

    The first valid record of a hash stays, even if it is spam; later copies are duplicates. Hashes of an
    earlier run (prior.text_hash) make every record a copy. Copies are found by joining each hash's first
    sequence number back on the (unique) sequence, so a third of all rows being one text skews nothing.
    """
    t = F.col(text)
    rows = df.withColumn("_invalid", invalid_reason(t)).withColumn("clean_text", cl.normal_text(t, compose))
    rows = rows.withColumn("text_hash", hash16(F.col("clean_text")))
    valid = rows.filter("_invalid is null")
    firsts = valid.groupBy("text_hash").agg(F.min(seq).alias("_first"))
    if prior is not None:
        firsts = firsts.join(prior.select("text_hash").distinct(), "text_hash", "left_anti")
    firsts = firsts.select(F.col("_first"), F.lit(True).alias("_keep"))
    rows = rows.join(firsts, rows[seq] == firsts["_first"], "left").drop("_first")
    copy = "cross_run_dup" if prior is not None else "exact_dup"
    reasons = F.array_join(cl.spam_reasons(t), ",")
    status = (
        F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
        .when(F.col("_keep").isNull(), F.lit(copy))
        .when(reasons != "", F.lit("spam"))
        .otherwise("clean"))
    details = F.when(status == copy, F.col("text_hash")).when(status == "spam", reasons)
    return rows.withColumn("status", status).withColumn("details", details).drop("_invalid", "_keep")


def clean_records(marked: DataFrame) -> DataFrame:
    """Kept records with redacted text and how often each kind was redacted."""
    kept = marked.filter("status = 'clean'").drop("status", "details")
    no_phone = cl.redact_phones(F.col("clean_text"))
    kept = kept.withColumn("phones", cl.phones(F.col("clean_text"))).withColumn("clean_text", no_phone)
    return kept.withColumn("emails", cl.emails(F.col("clean_text"))).withColumn(
        "clean_text", cl.redact_emails(F.col("clean_text")))


def quarantine(marked: DataFrame) -> DataFrame:
    return marked.filter("status <> 'clean'").drop("clean_text", "text_hash")


def run_stats(marked: DataFrame) -> DataFrame:
    """One row of counts of a cleaning run."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return marked.agg(
        F.count("*").alias("total_input"), is_("missing_field:text", "text_too_short").alias("schema_fail"),
        is_("exact_dup").alias("exact_dup_removed"), is_("cross_run_dup").alias("cross_dup_removed"),
        is_("spam").alias("spam_removed"), F.count_if(F.col("status") != "clean").alias("total_quarantine"),
        is_("clean").alias("total_clean"))


def prior_hashes(clean: DataFrame, legacy_hash: bool = False, text: str = "clean_text") -> DataFrame:
    """Hashes an earlier run hands to the next one. legacy_hash recomputes them from the redacted text, which
    misses copies of redacted records."""
    h = hash16(cl.normal_text(F.col(text))) if legacy_hash else F.col("text_hash")
    return clean.select(h.alias("text_hash")).distinct()


def noise_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """Raw, clean and noise counts and the noise share (0 for no rows), in one pass."""
    noise = F.count_if(is_light_noise(F.col(text)))
    total = F.count("*")
    return df.agg(
        F.count_distinct("id_content").alias("n_posts"), total.alias("n_raw"), (total - noise).alias("n_clean"),
        noise.alias("n_trash"), F.when(total > 0, noise / total).otherwise(0.0).alias("trash_ratio"))


def removed_rows(raw: DataFrame, cleaned: DataFrame, text: str = "text") -> DataFrame:
    """Rows of raw whose trimmed text is absent from cleaned. Distinct texts decide, so copies cannot skew
    the comparison; rows find the verdict on their text by its hash."""
    digest = F.sha2(strip(F.col(text)), 256)
    key = lambda df, name: df.select(digest.alias(name), strip(F.col(text)).alias(f"{name}_t")).filter(F.col(name).isNotNull()).dropDuplicates([name])
    a, b = key(raw, "_a"), key(cleaned, "_b")
    gone = a.join(b, (F.col("_a") == F.col("_b")) & (F.col("_a_t") == F.col("_b_t")), "left_anti")
    return raw.withColumn("_h", digest).join(gone, (F.col("_h") == F.col("_a")) & (strip(F.col(text)) == F.col("_a_t")), "left_semi").drop("_h")


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets, of their intersection and differences, and their Jaccard index."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    out = both.agg(F.count_if(l).alias("n_left"), F.count_if(r).alias("n_right"), F.count_if(l & r).alias("n_both"),
                   F.count_if(l & ~r).alias("left_only"), F.count_if(r & ~l).alias("right_only"),
                   F.count("*").alias("n_union"))
    return out.withColumn("jaccard", F.when(F.col("n_union") > 0, F.col("n_both") / F.col("n_union")).otherwise(0.0))
