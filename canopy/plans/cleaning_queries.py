"""Noise rules, the cleaning job and comparisons of text sets, over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions import cleaning as cf
from canopy.functions import noise
from canopy.functions import text as tx
from canopy.functions import tokens as tk
from canopy.functions.text import WORD, WS
from canopy.operators import cleaning as cl
from canopy.operators import near_copies
from canopy.plans.tables import COMMENTS_SQL, Catalog, comments, table, with_

catalog = Catalog()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = f"regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')"
_SQUEEZE = f"trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))"
LIGHT_SQL = f"""light AS (
  SELECT *, CASE
    WHEN text IS NULL THEN 'missing' WHEN length(t) < 3 THEN 'too_short'
    WHEN regexp_matches(t, {q(noise.NO_WORD)}) THEN 'no_word' WHEN regexp_matches(t, {q(noise.DIGITS)}) THEN 'digits'
    WHEN length(packed) >= 3 AND replace(packed, substr(packed, 1, 1), '') = '' THEN 'repeated'
    WHEN lower(t) IN ({", ".join(q(w) for w in vocab.INTERJECTIONS)}) THEN 'interjection'
    WHEN regexp_matches(t, {q(noise.NAME_TAG)}) AND regexp_matches(t, {q(noise.TWO_CHARS)}) THEN 'name_tag' END AS reason
  FROM (SELECT *, {_STRIP} AS t,
               regexp_replace(lower({_STRIP}), '[{WS}]+', '', 'g') AS packed FROM comments))"""
STRICT_SQL = f"""strict AS (
  SELECT *, CASE
    WHEN text IS NULL THEN 'missing' WHEN length(replace(low, ' ', '')) < 4 THEN 'too_short'
    WHEN NOT regexp_matches(low, {q(noise.LETTER)}) THEN 'no_letter' WHEN regexp_matches(low, {q(noise.LAUGH)}) THEN 'laughter'
    WHEN regexp_matches(low, {q(noise.LINK)}) THEN 'link' WHEN regexp_matches(low, {q(noise.SCHOOL)}) THEN 'school_page'
    WHEN regexp_matches(low, {q(noise.VN_HOST)}) THEN 'host'
    WHEN contains(low, '@') AND length(flat) - length(replace(flat, ' ', '')) + 1 <= 4 THEN 'mention'
    WHEN {" OR ".join(f"contains(low, {q(w)})" for w in vocab.SPAM_WORDS)} THEN 'spam_word'
    WHEN regexp_matches(flat, {q(noise.NAME_ONLY)}) THEN 'name_only'
    WHEN prefix <> '' AND (length(substr(flat, length(prefix) + 2)) < 30
         OR regexp_matches(substr(flat, length(prefix) + 2), {q(noise.EMOJI_TAIL)})) THEN 'name_prefix' END AS reason
  FROM (SELECT *, lower({_STRIP}) AS low, {_SQUEEZE} AS flat,
               regexp_extract({_SQUEEZE}, {q(noise.NAME_PREFIX)}, 1) AS prefix FROM comments))"""
_NORMAL = (f"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), {q(cf.CONTROL)}, '', 'g'), "
           f"{q(cf.ZERO_WIDTH)}, '', 'g'), '[{WS}]+', ' ', 'g'))")
_SPAM = rf"""(regexp_matches(text, '(?i)(^|[^{WORD}])(click|tap|nhấn)[{WS}]+(here|ngay|vào đây)([^{WORD}]|$)')
   OR regexp_matches(text, '(?i)http[s]?://(?:bit\.ly|tinyurl\.com|goo\.gl)/[^{WS}]+')
   OR regexp_matches(text, '(?i)(^|[^{WORD}])DM[{WS}]+me[{WS}]+for') OR regexp_matches(text, '(?i)nhắn tin[{WS}]+cho[{WS}]+tôi')
   OR len(regexp_extract_all(text, {q(cf.URL)})) >= 3
   OR (length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) > 0 AND length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))
       / length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) > 0.6))"""
MARKED_SQL = f"""base AS (
  SELECT *, {_NORMAL} AS clean_text, substr(sha256({_NORMAL}), 1, 16) AS text_hash,
         CASE WHEN text IS NULL OR text = '' THEN 'missing_field:text' WHEN length(text) < 2 THEN 'text_too_short' END AS bad
  FROM comments),
marked AS (
  SELECT *, CASE WHEN bad IS NOT NULL THEN bad
                 WHEN row_number() OVER (PARTITION BY text_hash, bad IS NULL ORDER BY seq) > 1 THEN 'exact_dup'
                 WHEN {_SPAM} THEN 'spam' ELSE 'clean' END AS status FROM base)"""
_PHONE, _EMAIL = q(cf.PHONE), q(cf.EMAIL)
REDACTED_SQL = f"""redacted AS (
  SELECT *, len(regexp_extract_all(clean_text, {_PHONE})) AS phones,
         len(regexp_extract_all(regexp_replace(clean_text, {_PHONE}, '{cf.PHONE_MARK}', 'g'), {_EMAIL})) AS emails,
         regexp_replace(regexp_replace(clean_text, {_PHONE}, '{cf.PHONE_MARK}', 'g'), {_EMAIL}, '{cf.EMAIL_MARK}', 'g') AS redacted
  FROM marked WHERE status = 'clean')"""


@catalog.add("f1_light_noise", with_(COMMENTS_SQL, LIGHT_SQL) + "SELECT comment_id, reason FROM light")
def f1_light_noise(spark, sf):
    return comments(spark, sf).select("comment_id", noise.light_reason(F.col("text")).alias("reason"))


@catalog.add("f2_strict_noise", with_(COMMENTS_SQL, STRICT_SQL) + "SELECT comment_id, reason FROM strict")
def f2_strict_noise(spark, sf):
    return comments(spark, sf).select("comment_id", noise.strict_reason(F.col("text")).alias("reason"))


@catalog.add("f1_f2_word_samples", with_(
    "tok AS (SELECT doc_id, unnest(string_split_regex(text, '[" + WS + "]+')) AS w FROM documents)",
    "pairs AS (SELECT doc_id, w FROM tok)",
    "comments AS (SELECT DISTINCT w AS text FROM pairs)", LIGHT_SQL,
    "both_rules AS (SELECT text, reason AS light FROM light)") + ", comments2 AS (SELECT text FROM comments), " +
    STRICT_SQL.replace("strict AS", "strict AS").replace("FROM comments)", "FROM comments2)") + """
SELECT coalesce(l.light, 'kept') AS light, coalesce(s.reason, 'kept') AS strict, count(*) AS n
FROM both_rules l JOIN strict s USING (text) GROUP BY ALL""")
def f1_f2_word_samples(spark, sf):
    """Both rules on every distinct word of every document: short texts reach the branches prose does not."""
    words = comments(spark, sf).select(F.explode(F.split("text", f"[{WS}]+")).alias("text")).distinct()
    return words.groupBy(
        F.coalesce(noise.light_reason(F.col("text")), F.lit("kept")).alias("light"),
        F.coalesce(noise.strict_reason(F.col("text")), F.lit("kept")).alias("strict")).agg(F.count("*").alias("n"))


@catalog.add("a3_noise_totals", with_(COMMENTS_SQL, LIGHT_SQL) + """
SELECT count(DISTINCT id_content) AS n_posts, count(*) AS n_raw, count(*) FILTER (reason IS NULL) AS n_clean,
       count(reason) AS n_trash, round(count(reason) / count(*), 9) AS trash_ratio FROM light""")
def a3_noise_totals(spark, sf):
    return cl.noise_totals(comments(spark, sf)).withColumn("trash_ratio", F.round("trash_ratio", 9))


@catalog.add("f4_validation", """
SELECT CASE WHEN text IS NULL OR text = '' THEN 'missing_field:text' WHEN length(text) < 2 THEN 'text_too_short'
            ELSE 'valid' END AS reason, count(*) AS n FROM documents GROUP BY ALL""")
def f4_validation(spark, sf):
    c = comments(spark, sf)
    return c.groupBy(F.coalesce(cl.invalid_reason(F.col("text")), F.lit("valid")).alias("reason")).agg(
        F.count("*").alias("n"))


@catalog.add("f5_spam", with_(COMMENTS_SQL) + f"SELECT comment_id, {_SPAM} AS is_spam FROM comments")
def f5_spam(spark, sf):
    return comments(spark, sf).select("comment_id", (F.size(cf.spam_reasons(F.col("text"))) > 0).alias("is_spam"))


@catalog.add("f3_quality_split", with_(COMMENTS_SQL, MARKED_SQL) + "SELECT comment_id, status, text_hash FROM marked")
def f3_quality_split(spark, sf):
    return cl.mark_records(comments(spark, sf)).select("comment_id", "status", "text_hash")


@catalog.add("f3_quarantine", with_(COMMENTS_SQL, MARKED_SQL) + """
SELECT status, count(*) AS n FROM marked WHERE status <> 'clean' GROUP BY ALL""")
def f3_quarantine(spark, sf):
    return cl.quarantine(cl.mark_records(comments(spark, sf))).groupBy("status").agg(F.count("*").alias("n"))


@catalog.add("f3_run_stats", with_(COMMENTS_SQL, MARKED_SQL) + """
SELECT count(*) AS total_input, count(*) FILTER (status IN ('missing_field:text', 'text_too_short')) AS schema_fail,
       count(*) FILTER (status = 'exact_dup') AS exact_dup_removed, 0::BIGINT AS cross_dup_removed,
       count(*) FILTER (status = 'spam') AS spam_removed, count(*) FILTER (status <> 'clean') AS total_quarantine,
       count(*) FILTER (status = 'clean') AS total_clean FROM marked""")
def f3_run_stats(spark, sf):
    return cl.run_stats(cl.mark_records(comments(spark, sf)))


@catalog.add("t4_normal_text", with_(COMMENTS_SQL) + f"SELECT comment_id, {_NORMAL} AS clean_text FROM comments")
def t4_normal_text(spark, sf):
    return comments(spark, sf).select("comment_id", cf.normal_text(F.col("text")).alias("clean_text"))


@catalog.add("t5_redaction", with_(COMMENTS_SQL, MARKED_SQL, REDACTED_SQL) + """
SELECT comment_id, redacted AS clean_text, phones::BIGINT AS phones, emails::BIGINT AS emails FROM redacted""")
def t5_redaction(spark, sf):
    c = cl.clean_records(cl.mark_records(comments(spark, sf)))
    return c.select("comment_id", "clean_text", F.col("phones").cast("long").alias("phones"),
                    F.col("emails").cast("long").alias("emails"))


@catalog.add("t6_record_key", """
SELECT page_id, 'fbh_' || substr(sha256(url || '|' || split_part(url, '/', 3) || '|' || substr(html, 1, 80)), 1, 16) AS key
FROM pages""")
def t6_record_key(spark, sf):
    key = tx.record_key(F.col("url"), F.split("url", "/")[2], F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("fbh_"), key).alias("key"))


_PRIOR_SQL = f"""prior AS (
  SELECT DISTINCT substr(sha256({_NORMAL}), 1, 16) AS text_hash FROM documents WHERE source IN ('src0', 'src1')),"""


@catalog.add("j13_cross_run_copies", with_(COMMENTS_SQL) + ",\n" + _PRIOR_SQL + MARKED_SQL + """
SELECT comment_id, CASE WHEN bad IS NULL AND (status = 'exact_dup' OR text_hash IN (SELECT text_hash FROM prior))
       THEN 'cross_run_dup' ELSE status END AS status FROM marked""")
def j13_cross_run_copies(spark, sf):
    """Two sources play the earlier run; every record is checked against their hashes."""
    c = comments(spark, sf)
    earlier = c.filter(F.col("id_content").isin("src0", "src1"))
    prior = cl.prior_hashes(earlier.withColumn("text_hash", tx.hash16(cf.normal_text(F.col("text")))))
    return cl.mark_records(c, prior=prior).select("comment_id", "status")


@catalog.add("j12_removed_texts", with_(COMMENTS_SQL, LIGHT_SQL) + """
SELECT comment_id FROM light WHERE t NOT IN (SELECT t FROM light WHERE reason IS NULL AND length(text) < 5000)""")
def j12_removed_texts(spark, sf):
    c = comments(spark, sf)
    kept = c.filter(~noise.is_light_noise(F.col("text")) & (F.length("text") < 5000))
    return cl.removed_rows(c, kept).select("comment_id")


_A = "SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0"
_B = "SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0"


@catalog.add("u3_overlap_report", f"""
WITH a AS ({_A}), b AS ({_B}), j AS (SELECT a.text AS l, b.text AS r FROM a FULL JOIN b ON a.text = b.text)
SELECT count(l) AS n_left, count(r) AS n_right, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n_both,
       count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only, count(*) AS n_union,
       round(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) / count(*), 9) AS jaccard FROM j""")
def u3_overlap_report(spark, sf):
    """Also A33: Jaccard of two id sets (even rows against every third row, compared by text)."""
    d = table(spark, sf, "documents")
    out = cl.overlap_report(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0"), "text")
    return out.withColumn("jaccard", F.round("jaccard", 9))


@catalog.add("u3_id_sets", """
SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def u3_id_sets(spark, sf):
    a = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "labels").select("doc_id")
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return (count(a.intersect(b), "both").unionByName(count(a.subtract(b), "documents only"))
            .unionByName(count(a.union(b).distinct(), "either")))


@catalog.add("t21_near_copies")
def t21_near_copies(spark, sf):
    """Order-dependent greedy filter: SQL would need one pass per kept text (tested by brute force)."""
    return near_copies.drop_near_copies(comments(spark, sf))


@catalog.add("t2_name_tags", with_("w AS (SELECT doc_id, text FROM documents)") + f"""
SELECT doc_id, CASE WHEN tag <> '' AND regexp_extract(tag, '^[^{WS}]+') IN ({", ".join(q(w) for w in vocab.NAME_STARTS)})
       AND length(rest) >= 3 THEN rest ELSE text END AS text
FROM (SELECT doc_id, text, tag, regexp_replace(substr(text, length(tag) + 1), '^[{WS}]+', '') AS rest
      FROM (SELECT doc_id, text, regexp_extract(text, {q(tk.NAME_TAG_PREFIX)}, 1) AS tag
            FROM (SELECT doc_id, 'Mai ' || text AS text FROM w)))""")
def t2_name_tags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Mai "), F.col("text")).alias("text"))
    return d.select("doc_id", tk.drop_name_tag(F.col("text")).alias("text"))
