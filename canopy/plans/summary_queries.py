"""Thread statistics, summaries and insights over documents with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import WS
from canopy.operators import documents, insights, summaries
from canopy.plans.tables import LABELLED_SQL, Catalog, labelled, table, with_

catalog = Catalog()
SHOW = vocab.LABELS["showbiz"]
_SHOW = ", ".join(f"'{x}'" for x in SHOW)
_L = with_(LABELLED_SQL)
# The same rows with education labels.
STANCE = {"Phẫn nộ": "tiêu cực", "Cà khịa": "trung lập", "Đồng cảm": "tích cực", "Ủng hộ": "ý kiến riêng", "Trung lập": "trung lập"}
STANCE_SQL = ("stance AS (SELECT * REPLACE (CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STANCE.items())
              + " END AS label) FROM labelled)")


def stance(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in STANCE.items() for x in kv])
    return labelled(spark, sf).withColumn("label", F.element_at(m, F.col("label")))


STATS_SQL = """per AS (
  SELECT event_id, root_id, label, count(*) AS n, count(*) FILTER (NOT is_trash) AS v,
         count(*) FILTER (NOT is_trash AND toxic) AS t FROM labelled GROUP BY ALL),
stats AS (
  SELECT event_id, root_id, sum(n)::BIGINT AS size, sum(v)::BIGINT AS total, sum(t)::BIGINT AS toxic_count,
         string_agg(label || '=' || v, ',' ORDER BY label) FILTER (label IS NOT NULL AND v > 0) AS labels,
         sum(v) > 1 AND coalesce(max(v) FILTER (label IS NOT NULL), 0) / sum(v) < 0.7 AS controversial
  FROM per GROUP BY ALL)"""


@catalog.add("a9_thread_stats", _L + ",\n" + STATS_SQL + """
SELECT event_id, root_id, size, total, toxic_count, coalesce(labels, '') AS labels, controversial FROM stats""")
def a9_thread_stats(spark, sf):
    s = summaries.thread_stats(labelled(spark, sf))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.withColumn("labels", shown).select("event_id", "root_id", "size", "total", "toxic_count", "labels", "controversial")


_TX = vocab.TOXIC_TYPES


@catalog.add("a10_emotion_summary", _L + """
SELECT event_id, count(*) FILTER (NOT is_trash) AS total_comments, count(*) FILTER (toxic) AS total_toxic,
""" + ", ".join(f"count(*) FILTER (label = '{x}') AS e{i}" for i, x in enumerate(SHOW)) + ", " +
             ", ".join(f"count(*) FILTER (toxic_type = '{x}') AS t{i}" for i, x in enumerate(_TX)) +
             " FROM labelled GROUP BY event_id")
def a10_emotion_summary(spark, sf):
    s = summaries.emotion_summary(labelled(spark, sf))
    return s.select("event_id", "total_comments", "total_toxic", *[F.col("emotion_stats")[x].alias(f"e{i}") for i, x in enumerate(SHOW)],
                    *[F.col("toxic_stats")[x].alias(f"t{i}") for i, x in enumerate(_TX)])


@catalog.add("a11_stance_summary", with_(LABELLED_SQL, STANCE_SQL) + """,
l AS (SELECT unnest(['tích cực', 'tiêu cực', 'trung lập', 'ý kiến riêng']) AS label),
ev AS (SELECT event_id, count(*) FILTER (is_trash) AS trash, count(*) FILTER (NOT is_trash) AS total_valid,
              count(*) AS total FROM stance GROUP BY ALL),
c AS (SELECT event_id, label, count(*) AS n FROM stance WHERE NOT is_trash GROUP BY ALL)
SELECT ev.event_id, total, trash, total_valid, l.label, coalesce(c.n, 0) AS "count",
       CASE WHEN total_valid > 0 THEN printf('%.1f%%', coalesce(c.n, 0) / total_valid * 100.0) ELSE '0%' END AS percent
FROM ev CROSS JOIN l LEFT JOIN c ON c.event_id = ev.event_id AND c.label = l.label""")
def a11_stance_summary(spark, sf):
    return summaries.stance_summary(stance(spark, sf))


@catalog.add("a12_label_sources", _L + "SELECT event_id, label_source, count(*) AS n FROM labelled GROUP BY ALL")
def a12_label_sources(spark, sf):
    return summaries.label_sources(labelled(spark, sf))


@catalog.add("a16_label_counts", _L + """, ev AS (SELECT DISTINCT event_id FROM labelled),
l AS (SELECT unnest([""" + _SHOW + """]) AS label)
SELECT ev.event_id, l.label, (SELECT count(*) FROM labelled x WHERE x.event_id = ev.event_id AND x.label = l.label) AS n
FROM ev CROSS JOIN l""")
def a16_label_counts(spark, sf):
    return summaries.label_counts(labelled(spark, sf), ["event_id"], SHOW)


_TOPQ = """ranked AS (
  SELECT *, likes + reply_count AS score, row_number() OVER (PARTITION BY event_id ORDER BY likes + reply_count DESC, seq) AS rank,
         row_number() OVER (PARTITION BY event_id, label ORDER BY likes + reply_count DESC, seq) AS lrank,
         row_number() OVER (PARTITION BY event_id, label ORDER BY likes DESC, seq) AS krank,
         row_number() OVER (PARTITION BY event_id, label ORDER BY length(text) DESC, seq) AS crank
  FROM labelled WHERE NOT is_trash AND level = 1)"""


@catalog.add("k3_popular_comments", _L + ",\n" + _TOPQ + "SELECT event_id, comment_id, score, rank FROM ranked WHERE rank <= 3")
def k3_popular_comments(spark, sf):
    return summaries.popular(labelled(spark, sf)).select("event_id", "comment_id", "score", F.col("rank").cast("long").alias("rank"))


@catalog.add("k4_best_per_label", _L + ",\n" + _TOPQ + "SELECT event_id, label, comment_id, score FROM ranked WHERE lrank = 1")
def k4_best_per_label(spark, sf):
    return summaries.best_per_label(labelled(spark, sf), SHOW).select("event_id", "label", "comment_id", "score")


@catalog.add("k5_examples", _L + ",\n" + _TOPQ + """
SELECT event_id, label, lrank AS rank, substr(text, 1, 150) AS example FROM ranked WHERE lrank <= 3""")
def k5_examples(spark, sf):
    return summaries.examples(labelled(spark, sf), SHOW).select("event_id", "label", F.col("rank").cast("long").alias("rank"), "example")


@catalog.add("k5_examples_by_likes", _L + ",\n" + _TOPQ + """
SELECT event_id, label, krank AS rank, substr(text, 1, 150) AS example FROM ranked WHERE krank <= 3""")
def k5_examples_by_likes(spark, sf):
    out = summaries.examples(labelled(spark, sf), SHOW, likes_only=True)
    return out.select("event_id", "label", F.col("rank").cast("long").alias("rank"), "example")


_CLIP = f"""CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, 400), '[{WS}]+$', '') || '…' END"""


@catalog.add("k6_longest_per_label", _L + ",\n" + _TOPQ + f"""
SELECT event_id, label, crank AS rank, {_CLIP} AS shown
FROM (SELECT *, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM ranked) WHERE crank <= 5""")
def k6_longest_per_label(spark, sf):
    return summaries.longest(labelled(spark, sf), SHOW).select("event_id", "label", F.col("rank").cast("long").alias("rank"), "shown")


@catalog.add("k7_largest_threads", _L + ",\n" + STATS_SQL + f""", top AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY size DESC, root_id) AS rank FROM stats)
SELECT top.event_id, top.root_id, top.size, rank, {_CLIP} AS root_text
FROM top LEFT JOIN (SELECT event_id, comment_id, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM labelled) r
  ON r.event_id = top.event_id AND r.comment_id = top.root_id WHERE rank <= 15""")
def k7_largest_threads(spark, sf):
    d = labelled(spark, sf)
    top = summaries.largest_threads(d, summaries.thread_stats(d))
    shown = F.col("root_text")
    has = d.select("event_id", F.col("comment_id").alias("root_id"), F.lit(True).alias("has"))
    return top.join(has, ["event_id", "root_id"], "left").select(
        "event_id", "root_id", "size", F.col("rank").cast("long").alias("rank"), F.when(F.col("has"), shown).alias("root_text"))


@catalog.add("a24_post_totals", _L + ",\n" + STATS_SQL + """,
n AS (SELECT event_id, count(*) AS comments, count(*) FILTER (level = 1) AS top_level, count(*) FILTER (level > 1) AS replies,
             count(*) FILTER (is_trash) AS trash, count(*) FILTER (NOT is_trash) AS valid, count(*) FILTER (toxic) AS toxic_total,
""" + ", ".join(f"count(*) FILTER (toxic_type = '{x}') AS toxic_{i}" for i, x in enumerate(_TX)) + """ FROM labelled GROUP BY ALL),
c AS (SELECT event_id, count(*) AS clusters, count(*) FILTER (controversial) AS controversial FROM stats GROUP BY ALL)
SELECT n.*, clusters, controversial, CASE WHEN valid > 0 THEN printf('%.3f', toxic_total / valid)::DOUBLE ELSE 0 END AS toxic_ratio
FROM n JOIN c USING (event_id)""")
def a24_post_totals(spark, sf):
    d = labelled(spark, sf)
    return summaries.post_totals(d, summaries.thread_stats(d))


@catalog.add("k11_representative", _L + ",\n" + _TOPQ + """,
cand AS (SELECT event_id, comment_id, text, label, list_position([""" + _SHOW + """], label) AS pos FROM ranked WHERE lrank = 1
         UNION ALL SELECT event_id, comment_id, text, label, 100 + rank FROM ranked WHERE rank <= 3),
once AS (SELECT *, row_number() OVER (PARTITION BY event_id, comment_id ORDER BY pos) AS d FROM cand),
texts AS (SELECT *, row_number() OVER (PARTITION BY event_id, text ORDER BY pos) AS d2 FROM once WHERE d = 1)
SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1)::INTEGER AS i, comment_id, label FROM texts WHERE d2 = 1
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY pos) <= 12""")
def k11_representative(spark, sf):
    d = labelled(spark, sf)
    place = F.array_position(F.array(*map(F.lit, SHOW)), F.col("label"))
    best = summaries.best_per_label(d, SHOW).select("event_id", "comment_id", "text", "label", place.cast("int").alias("pos"))
    top = summaries.popular(d).select("event_id", "comment_id", "text", "label", (F.col("rank") + 100).alias("pos"))
    return summaries.representative(best.unionByName(top)).select("event_id", "i", "comment_id", "label")


@catalog.add("a30_display_distribution", _L + """,
c AS (SELECT event_id, lower(label) AS label, count(*) AS n FROM labelled WHERE NOT is_trash AND label <> 'Trung lập' GROUP BY ALL),
v AS (SELECT event_id, count(*) FILTER (NOT is_trash) AS valid FROM labelled GROUP BY ALL),
k AS (SELECT event_id, sum(n)::BIGINT AS classified FROM c GROUP BY ALL),
g AS (SELECT * FROM c UNION ALL SELECT event_id, 'chưa phân loại', valid - classified FROM v JOIN k USING (event_id) WHERE valid > classified)
SELECT event_id, label, n, valid, round(n / valid * 100, 6) AS percent FROM g JOIN v USING (event_id)""")
def a30_display_distribution(spark, sf):
    """Declared totals count every valid comment; the neutral label is left out of the counts on purpose, so a
    remainder row appears."""
    d = labelled(spark, sf).filter("not is_trash")
    total = d.groupBy("event_id").agg(F.count("*").alias("declared"))
    c = d.filter("label <> 'Trung lập'").groupBy("event_id", "label").agg(F.count("*").alias("n")).join(total, "event_id")
    out = summaries.normal_distribution(c.withColumn("domain", F.lit("showbiz")), {})
    return out.select("event_id", "label", "n", "valid", F.round("percent", 6).alias("percent"))


# --- insights ------------------------------------------------------------------------------------
# Web events are the (lang, source) pairs; src3 has no analysis yet.
EVENTS_SQL = """web AS (
  SELECT lang || '_' || source AS id_content, CASE WHEN lang = 'en' THEN 'showbiz' ELSE 'education' END AS domain,
         'Event ' || source AS ten_su_kien, CASE WHEN source <> 'src5' THEN (2018 + min(doc_id) % 7) || '-01' END AS time_event
  FROM documents GROUP BY lang, source),
sums AS (
  SELECT domain || '_' || event_id AS id_content, count(*) AS total, count(*) FILTER (NOT is_trash) AS clean,
         count(*) FILTER (is_trash) AS trash FROM labelled WHERE event_id <> 'src3' GROUP BY ALL),
events_ AS (SELECT web.*, total, clean, trash, sums.id_content IS NOT NULL AS analysed FROM web LEFT JOIN sums USING (id_content))"""
_E = with_(LABELLED_SQL, EVENTS_SQL)


def web_events(spark, sf):
    d = table(spark, sf, "documents")
    w = d.groupBy("lang", "source").agg(F.min("doc_id").alias("m"))
    return w.select(
        F.concat_ws("_", "lang", "source").alias("id_content"), F.when(F.col("lang") == "en", "showbiz").otherwise("education").alias("domain"),
        F.concat(F.lit("Event "), "source").alias("ten_su_kien"),
        F.when(F.col("source") != "src5", F.concat((F.col("m") % 7 + 2018).cast("string"), F.lit("-01"))).alias("time_event"))


def event_sums(spark, sf):
    return labelled(spark, sf).filter("event_id <> 'src3'").groupBy(F.concat_ws("_", "domain", "event_id").alias("id_content")).agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_trash")).alias("clean"), F.count_if("is_trash").alias("trash"))


def events(spark, sf):
    m = insights.merge_analysis(web_events(spark, sf), event_sums(spark, sf), ["total", "clean", "trash"])
    return m.select("id_content", "domain", "ten_su_kien", "time_event", F.col("analyzed").isNotNull().alias("analysed"), "analyzed.*")


@catalog.add("j1_merged_events", _E + "SELECT id_content, domain, time_event, total, clean, trash, analysed FROM events_")
def j1_merged_events(spark, sf):
    return events(spark, sf).select("id_content", "domain", "time_event", "total", "clean", "trash", "analysed")


@catalog.add("j1_unknown_summaries", _E + """
SELECT id_content, total FROM sums WHERE id_content NOT IN (SELECT id_content FROM web WHERE id_content NOT LIKE '%src7')""")
def j1_unknown_summaries(spark, sf):
    web = web_events(spark, sf).filter(~F.col("id_content").endswith("src7"))
    return insights.unknown_summaries(web, event_sums(spark, sf)).select("id_content", "total")


_TOTALS = """count(*) AS total_events, count(*) FILTER (analysed) AS events_with_analysis,
 count(*) FILTER (NOT analysed) AS events_without_analysis, coalesce(sum(total), 0)::BIGINT AS total_raw,
 coalesce(sum(clean), 0)::BIGINT AS total_clean, coalesce(sum(trash), 0)::BIGINT AS total_trash,
 CASE WHEN sum(total) > 0 THEN printf('%.1f%%', sum(trash) / sum(total) * 100.0) ELSE '0%' END AS trash_rate"""


@catalog.add("a13_a15_domain_totals", _E + f"SELECT domain, {_TOTALS} FROM events_ GROUP BY ROLLUP (domain)")
def a13_a15_domain_totals(spark, sf):
    """Both domains and the overall row (A13, A14, A15)."""
    return insights.domain_totals(events(spark, sf))


@catalog.add("a13_events_by_year", _E + """
SELECT domain, coalesce(substr(time_event, 1, 4), 'unknown') AS year, count(*) AS n FROM events_ GROUP BY ALL""")
def a13_events_by_year(spark, sf):
    return insights.events_by_year(events(spark, sf))


@catalog.add("a14_label_distribution", _L + """, c AS (SELECT domain, label, count(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY ALL)
SELECT domain, label, n AS "count", printf('%.1f%%', n / sum(n) OVER (PARTITION BY domain) * 100.0) AS percent FROM c""")
def a14_label_distribution(spark, sf):
    d = labelled(spark, sf).filter("label is not null")
    return insights.label_distribution(d.groupBy("domain", "event_id", "label").agg(F.count("*").alias("n")))


@catalog.add("a14_toxic_distribution", _L + """,
k AS (SELECT domain, count(*) FILTER (NOT is_trash) AS clean FROM labelled GROUP BY ALL)
SELECT domain, toxic_type, count(*) AS "count", printf('%.1f%%', count(*) / any_value(clean) * 100.0) AS percent
FROM labelled JOIN k USING (domain) WHERE toxic_type IS NOT NULL GROUP BY domain, toxic_type""")
def a14_toxic_distribution(spark, sf):
    d = labelled(spark, sf)
    c = d.filter("toxic_type is not null").groupBy("domain", "toxic_type").agg(F.count("*").alias("n"))
    return insights.toxic_distribution(c, d.groupBy("domain").agg(F.count_if(~F.col("is_trash")).alias("total_clean")))


_TOPE = _E + """, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY clean DESC, id_content) AS rank FROM events_ WHERE analysed)"""


@catalog.add("k2_top_events", _TOPE + "SELECT domain, id_content, clean, rank FROM r WHERE rank <= 10")
def k2_top_events(spark, sf):
    """Also W5 (hot rank)."""
    return insights.top_events(events(spark, sf)).select("domain", "id_content", "clean", F.col("rank").cast("long").alias("rank"))


@catalog.add("a36_top_report", _TOPE + """
SELECT domain, rank || '. ' || ten_su_kien || ' (' || total || ', ' || clean || ', ' || trash || ')' AS line FROM r WHERE rank <= 5""")
def a36_top_report(spark, sf):
    """Report lines of the five largest events per domain."""
    t = insights.top_events(events(spark, sf), 5)
    return t.select("domain", F.format_string("%d. %s (%d, %d, %d)", "rank", "ten_su_kien", "total", "clean", "trash").alias("line"))


@catalog.add("a31_next_ids", """
SELECT lang AS domain, max(doc_id) AS last, lang || '_' || CASE WHEN max(doc_id) + 1 < 1000 THEN lpad((max(doc_id) + 1)::VARCHAR, 3, '0')
       ELSE (max(doc_id) + 1)::VARCHAR END AS next_id FROM documents GROUP BY lang""")
def a31_next_ids(spark, sf):
    return insights.next_ids(table(spark, sf, "documents").select(F.concat_ws("_", "lang", "doc_id").alias("id_content")))


@catalog.add("f9_domain_by_prefix", """
SELECT CASE WHEN starts_with(p, 'educ') THEN 'education' WHEN starts_with(p, 'show') THEN 'showbiz' END AS domain, count(*) AS n
FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'education_' WHEN 1 THEN 'showbiz_' ELSE 'other_' END AS p FROM documents) GROUP BY ALL""")
def f9_domain_by_prefix(spark, sf):
    from canopy.operators.serving import domain_of

    ids = table(spark, sf, "documents").select(F.concat(
        F.when(F.col("doc_id") % 3 == 0, "education_").when(F.col("doc_id") % 3 == 1, "showbiz_").otherwise("other_"), "doc_id").alias("id"))
    return ids.groupBy(domain_of(F.col("id")).alias("domain")).agg(F.count("*").alias("n"))


# --- event documents: maps and lists are shown as text, in the order of their keys ------------------
_SRC = """src AS (SELECT event_id, string_agg(label_source || '=' || n, ',' ORDER BY label_source) AS sources
  FROM (SELECT event_id, label_source, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY event_id)"""


def _shown(m: str, value=lambda v: v.cast("string")):
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ","), F.lit(""))


@catalog.add("s12_showbiz_documents", _L + ",\n" + _TOPQ + ",\n" + _SRC + """,
l AS (SELECT unnest([""" + _SHOW + """]) AS label), x AS (SELECT unnest([""" + ", ".join(f"'{t}'" for t in _TX) + """]) AS t),
ev AS (SELECT event_id, count(*) FILTER (NOT is_trash) AS total_comments, count(*) FILTER (toxic) AS total_toxic FROM labelled GROUP BY ALL),
em AS (SELECT ev.event_id, string_agg(l.label || '=' || (SELECT count(*) FROM labelled c WHERE c.event_id = ev.event_id AND c.label = l.label), ',' ORDER BY l.label) AS emotions
       FROM ev CROSS JOIN l GROUP BY ev.event_id),
tx AS (SELECT ev.event_id, x.t AS k, (SELECT count(*) FROM labelled c WHERE c.event_id = ev.event_id AND c.toxic_type = x.t) AS n FROM ev CROSS JOIN x
       UNION ALL SELECT event_id, 'total_toxic', total_toxic FROM ev),
tt AS (SELECT event_id, string_agg(k || '=' || n, ',' ORDER BY k) AS toxic FROM tx GROUP BY event_id),
po AS (SELECT event_id, string_agg(comment_id || '/' || score || '/' || label || '/' || md5(text), ',' ORDER BY rank) AS popular FROM ranked WHERE rank <= 3 GROUP BY event_id),
be AS (SELECT event_id, string_agg(label || '=' || comment_id || '/' || score, ',' ORDER BY label) AS best FROM ranked WHERE lrank = 1 AND label IS NOT NULL GROUP BY event_id)
SELECT ev.event_id, total_comments, sources, emotions, toxic, coalesce(popular, '') AS popular, coalesce(best, '') AS best
FROM ev JOIN src USING (event_id) JOIN em USING (event_id) JOIN tt USING (event_id) LEFT JOIN po USING (event_id) LEFT JOIN be USING (event_id)""")
def s12_showbiz_documents(spark, sf):
    """Event documents of one domain, nested fields shown as text."""
    d = documents.showbiz_documents(labelled(spark, sf))
    top = F.transform("top_comments.most_popular", lambda c: F.concat_ws("/", c["comment_id"], c["score"].cast("string"), c["emotion"], F.md5(c["text"])))
    return d.select("event_id", "total_comments", _shown("label_sources").alias("sources"), _shown("emotion_stats").alias("emotions"), _shown("toxic_stats").alias("toxic"),
                    F.coalesce(F.array_join(top, ","), F.lit("")).alias("popular"),
                    _shown("top_comments.by_emotion", lambda v: F.concat_ws("/", v["comment_id"], v["score"].cast("string"))).alias("best"))


@catalog.add("s12_education_documents", with_(LABELLED_SQL, STANCE_SQL) + ",\n" + _SRC.replace("FROM labelled", "FROM stance") + """,
l AS (SELECT unnest(['tích cực', 'tiêu cực', 'trung lập', 'ý kiến riêng']) AS label),
ev AS (SELECT event_id, count(*) FILTER (is_trash) AS trash, count(*) FILTER (NOT is_trash) AS valid, count(*) AS total FROM stance GROUP BY ALL),
g AS (SELECT ev.event_id, valid, l.label, (SELECT count(*) FROM stance c WHERE c.event_id = ev.event_id AND NOT c.is_trash AND c.label = l.label) AS n FROM ev CROSS JOIN l),
k AS (SELECT event_id, replace(label, ' ', '_') AS k, n FROM g UNION ALL SELECT event_id, 'total', total FROM ev UNION ALL SELECT event_id, '""" + vocab.TRASH + """', trash FROM ev),
cn AS (SELECT event_id, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM k GROUP BY event_id),
r AS (SELECT event_id, label, text, row_number() OVER (PARTITION BY event_id, label ORDER BY likes + reply_count DESC, seq) AS rank FROM stance WHERE NOT is_trash AND level = 1),
e AS (SELECT event_id, label, string_agg(md5(substr(text, 1, 150)), '+' ORDER BY rank) AS shown FROM r WHERE rank <= 3 GROUP BY ALL),
a AS (SELECT event_id, string_agg(label || '=' || n || '/' || CASE WHEN valid > 0 THEN printf('%.1f%%', n / valid * 100.0) ELSE '0%' END || '//' || coalesce(shown, ''), ',' ORDER BY label) AS analysis
      FROM g LEFT JOIN e USING (event_id, label) GROUP BY event_id)
SELECT event_id, sources, counts, analysis FROM cn JOIN a USING (event_id) JOIN src USING (event_id)""")
def s12_education_documents(spark, sf):
    d = documents.education_documents(stance(spark, sf))
    one = lambda v: F.concat(v["count"].cast("string"), F.lit("/"), v["percent"], F.lit("/"), v["summary"], F.lit("/"), F.array_join(F.transform(v["examples"], F.md5), "+"))
    return d.select("event_id", _shown("label_sources").alias("sources"), _shown("comment_counts").alias("counts"), _shown("analysis", one).alias("analysis"))


@catalog.add("s12_clusters", _L + ",\n" + STATS_SQL + """
SELECT s.event_id, s.root_id, size, total, toxic_count, controversial, coalesce(md5(c.text), md5('')) AS root_text, '' AS summary
FROM stats s LEFT JOIN labelled c ON c.event_id = s.event_id AND c.comment_id = s.root_id""")
def s12_clusters(spark, sf):
    c = documents.clusters(labelled(spark, sf))
    return c.select("event_id", "root_id", "size", "total", "toxic_count", "controversial", F.md5("root_text").alias("root_text"), "summary")
