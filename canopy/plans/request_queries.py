"""Label requests and responses over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import requests as rq
from canopy.operators import tree
from canopy.plans.cleaning_queries import STRICT_SQL
from canopy.plans.tables import THREADS_SQL, Catalog, threads, with_
from canopy.plans.tree_queries import ROOTS_SQL
from canopy.session import cut

catalog = Catalog()

_RULE = STRICT_SQL.replace("FROM comments)", "FROM threads)")
SIZES_SQL = ("WITH RECURSIVE " + THREADS_SQL + ",\n" + ROOTS_SQL + ",\n" + _RULE + """,
sizes AS (
  SELECT w.event_id, w.root_id, count(*) AS size, count(*) FILTER (s.reason IS NULL) AS asked,
         min(CASE WHEN w.comment_id = w.root_id THEN s.seq END) AS seq
  FROM walk w JOIN strict s ON s.event_id = w.event_id AND s.comment_id = w.comment_id GROUP BY ALL),
need AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS pos FROM sizes WHERE asked > 0),
pack AS (
  SELECT event_id, root_id, size, pos, 1::BIGINT AS batch, size AS fill FROM need WHERE pos = 1
  UNION ALL SELECT n.event_id, n.root_id, n.size, n.pos,
         CASE WHEN p.fill + n.size > 60 THEN p.batch + 1 ELSE p.batch END,
         CASE WHEN p.fill + n.size > 60 THEN n.size ELSE p.fill + n.size END
  FROM pack p JOIN need n ON n.event_id = p.event_id AND n.pos = p.pos + 1)""")


def built(spark, sf):
    """Threads with rule noise, staged: several steps read them, and the noise rules are the dear part."""
    return cut(rq.add_rule_noise(tree.build_threads(threads(spark, sf)).drop("parent_id")), "built")


def built_text(spark, sf):
    return built(spark, sf)


@catalog.add("f17_threads_to_label", SIZES_SQL + "SELECT event_id, root_id, size, asked FROM sizes WHERE asked > 0")
def f17_threads_to_label(spark, sf):
    return rq.thread_sizes(built(spark, sf)).filter("asked > 0").select("event_id", "root_id", "size", "asked")


@catalog.add("w9_packed_requests", SIZES_SQL + "SELECT event_id, root_id, size, batch FROM pack")
def w9_packed_requests(spark, sf):
    return rq.pack_threads(rq.thread_sizes(built(spark, sf))).select("event_id", "root_id", "size", "batch")


def domains(t):
    even = F.expr("cast(substr(event_id, 2) as int) % 2 = 0")
    return t.select("event_id").distinct().withColumn("domain", F.when(even, "education").otherwise("showbiz"))


@catalog.add("a27_expected_requests", SIZES_SQL + """,
n AS (SELECT event_id, count(*) AS comments, count(*) FILTER (parent_id IS NULL) AS clusters,
             count(*) FILTER (reason IS NOT NULL) AS rule_trash FROM strict GROUP BY ALL),
b AS (SELECT event_id, max(batch) AS batches FROM pack GROUP BY ALL)
SELECT n.*, coalesce(batches, 0) AS batches, CASE WHEN substr(event_id, 2)::INT % 2 = 0 THEN 'education' ELSE 'showbiz' END AS domain,
       coalesce(batches, 0) + CASE WHEN substr(event_id, 2)::INT % 2 = 0 AND batches > 0 THEN 1 ELSE 0 END AS requests
FROM n LEFT JOIN b USING (event_id)""")
def a27_expected_requests(spark, sf):
    t = built(spark, sf)
    return rq.expected_requests(t, rq.pack_threads(rq.thread_sizes(t)), domains(t))


def members(spark, sf):
    t = built(spark, sf)
    packed = rq.pack_threads(rq.thread_sizes(t))
    return t, packed, rq.request_members(t, packed).join(domains(t), "event_id")


def answers(m):
    """Responses as a model might give them, from the members themselves: codes in turn, some fenced, some cut
    off, some with an unknown label."""
    pick = F.abs(F.xxhash64("comment_id")) % 6
    code = F.when(F.col("domain") == "showbiz", F.element_at(F.array(*map(F.lit, ["PN", "CK", "DC", "UH", "TL", "??"])), (pick + 1).cast("int"))
                  ).otherwise(F.element_at(F.array(*map(F.lit, ["TC", "TI", "TL", "YK", "tích cực", "??"])), (pick + 1).cast("int")))
    field = F.when(F.col("domain") == "showbiz", "emotion").otherwise("stance")
    item = F.concat(F.lit('{"id":"'), F.col("local_id"), F.lit('","is_trash":false,"'), field, F.lit('":"'), code,
                    F.lit('","toxic":'), (pick == 1).cast("string"), F.lit(',"toxic_type":"CB"}'))
    per = m.groupBy("event_id", "batch", "k").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("items"))
    group = F.concat(F.lit('{"cluster":"K'), F.col("k"), F.lit('","summary":"thread '), F.col("k"), F.lit('","comments":['), "items", F.lit("]}"))
    body = per.groupBy("event_id", "batch").agg(F.array_join(F.sort_array(F.collect_list(group)), ",").alias("b"))
    text = F.concat(F.lit('{"clusters":['), "b", F.lit("]}"))
    kind = F.abs(F.xxhash64("event_id", "batch")) % 3
    return body.select("event_id", "batch", F.when(kind == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(
        kind == 1, F.substr(text, F.lit(1), F.length(text) - 150)).otherwise(text).alias("response"))


@catalog.add("t25_request_lines")
def t25_request_lines(spark, sf):
    """Request texts per event and batch (contents are checked in the tests)."""
    t, packed, m = members(spark, sf)
    events = domains(t).select("event_id", "domain", F.col("event_id").alias("event_name"), F.lit("bài").alias("post_content"))
    return rq.request_texts(rq.request_lines(m), events)


@catalog.add("t14_read_labels")
def t14_read_labels(spark, sf):
    _, _, m = members(spark, sf)
    return rq.read_labels(answers(m), m).select("event_id", "comment_id", "is_trash", "label", "toxic", "toxic_type", "label_source")


@catalog.add("t14_read_summaries")
def t14_read_summaries(spark, sf):
    _, _, m = members(spark, sf)
    return rq.read_summaries(answers(m), m)


@catalog.add("a28_answer_quality")
def a28_answer_quality(spark, sf):
    _, _, m = members(spark, sf)
    return rq.answer_quality(rq.read_labels(answers(m), m))


@catalog.add("j2_complete_events")
def j2_complete_events(spark, sf):
    t, packed, m = members(spark, sf)
    return rq.complete_events(domains(t), packed, rq.answer_quality(rq.read_labels(answers(m), m)))


@catalog.add("j3_attached_labels")
def j3_attached_labels(spark, sf):
    t, _, m = members(spark, sf)
    return rq.attach_labels(t, rq.read_labels(answers(m), m)).select(
        "event_id", "comment_id", "root_id", "level", "is_trash", "label", "label_source")


@catalog.add("t15_array_answers", with_(THREADS_SQL) + """
SELECT event_id, comment_id AS id, length(text) AS n FROM threads WHERE text IS NOT NULL""")
def t15_array_answers(spark, sf):
    """One cut-off array response per comment: its first object is complete, the second is not."""
    t = threads(spark, sf)
    obj = F.to_json(F.struct(F.col("comment_id").alias("id"), F.length("text").cast("long").alias("n")))
    response = F.concat(F.lit("```json\n["), obj, F.lit(',{"id":"cut'))
    rows = t.select("event_id", F.explode(rq.array_answers(response, "struct<id:string,n:bigint>")).alias("a"))
    return rows.select("event_id", "a.id", "a.n")


@catalog.add("j21_review_pass", with_(THREADS_SQL) + """
SELECT comment_id, CASE WHEN turn % 3 <> 0 THEN 'tích cực' WHEN turn % 2 = 0 THEN 'tiêu cực' ELSE 'trung lập' END AS label
FROM threads""")
def j21_review_pass(spark, sf):
    t = threads(spark, sf)
    first = t.select("comment_id", F.when(F.col("turn") % 3 == 0, "cần xem xét").otherwise("tích cực").alias("label"))
    second = t.filter("turn % 2 = 0").select("comment_id", F.lit("tiêu cực").alias("label"))
    return rq.review_pass(first, second)
