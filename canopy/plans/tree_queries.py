"""Comment trees and reply graphs over conversations (turns as comments) and embeddings (node vectors)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from canopy.operators import graph, tree
from canopy.operators.ordering import buckets
from canopy.plans.tables import THREADS_SQL, Catalog, table, threads, with_

catalog = Catalog()

ROOTS_SQL = """walk AS (
  SELECT event_id, comment_id, comment_id AS root_id, 1 AS level FROM threads WHERE parent_id IS NULL
  UNION ALL SELECT t.event_id, t.comment_id, w.root_id, w.level + 1 FROM threads t
  JOIN walk w ON w.event_id = t.event_id AND w.comment_id = t.parent_id)"""
_REC = "WITH RECURSIVE " + THREADS_SQL + ",\n" + ROOTS_SQL

# Labels and features come from embeddings, where a node has any; nodes without a label are not usable. Edges need both ends.
NODES_SQL = """nodes AS (
  SELECT t.event_id, t.comment_id, t.parent_id, t.seq, t.turn, e.label, e.embedding AS x,
         t.role = 'system' AS is_trash FROM threads t LEFT JOIN embeddings e ON e.vec_id = t.conv_id * 8 + t.turn),
good AS (SELECT * FROM nodes WHERE NOT is_trash AND label IN (0, 1, 2, 3)),
edges AS (SELECT c.event_id, c.comment_id AS child, p.comment_id AS parent FROM good c
          JOIN good p ON p.event_id = c.event_id AND p.comment_id = c.parent_id)"""


def nodes(spark, sf):
    t = threads(spark, sf).withColumn("vec_id", F.col("conv_id") * 8 + F.col("turn"))
    return t.join(table(spark, sf, "embeddings"), "vec_id", "left").select(
        "event_id", "comment_id", "parent_id", "seq", "turn", "label", F.col("embedding").alias("x"),
        (F.col("role") == "system").alias("is_trash"))


def good_nodes(spark, sf):
    return graph.usable(nodes(spark, sf), [0, 1, 2, 3])


def posts(spark, sf):
    """Each conversation as a two-level post document: turn 0 with all later turns as replies."""
    c = table(spark, sf, "conversations")
    reply = F.struct(F.concat_ws("_", "conv_id", "turn").alias("comment_id"), F.col("turn").cast("int").alias("order"),
                     F.concat_ws("_", "conv_id", F.lit("0")).alias("reply_to_id"), "text",
                     F.length("text").alias("likes"))
    per = c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", reply.alias("r"))))).alias("rs"))
    comment = F.struct(
        F.concat_ws("_", "conv_id", F.lit("0")).alias("comment_id"), F.lit(0).alias("order"), "text",
        F.length("text").alias("likes"), F.size("rs").alias("reply_count"), F.transform("rs", lambda x: x["r"]).alias("replies"))
    return per.select(F.col("conv_id").cast("string").alias("id_content"), F.lit("post").alias("event_name"),
                      F.array(comment).alias("comments"))


@catalog.add("g1_flatten_posts", """
SELECT conv_id::VARCHAR AS id_content, 'post' AS event_name, conv_id || '_' || turn AS comment_id,
       CASE WHEN turn > 0 THEN conv_id || '_0' END AS parent_comment_id, turn::INTEGER AS "order", text,
       length(text)::INTEGER AS likes, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS depth FROM conversations""")
def g1_flatten_posts(spark, sf):
    """Also U1: roots and all replies in one table."""
    return tree.flatten_two_levels(posts(spark, sf))


@catalog.add("a1_comments_per_event", """
SELECT conv_id::VARCHAR AS id_content, count(*) AS n_comments FROM conversations GROUP BY ALL""")
def a1_comments_per_event(spark, sf):
    size = F.aggregate("comments", F.lit(0).cast("long"), lambda a, c: a + 1 + F.size(c["replies"]))
    return posts(spark, sf).groupBy("id_content").agg(F.sum(size).alias("n_comments"))


@catalog.add("g2_flatten_documents", _REC + """
SELECT w.event_id AS id_content, w.comment_id, t.parent_id, w.level, t.text FROM walk w
JOIN threads t ON t.event_id = w.event_id AND t.comment_id = w.comment_id""")
def g2_flatten_documents(spark, sf):
    """Nested documents of any depth (made by g10) back to flat rows in depth-first order."""
    flat = tree.flatten_chunks(tree.nest(tree.build_threads(threads(spark, sf))))
    return flat.select(F.col("event_id").alias("id_content"), "comment_id", "parent_id", "level", "text")


@catalog.add("g3_threads", _REC + "SELECT event_id, comment_id, root_id, level, false AS orphan FROM walk")
def g3_threads(spark, sf):
    return tree.build_threads(threads(spark, sf)).select("event_id", "comment_id", "root_id", "level", "orphan")


@catalog.add("j6_orphans", with_(THREADS_SQL) + """, live AS (SELECT * FROM threads WHERE role <> 'user')
SELECT c.event_id, c.comment_id, p.comment_id IS NULL AND c.parent_id IS NOT NULL AS orphan FROM live c
LEFT JOIN live p ON p.event_id = c.event_id AND p.comment_id = c.parent_id""")
def j6_orphans(spark, sf):
    """Replies whose parent is missing once user turns are gone."""
    live = threads(spark, sf).filter("role <> 'user'")
    return tree.valid_parents(live).select("event_id", "comment_id", "orphan")


@catalog.add("g4_longest_chains", _REC + """
SELECT event_id, comment_id, level - 1 AS depth FROM walk ORDER BY depth DESC, event_id, comment_id LIMIT 10""")
def g4_longest_chains(spark, sf):
    """Also K10."""
    return tree_top(spark, sf)


def tree_top(spark, sf):
    return graph.longest_chains(tree.build_threads(threads(spark, sf))).select("event_id", "comment_id", "depth")


@catalog.add("g5_most_replied", with_(THREADS_SQL) + """
SELECT event_id, parent_id AS comment_id, count(*) AS replies FROM threads WHERE parent_id IS NOT NULL
GROUP BY ALL ORDER BY replies DESC, event_id, comment_id LIMIT 10""")
def g5_most_replied(spark, sf):
    t = threads(spark, sf)
    return graph.most_replied(graph.reply_edges(t), t).select("event_id", "comment_id", "replies")


@catalog.add("j5_reply_edges", with_(THREADS_SQL, NODES_SQL) + "SELECT * FROM edges")
def j5_reply_edges(spark, sf):
    return graph.reply_edges(good_nodes(spark, sf))


@catalog.add("f6_usable_nodes", with_(THREADS_SQL, NODES_SQL) + "SELECT event_id, comment_id, label FROM good")
def f6_usable_nodes(spark, sf):
    return good_nodes(spark, sf).select("event_id", "comment_id", "label")


_STRUCT = with_(THREADS_SQL, NODES_SQL) + """, p AS (
  SELECT g.*, e.parent FROM good g LEFT JOIN edges e ON e.event_id = g.event_id AND e.child = g.comment_id)
SELECT event_id, comment_id, label, turn AS depth,
       (SELECT count(*) FROM edges e WHERE e.event_id = p.event_id AND e.parent = p.comment_id) AS in_degree,
       count(*) OVER (PARTITION BY event_id, coalesce(parent, 'ROOT')) - 1 AS sibling_count FROM p"""


@catalog.add("g8_graph_nodes", _STRUCT)
def g8_graph_nodes(spark, sf):
    """Valid nodes with structural counts (A17, W6)."""
    n = good_nodes(spark, sf)
    return graph.structure(n, graph.reply_edges(n)).select(
        "event_id", "comment_id", "label", F.col("turn").alias("depth"), "in_degree", "sibling_count")


@catalog.add("u5_both_ways", with_(THREADS_SQL, NODES_SQL) + """
SELECT event_id, child AS src, parent AS dst FROM edges UNION ALL SELECT event_id, parent, child FROM edges""")
def u5_both_ways(spark, sf):
    return graph.both_ways(graph.reply_edges(good_nodes(spark, sf)))


@catalog.add("a34_neighbour_mean", with_(THREADS_SQL, NODES_SQL) + """,
ends AS (SELECT event_id, child AS src, parent AS dst FROM edges UNION ALL SELECT event_id, parent, child FROM edges),
cells AS (SELECT b.event_id, b.dst, unnest(g.x) AS v, generate_subscripts(g.x, 1) AS i
          FROM ends b JOIN good g ON g.event_id = b.event_id AND g.comment_id = b.src),
m AS (SELECT event_id, dst, i, avg(v::DOUBLE) AS v FROM cells GROUP BY ALL)
SELECT g.event_id, g.comment_id, coalesce(round(sum(abs(m.v)), 6), 0) AS l1, coalesce(round(sum(m.v * m.i), 6), 0) AS moment
FROM good g LEFT JOIN m ON m.event_id = g.event_id AND m.dst = g.comment_id GROUP BY ALL""")
def a34_neighbour_mean(spark, sf):
    n = good_nodes(spark, sf)
    m = graph.neighbour_mean(n, graph.reply_edges(n))
    add = lambda a, v: a + v
    return m.select(
        "event_id", "comment_id",
        F.round(F.aggregate(F.transform("mean", F.abs), F.lit(0.0), add), 6).alias("l1"),
        F.round(F.aggregate(F.transform("mean", lambda v, i: v * (i + 1)), F.lit(0.0), add), 6).alias("moment"))


def weights(rows: int, cols: int, phase: float) -> np.ndarray:
    """A fixed example matrix; a caller passes trained weights here."""
    return np.sin(np.arange(rows * cols).reshape(rows, cols) * 0.7 + phase) / np.sqrt(cols)


@catalog.add("g12_encoder_scores")
def g12_encoder_scores(spark, sf):
    """Two mean-neighbour layers and a linear head (checked against NumPy in the tests)."""
    n = good_nodes(spark, sf)
    dim, hidden = 64, 8  # the length of the given vectors; a caller knows its model's
    layers = [{"l": weights(hidden, dim, 0.1), "r": weights(hidden, dim, 0.2), "b": np.zeros(hidden)},
              {"l": weights(hidden, hidden, 0.3), "r": weights(hidden, hidden, 0.4), "b": np.full(hidden, 0.1)}]
    out = graph.encode(n, graph.reply_edges(n), layers, {"w": weights(4, hidden, 0.5), "b": np.zeros(4)})
    best = F.array_position("logits", F.array_max("logits")) - 1
    return out.select("event_id", "comment_id", best.alias("pred"), F.round(F.array_max("logits"), 6).alias("logit"))


@catalog.add("j14_disagreements", with_(THREADS_SQL, NODES_SQL) + """
SELECT e.event_id, e.child, e.parent, c.label AS child_label, p.label AS parent_label FROM edges e
JOIN good c ON c.event_id = e.event_id AND c.comment_id = e.child
JOIN good p ON p.event_id = e.event_id AND p.comment_id = e.parent WHERE c.label <> p.label""")
def j14_disagreements(spark, sf):
    """Also G6."""
    n = good_nodes(spark, sf)
    return graph.disagreements(n, graph.reply_edges(n))


@catalog.add("g9_property_rows", with_(THREADS_SQL, NODES_SQL) + """
SELECT event_id || '::' || comment_id AS uid, 'conv::' || label AS label_key FROM good""")
def g9_property_rows(spark, sf):
    n = good_nodes(spark, sf)
    rows = graph.property_rows(n, graph.reply_edges(n), F.lit("conv"))
    return rows["comments"].select("uid", "label_key")


@catalog.add("j20_parent_text", with_(THREADS_SQL) + """
SELECT c.event_id, c.comment_id, p.text AS parent_text FROM threads c
LEFT JOIN threads p ON p.event_id = c.event_id AND p.comment_id = c.parent_id""")
def j20_parent_text(spark, sf):
    return tree.attach_parent_text(threads(spark, sf)).select("event_id", "comment_id", "parent_text")


@catalog.add("w1_renumber", with_(THREADS_SQL) + """
SELECT comment_id, o AS "order", 'cmt_' || event_id || '_' || lpad(o::VARCHAR, 4, '0') AS new_id
FROM (SELECT event_id, comment_id, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS o FROM threads
      WHERE role <> 'system')""")
def w1_renumber(spark, sf):
    return tree.renumber(threads(spark, sf).filter("role <> 'system'")).select("comment_id", "order", "new_id")


_COPIES = THREADS_SQL + """, twice AS (
  SELECT event_id, comment_id, seq, text FROM threads UNION ALL
  SELECT event_id, comment_id, seq + 1000000, 'again ' || text FROM threads WHERE turn % 2 = 0)"""


def twice(spark, sf):
    t = threads(spark, sf).select("event_id", "comment_id", "seq", "turn", "text")
    again = t.filter("turn % 2 = 0").withColumn("seq", F.col("seq") + 1000000).withColumn(
        "text", F.concat(F.lit("again "), "text"))
    return t.unionByName(again)


@catalog.add("w2_keep_first", with_(_COPIES) + """
SELECT comment_id, min_by(text, seq) AS text FROM twice GROUP BY event_id, comment_id""")
def w2_keep_first(spark, sf):
    return tree.keep_first(twice(spark, sf), ["event_id", "comment_id"]).select("comment_id", "text")


@catalog.add("w3_keep_last", with_(_COPIES) + """
SELECT comment_id, max_by(text, seq) AS text FROM twice GROUP BY event_id, comment_id""")
def w3_keep_last(spark, sf):
    return tree.keep_last(twice(spark, sf), ["event_id", "comment_id"]).select("comment_id", "text")


@catalog.add("w4_sibling_order", with_(THREADS_SQL) + """
SELECT comment_id, row_number() OVER (PARTITION BY event_id, parent_id ORDER BY seq) AS place,
       (SELECT count(*) FROM threads k WHERE k.event_id = t.event_id AND k.parent_id = t.comment_id) AS n_replies
FROM threads t""")
def w4_sibling_order(spark, sf):
    rows = threads(spark, sf).withColumnRenamed("parent_id", "parent")
    return tree.sibling_order(rows).select("comment_id", "place", "n_replies")


@catalog.add("w12_fixed_batches", with_(THREADS_SQL) + """
SELECT comment_id, (row_number() OVER (PARTITION BY event_id ORDER BY seq) - 1) // 10 AS batch FROM threads
WHERE role <> 'system'""")
def w12_fixed_batches(spark, sf):
    from canopy.operators.ordering import number_rows

    live = threads(spark, sf).filter("role <> 'system'")
    rows = number_rows(live, ["event_id"], ["seq"], buckets("seq"))
    return rows.select("comment_id", F.expr("(rn - 1) div 10").alias("batch"))


@catalog.add("g10_nest_documents")
def g10_nest_documents(spark, sf):
    """Nested JSON per event (read back and compared by g2)."""
    return tree.nest(tree.build_threads(threads(spark, sf)))


@catalog.add("g11_event_documents", """
SELECT 'e' || (page_id // 5) AS event_id, min_by('Event of page ' || page_id, page_id) AS event_name,
       string_agg('[' || split_part(url, '/', 3) || '] ' || page_id, chr(10) || chr(10) ORDER BY page_id) AS post_content
FROM pages WHERE page_id % 4 <> 3 GROUP BY ALL""")
def g11_event_documents(spark, sf):
    """Links grouped into event heads: only links that are done, posts joined by blank lines."""
    links = table(spark, sf, "pages").select(
        F.concat(F.lit("e"), F.expr("page_id div 5")).alias("event_id"), F.concat(F.lit("Event of page "), "page_id").alias("event_name"),
        F.split("url", "/")[2].alias("page"), F.col("page_id").cast("string").alias("post_text"),
        F.when(F.col("page_id") % 4 == 3, "pending").otherwise("done").alias("status"), F.col("page_id").alias("seq"))
    return tree.event_heads(links)
