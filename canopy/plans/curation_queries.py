"""Label curation over documents with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy import vocab
from canopy.operators import curation as cu
from canopy.plans.tables import COMMENTS_SQL, LABELLED_SQL, Catalog, comments, labelled, table, with_

catalog = Catalog()
SHOW = vocab.LABELS["showbiz"]
_L = with_(LABELLED_SQL)


def _md5(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


@catalog.add("l1_stratified_sample", _L + f"""
SELECT comment_id, label FROM (SELECT comment_id, coalesce(label, 'null') AS label FROM labelled)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5('comment_id')}, comment_id) <=
  CASE label WHEN 'null' THEN 20 WHEN 'Ủng hộ' THEN 20 WHEN 'Đồng cảm' THEN 40 ELSE 80 END""")
def l1_stratified_sample(spark, sf):
    d = labelled(spark, sf).select("comment_id", F.coalesce("label", F.lit("null")).alias("label"))
    quotas = {"null": 20, "Ủng hộ": 20, "Đồng cảm": 40, "Phẫn nộ": 80, "Cà khịa": 80, "Trung lập": 80}
    return cu.quota_sample(d, "label", "comment_id", quotas)


@catalog.add("l2_minority_sample", _L + f""",
p AS (SELECT comment_id, CASE WHEN is_trash THEN 'noise' WHEN label = 'Trung lập' THEN 'common' ELSE 'rare' END AS part FROM labelled),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {_md5('comment_id')}, comment_id) AS rn FROM p)
SELECT comment_id FROM r WHERE part = 'rare' OR (part = 'common' AND rn <= 60) OR (part = 'noise' AND rn <=
  greatest(0, 300 - (SELECT count(*) FROM p WHERE part = 'rare') - least(60, (SELECT count(*) FROM p WHERE part = 'common'))))
QUALIFY row_number() OVER (ORDER BY {_md5('comment_id')}, comment_id) <= 300""")
def l2_minority_sample(spark, sf):
    """Quotas are scaled down so that every branch is reached at small scale."""
    return cu.minority_sample(labelled(spark, sf), "comment_id", SHOW, "Trung lập", 300, 60).select("comment_id")


@catalog.add("l3_balanced_sample", _L + f""",
p AS (SELECT comment_id, CASE WHEN is_trash THEN 'noise' ELSE label END AS part FROM labelled),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {_md5('comment_id')}, comment_id) AS rn FROM p WHERE part <> 'Trung lập'),
k AS (SELECT greatest(0, 200 - count(*) FILTER (part IN ('Phẫn nộ', 'Cà khịa')) - least(30, count(*) FILTER (part = 'noise'))) AS need,
             count(*) FILTER (part = 'Đồng cảm') AS c1 FROM p)
SELECT comment_id FROM r, k WHERE part IN ('Phẫn nộ', 'Cà khịa') OR (part = 'noise' AND rn <= 30)
  OR (part = 'Đồng cảm' AND rn <= least(need // 2, c1)) OR (part = 'Ủng hộ' AND rn <= need - least(need // 2, c1))""")
def l3_balanced_sample(spark, sf):
    return cu.balanced_sample(labelled(spark, sf), "comment_id", ["Phẫn nộ", "Cà khịa"], ("Đồng cảm", "Ủng hộ"), 200, 30).select("comment_id")


@catalog.add("l4_final_labels", """
WITH d AS (SELECT doc_id, doc_id % 6 AS k, quality FROM labels)
SELECT doc_id, CASE k WHEN 0 THEN 'Ủng hộ' WHEN 1 THEN 'Phẫn nộ' WHEN 2 THEN NULL WHEN 3 THEN 'is_trash'
                      ELSE CASE WHEN quality = 1 THEN 'Cà khịa' END END AS final_label,
       CASE WHEN k = 2 THEN 'invalid_verified_label' WHEN k >= 4 AND quality = 0 THEN 'no_valid_label' END AS drop_reason FROM d""")
def l4_final_labels(spark, sf):
    """Merged label by alias, verified label against noise, invalid verified label, noise, model label. Also T13."""
    k = F.col("doc_id") % 6
    d = table(spark, sf, "labels").select(
        "doc_id", F.when(k == 0, " ứng  HỘ ").alias("label"), F.when(k == 1, "phan no").when(k == 2, "???").alias("verified_label"),
        F.when(k.isin(1, 3), "True").otherwise("0").alias("is_trash"), F.when(F.col("quality") == 1, "CÀ KHỊA").otherwise("x").alias("model_label"),
        F.lit("text").alias("text"))
    return cu.final_labels(d, "showbiz").select("doc_id", "final_label", "drop_reason")


_SPLIT = """k AS (SELECT label, count(*) AS m FROM labelled WHERE label IS NOT NULL GROUP BY label),
h AS (SELECT *, CASE WHEN (SELECT min(m) FROM k) < 3 THEN 'all' ELSE label END AS g FROM labelled WHERE label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || comment_id), comment_id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM h),
s AS (SELECT comment_id, event_id, label, CASE WHEN rn <= round(n * 0.15) THEN 'test' WHEN rn <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM r)"""


@catalog.add("l5_row_split", _L + ",\n" + _SPLIT + "SELECT comment_id, split FROM s")
def l5_row_split(spark, sf):
    return cu.row_split(labelled(spark, sf).filter("label is not null"), "label", "comment_id").select("comment_id", "split")


_GROUPS = """g AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn, count(*) OVER () AS n
                  FROM (SELECT DISTINCT event_id FROM labelled)),
gs AS (SELECT event_id, CASE WHEN rn <= greatest(1, round(n * 0.15)) THEN 'test'
             WHEN rn <= greatest(1, round(n * 0.15)) * 2 THEN 'val' ELSE 'train' END AS split FROM g)"""


@catalog.add("l6_group_split", _L + ",\n" + _GROUPS + "SELECT comment_id, split FROM labelled JOIN gs USING (event_id)")
def l6_group_split(spark, sf):
    return cu.group_split(labelled(spark, sf), "event_id").select("comment_id", "split")


@catalog.add("l7_fitted_split", _L + f""",
x AS (SELECT comment_id, event_id, label FROM labelled WHERE label IS NOT NULL),
g AS (SELECT event_id, count(*) AS size FROM x GROUP BY ALL),
k AS (SELECT label, count(*) AS all_n FROM x GROUP BY ALL),
n AS (SELECT count(*) AS rows FROM x),
o AS (SELECT t, event_id, size, sum(size) OVER (PARTITION BY t ORDER BY {_md5("t || '/' || event_id")}, event_id) - size AS before FROM g, range(300) r(t)),
t AS (SELECT t, sum(size) AS t_size FROM o, n WHERE before < rows * 0.15::DOUBLE GROUP BY t),
p AS (SELECT t, event_id, size, CASE WHEN before < rows * 0.15::DOUBLE THEN 'test' WHEN before - t_size < rows * 0.15::DOUBLE THEN 'val' ELSE 'train' END AS split FROM o JOIN t USING (t), n),
s AS (SELECT t, split, sum(size) AS s, count(*) AS groups FROM p WHERE split <> 'train' GROUP BY ALL),
c AS (SELECT t, split, label, count(*) AS m FROM p JOIN x USING (event_id) WHERE split <> 'train' GROUP BY ALL),
e AS (
  SELECT s.t, s.split, abs(any_value(s.s) - any_value(rows) * 0.15::DOUBLE) / any_value(rows)
    + 0.5 * sum(abs(coalesce(c.m, 0)::DOUBLE / s.s - k.all_n::DOUBLE / rows)) + CASE WHEN any_value(s.groups) < 3 THEN 1.0 ELSE 0.0 END
    + sum(CASE WHEN coalesce(c.m, 0) = 0 THEN 0.3 ELSE 0.0 END) AS cost
  FROM s CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.t = s.t AND c.split = s.split AND c.label = k.label GROUP BY s.t, s.split),
b AS (SELECT t FROM e GROUP BY t ORDER BY count(*) DESC, round(sum(cost), 9), t LIMIT 1)
SELECT comment_id, event_id, split FROM x JOIN p USING (event_id) JOIN b USING (t)""")
def l7_fitted_split(spark, sf):
    """Best of 300 seeded event orders (properties are checked in the tests)."""
    d = labelled(spark, sf).filter("label is not null")
    return cu.fitted_group_split(d, "event_id", "label").select("comment_id", "event_id", "split")


@catalog.add("l8_synthetic_in_train", _L + ",\n" + _GROUPS + """
SELECT comment_id, split FROM labelled JOIN gs USING (event_id) UNION ALL
SELECT 'syn' || comment_id, 'train' FROM labelled JOIN gs USING (event_id) WHERE split = 'train' AND seq % 5 = 0""")
def l8_synthetic_in_train(spark, sf):
    """Also U4. Every fifth comment has a synthetic twin; twins of held-out events are dropped."""
    d = labelled(spark, sf)
    s = cu.group_split(d, "event_id").select("comment_id", "event_id", "split")
    twins = d.filter("seq % 5 = 0").select(F.concat(F.lit("syn"), "comment_id").alias("comment_id"), "event_id")
    return cu.add_synthetic(s, twins, "event_id").select("comment_id", "split")


@catalog.add("l8_frozen_test", _L + """
SELECT CASE WHEN doc IS NULL THEN 'rest' ELSE 'frozen' END AS part, count(*) AS n
FROM labelled LEFT JOIN (SELECT 'c' || doc_id AS doc FROM documents WHERE doc_id % 8 = 0) ON doc = comment_id GROUP BY ALL""")
def l8_frozen_test(spark, sf):
    ids = table(spark, sf, "documents").filter("doc_id % 8 = 0").select(F.concat(F.lit("c"), "doc_id").alias("comment_id"))
    a, b = cu.frozen_test(labelled(spark, sf), ids, "comment_id")
    n = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return n(a, "frozen").unionByName(n(b, "rest"))


@catalog.add("l9_split_manifest", _L + ",\n" + _SPLIT + "SELECT split, comment_id FROM s")
def l9_split_manifest(spark, sf):
    """Ids per split, written as one folder per split and read back."""
    from canopy.session import run_dir

    path = run_dir(spark, "manifest")
    cu.row_split(labelled(spark, sf).filter("label is not null"), "label", "comment_id").select("split", "comment_id").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("split", "comment_id")


@catalog.add("l10_augmentation_jobs", _L + """,
per AS (SELECT event_id, label, count(*) AS n FROM labelled WHERE label IN ('Phẫn nộ', 'Đồng cảm') GROUP BY ALL HAVING count(*) >= 3),
b AS (SELECT per.*, CASE label WHEN 'Phẫn nộ' THEN ceil(400 / 14.0) ELSE ceil((300 - 50) / 14.0) END AS batches, sum(n) OVER (PARTITION BY label) AS a FROM per),
s AS (SELECT *, batches * n / a AS exact, floor(batches * n / a) AS base FROM b),
r AS (SELECT *, batches - sum(base) OVER (PARTITION BY label) AS rest,
             row_number() OVER (PARTITION BY label ORDER BY exact - base DESC, md5('7:' || event_id)) AS rn FROM s)
SELECT event_id, label, n, (base + CASE WHEN rn <= rest THEN 1 ELSE 0 END)::BIGINT AS jobs FROM r WHERE base + CASE WHEN rn <= rest THEN 1 ELSE 0 END > 0""")
def l10_augmentation_jobs(spark, sf):
    d = labelled(spark, sf).filter("label is not null")
    have = d.filter("label = 'Đồng cảm'").select("label").distinct().withColumn("n", F.lit(50))
    return cu.augmentation_jobs(d, have, {"Phẫn nộ": 400, "Đồng cảm": 300}, 20, 0.7)


@catalog.add("l11_batch_scores", with_(COMMENTS_SQL) + """
SELECT comment_id, CASE WHEN length(text) % 3 = 0 THEN 'a' WHEN length(text) % 3 = 1 THEN 'b' ELSE 'c' END AS label, 0.8::DOUBLE AS confidence FROM comments""")
def l11_batch_scores(spark, sf):
    """The scoring hook with a stand-in model that looks at the text length."""
    def by_length(texts):
        return [[0.8 if len(t) % 3 == i else 0.1 for i in range(3)] for t in texts]
    return cu.score_batches(comments(spark, sf).select("comment_id", "text"), "text", ["a", "b", "c"], by_length).select(
        "comment_id", "label", "confidence")


@catalog.add("a18_class_weights", _L + """, l AS (SELECT unnest(['Phẫn nộ', 'Cà khịa', 'Đồng cảm', 'Ủng hộ', 'Trung lập', 'none']) AS label),
c AS (SELECT l.label, count(x.label) AS n FROM l LEFT JOIN labelled x ON x.label = l.label GROUP BY ALL),
t AS (SELECT *, greatest(n, 1) AS m, sum(greatest(n, 1)) OVER () AS t, sum(n) OVER () AS rows, count(*) FILTER (n > 0) OVER () AS present FROM c)
SELECT label, n, round(t / (6 * m), 9) AS inverse, round(ln(t / m), 9) AS log_inverse, round(sqrt(t / (6 * m)), 9) AS sqrt_inverse,
       CASE WHEN n > 0 THEN round(rows / (present * n), 9) ELSE 1 END AS balanced FROM t""")
def a18_class_weights(spark, sf):
    w = cu.class_weights(labelled(spark, sf), "label", [*SHOW, "none"])
    return w.select("label", "n", *[F.round(c, 9).alias(c) for c in ["inverse", "log_inverse", "sqrt_inverse", "balanced"]])


def predictions(spark, sf):
    """quality as truth, a rule on the text as prediction."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    pick = F.col("n_chars") % 5
    return d.select("doc_id", F.concat(F.lit("q"), "quality").alias("true_label"),
                    F.when(pick == 0, "q0").when(pick == 4, "q2").otherwise("q1").alias("pred_label"),
                    F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))


PRED_SQL = """pred AS (SELECT doc_id, 'q' || quality AS true_label, CASE n_chars % 5 WHEN 0 THEN 'q0' WHEN 4 THEN 'q2' ELSE 'q1' END AS pred_label,
  CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id))"""
REPORT_SQL = PRED_SQL + """,
m AS (SELECT true_label, pred_label, count(*) AS n FROM pred GROUP BY ALL),
k AS (SELECT true_label AS label FROM m UNION SELECT pred_label FROM m),
c AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM m WHERE true_label = label)::BIGINT AS support, (SELECT coalesce(sum(n), 0) FROM m WHERE pred_label = label)::BIGINT AS predicted,
             (SELECT coalesce(sum(n), 0) FROM m WHERE true_label = label AND pred_label = label)::BIGINT AS hits FROM k),
p AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"""


@catalog.add("a19_confusion", with_(PRED_SQL) + "SELECT true_label, pred_label, count(*) AS n FROM pred GROUP BY ALL")
def a19_confusion(spark, sf):
    return cu.confusion(predictions(spark, sf))


@catalog.add("a19_class_report", with_(REPORT_SQL) + """
SELECT label, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def a19_class_report(spark, sf):
    r = cu.class_report(predictions(spark, sf))
    return r.select("label", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ["precision", "recall", "f1"]])


@catalog.add("a19_overall_scores", with_(REPORT_SQL) + """
SELECT sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS f1_macro,
       round(sum(f1 * support) / sum(support), 9) AS f1_weighted FROM f""")
def a19_overall_scores(spark, sf):
    s = cu.overall_scores(cu.class_report(predictions(spark, sf)))
    return s.select("n", *[F.round(c, 9).alias(c) for c in ["accuracy", "f1_macro", "f1_weighted"]])


@catalog.add("g7_wrong_predictions", with_(PRED_SQL) + "SELECT doc_id, true_label, pred_label FROM pred WHERE split = 'test' AND true_label <> pred_label")
def g7_wrong_predictions(spark, sf):
    from canopy.operators.graph import wrong_predictions

    return wrong_predictions(predictions(spark, sf)).select("doc_id", "true_label", "pred_label")


@catalog.add("j18_predictions_on_nodes", with_(PRED_SQL) + """
SELECT source || '::' || doc_id AS uid, true_label, pred_label FROM documents LEFT JOIN pred USING (doc_id)""")
def j18_predictions_on_nodes(spark, sf):
    from canopy.operators.graph import uid

    d = table(spark, sf, "documents")
    node = d.select(uid(F.col("source"), F.col("doc_id").cast("string")).alias("uid"))
    p = d.join(predictions(spark, sf), "doc_id").select(uid(F.col("source"), F.col("doc_id").cast("string")).alias("uid"), "true_label", "pred_label")
    return node.join(p, "uid", "left")


@catalog.add("a20_labelling_cost", """
SELECT lang AS domain, count(*) AS n, round(count(*) * 0.5::DOUBLE, 6) AS seconds, round(count(*) * (20.25::DOUBLE / 1000000), 6) AS usd,
       round(count(*) * (20.25::DOUBLE / 1000000) * 25400, 6) AS vnd FROM documents GROUP BY ALL""")
def a20_labelling_cost(spark, sf):
    c = cu.labelling_cost(table(spark, sf, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n")))
    return c.select("domain", "n", *[F.round(x, 6).alias(x) for x in ["seconds", "usd", "vnd"]])


@catalog.add("a35_check_accuracy", """
SELECT lang AS test_set, sum(quality)::BIGINT AS "right", count(*) AS n, round(avg(quality), 9) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def a35_check_accuracy(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = cu.check_accuracy(d.select(F.col("lang").alias("test_set"), F.col("quality").alias("is_label_correct")))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@catalog.add("f7_level_one_texts", _L + """
SELECT comment_id, trim(text) AS text, label FROM labelled WHERE NOT is_trash AND level = 1 AND trim(text) <> ''""")
def f7_level_one_texts(spark, sf):
    d = labelled(spark, sf).filter(~F.col("is_trash") & (F.col("level") == 1))
    return d.select("comment_id", F.trim("text").alias("text"), "label").filter("text <> '' and comment_id <> ''")


@catalog.add("a2_non_noise_count", _L + "SELECT event_id, count(*) FILTER (NOT is_trash) AS n FROM labelled GROUP BY ALL")
def a2_non_noise_count(spark, sf):
    """Also F8: the flag arrives as text in several spellings."""
    from canopy.functions.text import truthy

    flag = F.when(F.col("is_trash"), F.when(F.col("seq") % 20 == 9, " YES ").otherwise("1.0")).otherwise("no")
    return labelled(spark, sf).groupBy("event_id").agg(F.count_if(~truthy(flag)).alias("n"))


@catalog.add("j16_filled_ids", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE 'k' || page_id % 10 END AS id_content FROM pages""")
def j16_filled_ids(spark, sf):
    p = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        "page_id", F.when(p % 2 == 0, F.concat(F.lit("p"), p)).otherwise(" ").alias("id_content"), F.concat(F.lit("Event "), p % 10).alias("event_name"))
    known = table(spark, sf, "pages").select(
        F.concat(F.lit("Event "), p % 10).alias("event_name"), F.concat(F.lit("k"), p % 10).alias("id_content"), p.alias("seq"))
    return cu.fill_ids(rows, known).select("page_id", "id_content")


@catalog.add("j17_event_context", _L + """,
ctx AS (SELECT source AS event_id, 'about ' || source AS context FROM documents WHERE source <> 'src4' GROUP BY ALL)
SELECT comment_id, coalesce(context, '') AS context, context IS NULL AS missing FROM labelled LEFT JOIN ctx USING (event_id)""")
def j17_event_context(spark, sf):
    ctx = table(spark, sf, "documents").filter("source <> 'src4'").select(F.col("source").alias("event_id")).distinct().withColumn(
        "context", F.concat(F.lit("about "), "event_id"))
    return cu.with_context(labelled(spark, sf), ctx).select("comment_id", "context", "missing")
