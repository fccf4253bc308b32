"""How the given tables play the parts of the data model (flat comments, threads, labels, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import fan_out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark.read.parquet(f"{sf}/{name}.parquet"))


def utc(df: DataFrame) -> DataFrame:
    """Zone-less timestamps of the tables as UTC instants, whatever the session's zone."""
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.expr(f"cast(convert_timezone('UTC', current_timezone(), {name}) as timestamp)"))
    return df


def comments(spark, sf) -> DataFrame:
    """documents as flat comments: source is the event, lang the domain."""
    return fan_out(table(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("id_content"), F.col("lang").alias("domain"),
        F.concat(F.lit("c"), F.col("doc_id")).alias("comment_id"), F.col("doc_id").alias("seq"), "text")


COMMENTS_SQL = """comments AS (
  SELECT source AS id_content, lang AS domain, 'c' || doc_id AS comment_id, doc_id AS seq, text FROM documents)"""


def threads(spark, sf) -> DataFrame:
    """conversations as comment trees: sixteen conversations per event, turn n replies to turn (n - 1) div 2."""
    c = table(spark, sf, "conversations")
    node = lambda t: F.concat(F.lit("k"), F.col("conv_id"), F.lit("t"), t)
    return c.select(
        F.concat(F.lit("e"), F.expr("conv_id div 16")).alias("event_id"),
        node(F.col("turn")).alias("comment_id"),
        F.when(F.col("turn") > 0, node(F.expr("(turn - 1) div 2"))).alias("parent_id"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("seq"),
        "conv_id", "turn", "role", "text")


THREADS_SQL = """threads AS (
  SELECT 'e' || (conv_id // 16) AS event_id, 'k' || conv_id || 't' || turn AS comment_id,
         CASE WHEN turn > 0 THEN 'k' || conv_id || 't' || ((turn - 1) // 2) END AS parent_id,
         conv_id * 1000000 + turn AS seq, conv_id, turn, role, text FROM conversations)"""


def labelled(spark, sf) -> DataFrame:
    """documents with labels as labelled comments: quality picks the label group, toxic the flag. A third
    of the rows are thread roots; likes and reply counts come from the sizes."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    pick = F.col("doc_id") % 3
    label = (F.when(F.col("quality") == 0, F.when(pick == 0, "Phẫn nộ").otherwise("Cà khịa"))
             .when(pick == 0, "Đồng cảm").when(pick == 1, "Ủng hộ").otherwise("Trung lập"))
    trash = (F.col("doc_id") % 10 == 9)
    root = F.expr("doc_id - doc_id % 4")
    return d.join(l, "doc_id").select(
        F.col("source").alias("event_id"), F.col("lang").alias("domain"), F.col("doc_id").alias("seq"),
        F.concat(F.lit("c"), F.col("doc_id")).alias("comment_id"), F.concat(F.lit("c"), root).alias("root_id"),
        F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2).alias("level"), "text",
        (F.col("n_chars") % 97).alias("likes"), (F.col("doc_id") % 7).alias("reply_count"),
        trash.alias("is_trash"), F.when(~trash, label).alias("label"),
        F.when(~trash, F.col("toxic") == 1).alias("toxic"),
        F.when(~trash & (F.col("toxic") == 1), F.when(pick == 0, "chửi bới").when(pick == 1, "công kích cá nhân")
               .otherwise("công kích người thân")).alias("toxic_type"),
        F.when(trash, "rule").when(pick == 2, "fallback_missing").otherwise("llm").alias("label_source"))


LABELLED_SQL = """labelled AS (
  SELECT source AS event_id, lang AS domain, doc_id AS seq, 'c' || doc_id AS comment_id,
         'c' || (doc_id - doc_id % 4) AS root_id, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS level, text,
         n_chars % 97 AS likes, doc_id % 7 AS reply_count, doc_id % 10 = 9 AS is_trash,
         CASE WHEN doc_id % 10 = 9 THEN NULL
              WHEN quality = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'Phẫn nộ' ELSE 'Cà khịa' END
              WHEN doc_id % 3 = 0 THEN 'Đồng cảm' WHEN doc_id % 3 = 1 THEN 'Ủng hộ' ELSE 'Trung lập' END AS label,
         CASE WHEN doc_id % 10 = 9 THEN NULL ELSE toxic = 1 END AS toxic,
         CASE WHEN doc_id % 10 <> 9 AND toxic = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'chửi bới'
              WHEN 1 THEN 'công kích cá nhân' ELSE 'công kích người thân' END END AS toxic_type,
         CASE WHEN doc_id % 10 = 9 THEN 'rule' WHEN doc_id % 3 = 2 THEN 'fallback_missing' ELSE 'llm' END
           AS label_source
  FROM documents JOIN labels USING (doc_id))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


class Catalog:
    """Named queries with the SQL each must agree with, where SQL can say it."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn
        return keep
