"""Readers of post documents, record files and tables of links, annotations and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.text import strip
from canopy.operators.crawl import canonical_header
from canopy.operators.ordering import first_row
from canopy.sources import sheets, versions

REPLY = "struct<comment_id:string,`order`:int,reply_to_id:string,text:string,likes:int>"
COMMENT = f"struct<comment_id:string,`order`:int,text:string,likes:int,reply_count:int,replies:array<{REPLY}>>"
POST = f"id_content string, event_name string, sort_mode string, post_content string, comments array<{COMMENT}>, _bad string"
DOCUMENT = "id_content string, event_name string, sort_mode string, post_content string, comments string, _bad string"


def _documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(paths)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def read_posts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One post document per file; files that are no JSON object with an id_content are skipped. Executors parse."""
    return _documents(spark, paths, POST).filter("_bad is null and id_content is not null").drop("_bad", "file")


def read_documents(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Documents of any depth with comments left as JSON text: {events, rejected}. A document needs a list of
    comments, and the first one needs a comment_id. Without an id the file name serves."""
    rows = _documents(spark, paths, DOCUMENT)
    first = F.get_json_object("comments", "$[0]")
    shaped = F.col("_bad").isNull() & F.col("comments").startswith("[") & (first.isNull() | F.get_json_object("comments", "$[0].comment_id").isNotNull())
    rows = rows.withColumn("ok", F.coalesce(shaped, F.lit(False)))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    events = rows.filter("ok").select(
        F.coalesce(F.nullif("id_content", F.lit("")), stem).alias("event_id"), F.coalesce("event_name", F.lit("")).alias("name"),
        F.coalesce("post_content", F.lit("")).alias("post_title"), "sort_mode", "comments")
    rejected = rows.filter("not ok").select("file", F.when(F.col("_bad").isNotNull(), "no json").otherwise("wrong shape").alias("reason"))
    return {"events": events, "rejected": rejected}


def read_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_records(spark: SparkSession, paths: list[str], record: str) -> DataFrame:
    """Files that hold a list of records, one record, or one record per line -> records."""
    text = spark.read.text(paths, wholetext=True).select(strip(F.col("value")).alias("t"))
    rows = F.when(F.col("t").startswith("["), F.from_json("t", f"array<{record}>"))
    whole = F.from_json("t", f"struct<r:{record}>")
    lines = F.filter(F.transform(F.split("t", r"\r?\n"), lambda x: F.from_json(strip(x), record)), lambda x: x.isNotNull())
    by_line = F.col("t").rlike(r"\}\s*\n\s*\{")
    out = text.select(F.explode(F.coalesce(rows, F.when(by_line, lines), F.array(F.from_json("t", record)))).alias("r"))
    return out.filter("r is not null").select("r.*")


# --- fixed values: words that mark the education category ----------------------------------------
EDUCATION_KEYS = "giáo dục|giao duc|education|giáo"
EDUCATION_NAMES = "giáo dục|giao duc|education"
WEB = "struct<id_content:string,ten_su_kien:string,content:string,actor_related:array<struct<name:string,role:string>>,time_event:string,danh_muc:string>"


def web_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Web events from a category -> list object or from one flat list; the last record per domain and id counts."""
    text = spark.read.text(paths, wholetext=True).select(strip(F.col("value")).alias("t"))
    keyed = text.filter(F.col("t").startswith("{")).select(F.explode(F.from_json("t", f"map<string,array<{WEB}>>")).alias("key", "rs"))
    keyed = keyed.select(F.lower(strip(F.col("key"))).rlike(EDUCATION_KEYS).alias("edu"), F.posexplode("rs").alias("pos", "r"))
    flat = text.filter(F.col("t").startswith("[")).select(F.posexplode(F.from_json("t", f"array<{WEB}>")).alias("pos", "r"))
    flat = flat.select(F.lower(strip(F.coalesce("r.danh_muc", F.lit("")))).rlike(EDUCATION_NAMES).alias("edu"), "pos", "r")
    rows = keyed.unionByName(flat).select(
        F.when(F.col("edu"), "education").otherwise("showbiz").alias("domain"), "pos", strip(F.coalesce("r.id_content", F.lit(""))).alias("id_content"),
        "r.ten_su_kien", "r.content", "r.actor_related", "r.time_event").filter("id_content <> ''")
    return first_row(rows, ["domain", "id_content"], [F.col("pos").desc()]).drop("pos")


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Annotation tables as strings, blank rows dropped: csv files, or workbooks where a path or the files of a folder end in xlsx."""
    if all(p.endswith(".xlsx") or versions.has_files(spark, p, ".xlsx") for p in paths):
        return sheets.read_sheet(spark, paths).drop("file", "row")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.na.drop("all")


# --- fixed values: accepted headers of the link table, accent-free -------------------------------
HEADERS = {
    "event_id": ["id su kien", "event_id", "event id", "id_content"],
    "event_name": ["ten su kien", "event_name", "event name"],
    "page": ["page", "trang", "ten trang"],
    "url": ["link", "url"],
    "n_comments": ["so comment", "n_comments", "comments"],
    "status": ["trang thai", "status"],
}


def read_link_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Tab-separated link rows with headers matched by their accent-free text, in any order. Absent columns are
    empty; the two that identify a link are required."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    shown = spark.createDataFrame([(i, c) for i, c in enumerate(raw.columns)], "i int, name string")
    names = {r["i"]: r["n"] for r in shown.select("i", canonical_header(F.col("name")).alias("n")).collect()}
    pick = {}
    for field, accepted in HEADERS.items():
        for name in accepted:
            at = next((i for i, n in names.items() if n == name), None)
            if at is not None and field not in pick:
                pick[field] = at
    missing = [f for f in ("event_id", "url") if f not in pick]
    if missing:
        raise ValueError(f"{path}: no column for {missing}; headers are {raw.columns}")
    plain = raw.toDF(*[f"_{i}" for i in range(len(raw.columns))])
    return plain.select(*[(F.col(f"_{pick[f]}") if f in pick else F.lit("")).alias(f) for f in HEADERS])


MANIFEST = "run_id string, script string, status string, started_at string, ended_at string, counts map<string,bigint>, errors array<string>, input_url string, _bad string"


def read_manifests(spark: SparkSession, root: str, pattern: str = "manifest.json") -> DataFrame:
    """All run manifests below a folder; duration where both times are known."""
    rows = (spark.read.schema(MANIFEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad")
            .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root))
    start, end = F.col("started_at").try_cast("timestamp"), F.col("ended_at").try_cast("timestamp")
    return rows.filter("_bad is null").drop("_bad").withColumns({"started_at": start, "ended_at": end}).withColumn(
        "duration_s", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def of_domain(df: DataFrame, part: str) -> DataFrame:
    """Rows whose event id names a domain; on a table partitioned by domain filter that column instead."""
    return df.filter(F.col("id_content").contains(part))


def name_of_event(events: DataFrame) -> DataFrame:
    """The three fields of an archive record."""
    return events.select("id_content", "ten_su_kien", "content")
