"""Raw crawl rows to the shared comment schema, and selection of what to crawl next.

Raw rows: seq (discovery order, unique), batch, author, profile_href, comment_href, reply_to_author, text, time,
scraped_at, post_url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import links as ln
from canopy.functions.text import fold, record_key, strip
from canopy.operators.ordering import buckets, first_row, last_before
from canopy.session import cut


def with_ids(raw: DataFrame) -> DataFrame:
    """Adds comment_id (permalink or hash), thread (top-level comment id), parent and post ids. Kept in the shared
    folder: the later steps read it several times, and links are parsed once."""
    rows = ln.with_comment_link(ln.with_comment_link(raw, "comment_href", "_l"), "profile_href", "_p")
    fallback = F.concat(F.lit("fbh_"), record_key(F.col("post_url"), F.col("author"), F.col("text")))
    return cut(rows.select(
        *raw.columns, F.coalesce("_l.comment_id", fallback).alias("comment_id"), F.col("_l.parent_id").alias("top_parent"),
        F.coalesce("_l.parent_id", "_l.comment_id").alias("thread"),
        F.coalesce("_l.post_id", "_p.post_id").alias("link_post")), "ids")


def nested_parents(rows: DataFrame) -> DataFrame:
    """Parent of nested replies: the latest earlier comment of the named author in the thread, else the thread's
    top comment. Every row offers itself under (thread, author) and, if it names an author, asks under (thread,
    named author); one as-of lookup over both kinds answers all."""
    offers = rows.filter("thread is not null").select(
        "batch", "thread", F.col("author").alias("who"), "seq", F.lit(1).alias("kind"), F.col("comment_id").alias("offer"))
    asks = rows.filter("top_parent is not null and reply_to_author <> ''").select(
        "batch", F.col("top_parent").alias("thread"), F.col("reply_to_author").alias("who"), "seq", F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("offer"))
    found = last_before(offers.unionByName(asks), ["batch", "thread", "who"], ["seq", "kind"], buckets("seq"), F.col("offer"), "found")
    found = found.filter("kind = 0").select("seq", "found")
    return rows.join(found, "seq", "left").withColumn("reply_to_id", F.coalesce("found", "top_parent")).drop("found")


def common_rows(raw: DataFrame, event_id: Column, platform: str = "facebook") -> DataFrame:
    """The shared schema: comment_id, event_id, post_id, platform, author_id, reply_to_id, ts, text (and seq)."""
    rows = nested_parents(with_ids(raw))
    post = F.coalesce(F.col("link_post"), ln.post_id(F.col("post_url")))
    rows = ln.with_author_id(rows, "profile_href").select(
        "batch", "seq", "comment_id", event_id.alias("event_id"), post.alias("post_id"), F.lit(platform).alias("platform"),
        "author_id", "reply_to_id",
        ln.approximate_time(F.col("time"), F.col("scraped_at")).alias("ts"), "text")
    return fill_post(rows)


def fill_post(rows: DataFrame) -> DataFrame:
    """Rows without a numeric post id take the first numeric one seen in their batch."""
    numeric = F.coalesce(F.col("post_id").rlike(r"^\d+$"), F.lit(False))
    known = cut(rows.filter(numeric).groupBy("batch").agg(F.min_by("post_id", "seq").alias("_known")), "known")
    out = rows.join(known, "batch", "left")
    return out.withColumn("post_id", F.when(numeric, F.col("post_id")).otherwise(F.coalesce("_known", "post_id"))).drop("_known")


def of_crawled_post(rows: DataFrame) -> DataFrame:
    """Rows of the post that was crawled, per batch: the most frequent post id among comments whose link belongs to
    the owner of post_url, else the most frequent overall; rows without a post id stay. Ties go to the id seen first."""
    same = F.coalesce(ln.owner(F.col("comment_href")) == ln.owner(F.col("post_url")), F.lit(False))
    counts = rows.filter("link_post is not null").groupBy("batch", "link_post").agg(
        F.count_if(same).alias("own"), F.min(F.when(same, F.col("seq"))).alias("own_first"), F.count("*").alias("n"), F.min("seq").alias("first"))
    any_own = counts.groupBy("batch").agg(F.max(F.col("own") > 0).alias("any_own"))
    ranked = counts.join(any_own, "batch").withColumn("votes", F.when(F.col("any_own"), F.col("own")).otherwise(F.col("n"))).withColumn(
        "since", F.when(F.col("any_own"), F.col("own_first")).otherwise(F.col("first"))).filter("votes > 0")
    main = cut(first_row(ranked, ["batch"], [F.col("votes").desc(), "since"]).select("batch", F.col("link_post").alias("main_post")), "main")
    return rows.join(main, "batch", "left").filter(
        "link_post is null or main_post is null or link_post = main_post").drop("main_post")


# --- what to crawl -------------------------------------------------------------------------------
# --- fixed values: accepted links and ids --------------------------------------------------------
EVENT_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"
LINK = r"https?://[^\s<>\"']+"
HOSTS = ["facebook.com", "fb.com", "fb.watch"]


def sheet_links(rows: DataFrame) -> DataFrame:
    """Link rows with a usable url: blank status becomes pending, counts lose their thousands commas."""
    s = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = F.regexp_replace(s("n_comments"), ",", "").try_cast("double").try_cast("int")
    status = F.lower(s("status"))
    return rows.select(
        s("event_id").alias("event_id"), s("event_name").alias("event_name"), s("page").alias("page"), s("url").alias("url"),
        F.coalesce(n, F.lit(0)).alias("n_comments"), F.when(status == "", "pending").otherwise(status).alias("status"), "seq"
    ).filter(F.col("url").startswith("http"))


def pending_jobs(rows: DataFrame) -> dict[str, DataFrame]:
    """Jobs (event, url, sheet rows) of the pending rows, and every violation. A batch with a violation is
    refused as a whole, so callers check that `violations` is empty. rows: number, id_content, event_name, links,
    status."""
    s = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    p = rows.select("number", s("id_content").alias("event_id"), s("event_name").alias("name"), s("links").alias("links"),
                    F.lower(s("status")).alias("status")).filter("status = 'pending'")
    p = p.withColumn("urls", F.regexp_extract_all("links", F.lit(LINK), 0))
    bad_row = F.when(~F.col("event_id").rlike(EVENT_ID) | (F.col("name") == ""), "needs event id and name").when(
        F.size("urls") == 0, "no url")
    links = p.select("number", "event_id", "name", F.explode("urls").alias("raw")).withColumn("raw", F.regexp_replace("raw", "[.,;]+$", ""))
    h = ln.host(F.col("raw"))
    accepted = (h.isin(HOSTS) | h.endswith(".facebook.com")) & ~F.contains(ln.netloc(F.col("raw")), F.lit("@"))
    query = F.regexp_extract("raw", r"(\?[^#]*)", 1)
    url = F.concat(ln.scheme(F.col("raw")), F.lit("://"), F.lower(ln.netloc(F.col("raw"))), F.regexp_replace(ln.path(F.col("raw")), "/+$", ""),
                   F.when(query == "?", "").otherwise(query))
    links = links.withColumn("ok", F.coalesce(accepted, F.lit(False))).withColumn("url", url)
    jobs = links.filter("ok").groupBy("event_id", "url").agg(
        F.min_by("name", "number").alias("event_name"), F.array_sort(F.collect_set("number")).alias("sheet_rows"))
    owners = links.filter("ok").groupBy("url").agg(F.countDistinct("event_id").alias("n"), F.max("number").alias("number"))
    names = p.groupBy("event_id").agg(F.countDistinct("name").alias("n"), F.max("number").alias("number"))
    row = lambda df, why: df.select("number", (F.lit(why) if isinstance(why, str) else why).alias("problem"))
    violations = (
        row(p.filter(bad_row.isNotNull()), bad_row)
        .unionByName(row(links.filter("not ok"), "host not accepted"))
        .unionByName(row(owners.filter("n > 1"), "url under two events"))
        .unionByName(row(names.filter("n > 1"), "two names for one event")))
    return {"jobs": jobs, "violations": violations}


def canonical_header(name: Column) -> Column:
    """Header text without accents, case and extra spaces."""
    return F.trim(F.regexp_replace(fold(name), r"\s+", " "))


# --- replies by author name ----------------------------------------------------------------------
def thread_by_author(tops: DataFrame, replies: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Replies that name their parent's author, attached to that author's thread. Reply authors found in one round
    can be named in the next, until a round finds nothing more. tops: event_id, seq, author, comment_id; replies:
    event_id, seq, author, parent_author. An author's first thread counts; unmatched replies have no thread."""
    known = cut(first_row(tops.select("event_id", "author", F.col("comment_id").alias("thread"), "seq").filter("author <> ''"),
                          ["event_id", "author"], ["seq"]).select("event_id", "author", "thread"), "authors")
    open_, done, rounds = replies, None, 0
    while True:
        k = known.select("event_id", F.col("author").alias("parent_author"), "thread")
        hit = cut(open_.join(k, ["event_id", "parent_author"], "left"), "matched")
        found, open_ = hit.filter("thread is not null"), hit.filter("thread is null").drop("thread")
        done = found if done is None else done.unionByName(found)
        rounds += 1
        fresh = first_row(found.filter("author <> ''").select("event_id", "author", "thread", "seq"), ["event_id", "author"], ["seq"]).select(
            "event_id", "author", "thread").join(known, ["event_id", "author"], "left_anti")
        fresh = cut(fresh, "authors")
        if fresh.isEmpty() or rounds == max_rounds:
            break
        known = known.unionByName(fresh)
    return done.unionByName(open_.withColumn("thread", F.lit(None).cast("string")))
