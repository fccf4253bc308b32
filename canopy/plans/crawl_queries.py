"""Links, times and crawl rows, over pages and over permalinks derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions import links as ln
from canopy.functions.text import strip
from canopy.operators import crawl
from canopy.plans.tables import Catalog, table

catalog = Catalog()

_TIMES = {"click": "8 giờ trước", "view": "3 weeks ago", "error": "Hôm qua", "signup": "khoảng một ngày", "purchase": "sometime"}
_SHOWN = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TIMES.items()) + " END"
_SECONDS = "CASE event_type WHEN 'click' THEN 28800 WHEN 'view' THEN 1814400 WHEN 'error' THEN 86400 WHEN 'signup' THEN 86400 END"
# Four events form one thread: the first is the top comment, the others reply; later ones name an author.
RAW_SQL = f"""raw AS (
  SELECT event_id AS seq, 'b' || (user_id % 7) AS batch, 'u' || (user_id % 3) AS author,
         (event_id - event_id % 4)::VARCHAR AS top, CASE WHEN event_id % 4 > 0 THEN event_id::VARCHAR END AS reply,
         CASE WHEN event_id % 4 >= 2 THEN 'u' || (event_id % 3) END AS reply_to_author, event_type, ts, user_id,
         (1000 + user_id % 7 + CASE WHEN event_id % 10 = 0 THEN 500 ELSE 0 END)::VARCHAR AS post,
         event_id % 5 = 0 AS has_post
  FROM events)"""


def raw(spark, sf):
    e = table(spark, sf, "events")
    s = lambda c: c.cast("string")
    page = (F.col("user_id") % 7).cast("string")
    post = F.col("user_id") % 7 + 1000 + F.when(F.col("event_id") % 10 == 0, 500).otherwise(0)
    owner = F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.concat(F.lit("page"), page))
    top, me = s(F.col("event_id") - F.col("event_id") % 4), s(F.col("event_id"))
    href = F.concat(F.lit("https://www.facebook.com/"), owner, F.lit("/posts/pfbid02?comment_id="), top,
                    F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("&reply_comment_id="), me)).otherwise(""))
    key = F.base64(F.concat(F.lit("comment:"), post, F.lit("_"), me).cast("binary"))
    profile = F.concat(F.lit("https://www.facebook.com/profile.php?id="), s(F.col("user_id")),
                       F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("&comment_id="), F.url_encode(key))).otherwise(""))
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in _TIMES.items() for x in kv]), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("b"), page).alias("batch"),
        F.concat(F.lit("u"), F.col("user_id") % 3).alias("author"), profile.alias("profile_href"), href.alias("comment_href"),
        F.when(F.col("event_id") % 4 >= 2, F.concat(F.lit("u"), F.col("event_id") % 3)).alias("reply_to_author"),
        F.col("props").alias("text"), shown.alias("time"), F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("scraped_at"),
        F.concat(F.lit("https://www.facebook.com/page"), page, F.lit("/posts/pfbid02")).alias("post_url"))


@catalog.add("t8_link_ids", f"""WITH {RAW_SQL}
SELECT seq, coalesce(reply, top) AS comment_id, CASE WHEN reply IS NOT NULL THEN top END AS parent_id,
       CASE WHEN has_post THEN post END AS post_id, user_id::VARCHAR AS author_id,
       CASE WHEN seq % 10 = 0 THEN 'other' ELSE 'page' || user_id % 7 END AS owner FROM raw""")
def t8_link_ids(spark, sf):
    r = ln.with_comment_link(ln.with_comment_link(raw(spark, sf), "comment_href", "own"), "profile_href", "profile")
    r = ln.with_author_id(r, "profile_href")
    return r.select("seq", "own.comment_id", "own.parent_id", F.coalesce("own.post_id", "profile.post_id").alias("post_id"),
                    "author_id", ln.owner(F.col("comment_href")).alias("owner"))


@catalog.add("t7_relative_time", f"""WITH {RAW_SQL}
SELECT seq, epoch_us(ts) - ({_SECONDS})::BIGINT * 1000000 AS micros FROM raw""")
def t7_relative_time(spark, sf):
    t = ln.approximate_time(F.col("time"), F.col("scraped_at"))
    return raw(spark, sf).select("seq", F.unix_micros(t).alias("micros"))


_PARENT = f"""WITH {RAW_SQL}, ids AS (SELECT *, coalesce(reply, top) AS comment_id FROM raw),
near AS (SELECT a.seq, max_by(b.comment_id, b.seq) AS found FROM ids a JOIN ids b
         ON b.batch = a.batch AND b.top = a.top AND b.author = a.reply_to_author AND b.seq < a.seq
         WHERE a.reply IS NOT NULL GROUP BY a.seq),
parents AS (SELECT ids.*, CASE WHEN reply IS NOT NULL THEN coalesce(found, top) END AS reply_to_id FROM ids LEFT JOIN near USING (seq))"""


@catalog.add("j7_nested_parents", _PARENT + "SELECT seq, comment_id, reply_to_id FROM parents")
def j7_nested_parents(spark, sf):
    """Also W7: the as-of parent."""
    return crawl.nested_parents(crawl.with_ids(raw(spark, sf))).select("seq", "comment_id", "reply_to_id")


@catalog.add("t9_common_rows", _PARENT + f""", known AS (SELECT batch, min_by(post, seq) AS known FROM parents WHERE has_post GROUP BY batch)
SELECT seq, comment_id, 'ev' || batch AS event_id, CASE WHEN has_post THEN post ELSE coalesce(known, 'pfbid02') END AS post_id,
       'facebook' AS platform, user_id::VARCHAR AS author_id, reply_to_id, epoch_us(ts) - ({_SECONDS})::BIGINT * 1000000 AS ts_micros
FROM parents LEFT JOIN known USING (batch)""")
def t9_common_rows(spark, sf):
    """Also W8: the back-filled post id."""
    rows = crawl.common_rows(raw(spark, sf), F.concat(F.lit("ev"), F.col("batch")))
    return rows.withColumn("ts_micros", F.unix_micros("ts")).select(
        "seq", "comment_id", "event_id", "post_id", "platform", "author_id", "reply_to_id", "ts_micros")


@catalog.add("f10_crawled_post", f"""WITH {RAW_SQL}, p AS (SELECT *, CASE WHEN has_post THEN post END AS link_post FROM raw),
votes AS (SELECT batch, link_post, count(*) FILTER (seq % 10 <> 0) AS own, min(seq) FILTER (seq % 10 <> 0) AS f FROM p
          WHERE link_post IS NOT NULL GROUP BY ALL),
main AS (SELECT batch, link_post AS main_post FROM votes WHERE own > 0
         QUALIFY row_number() OVER (PARTITION BY batch ORDER BY own DESC, f) = 1)
SELECT seq FROM p LEFT JOIN main USING (batch) WHERE link_post IS NULL OR main_post IS NULL OR link_post = main_post""")
def f10_crawled_post(spark, sf):
    return crawl.of_crawled_post(crawl.with_ids(raw(spark, sf))).select("seq")


@catalog.add("t10_platforms", r"""
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'facebook' WHEN page_id % 7 = 0 THEN 'youtube' WHEN page_id % 5 = 0 THEN 'news'
       WHEN page_id % 3 = 0 THEN 'news' ELSE 'unknown' END AS platform FROM pages""")
def t10_platforms(spark, sf):
    """Explicit alias, sub-domain of a social host, look-alike host, odd scheme, no link."""
    p = F.col("page_id")
    link = (F.when(p % 11 == 0, F.lit("https://x.example/")).when(p % 7 == 0, F.concat(F.lit("hhttps://m.youtube.com./"), p))
            .when(p % 5 == 0, F.lit("https://notfacebook.com/a")).when(p % 3 == 0, F.col("url")).otherwise("mailto:a@b.example"))
    explicit = F.when(p % 11 == 0, " FB ").otherwise("unknown")
    return table(spark, sf, "pages").select("page_id", ln.platform(F.array(link), F.lit(None).cast("string"), explicit).alias("platform"))


@catalog.add("t10_url_hosts", r"""
SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages) GROUP BY ALL""")
def t10_url_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(ln.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@catalog.add("a29_platform_repair", """
SELECT CASE WHEN page_id % 2 = 0 THEN 'news' ELSE 'unknown' END AS before,
       CASE WHEN page_id % 3 = 0 THEN 'tiktok' ELSE 'news' END AS after, count(*) AS n FROM pages GROUP BY ALL""")
def a29_platform_repair(spark, sf):
    """Events by platform before and after resolving it again from their links."""
    p = F.col("page_id")
    link = F.when(p % 3 == 0, F.lit("https://www.tiktok.com/@a")).otherwise(F.col("url"))
    before = F.when(p % 2 == 0, "news").otherwise("unknown")
    after = ln.platform(F.array(link), F.lit(None).cast("string"), F.when(before != "news", before))
    return table(spark, sf, "pages").groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@catalog.add("t20_web_first", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url END || ' https://m.facebook.com/' || page_id AS links FROM pages""")
def t20_web_first(spark, sf):
    links = F.array(F.concat(F.lit("https://m.facebook.com/"), "page_id"), F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.array_join(ln.web_first(links), " ").alias("links"))


@catalog.add("s7_link_rows", """
SELECT 'e' || page_id % 9 AS event_id, url, (page_id * 37)::INTEGER AS n_comments,
       CASE WHEN page_id % 4 = 0 THEN 'pending' ELSE 'done' END AS status FROM pages WHERE page_id % 6 <> 0""")
def s7_link_rows(spark, sf):
    p = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        F.concat(F.lit(" e"), p % 9).alias("event_id"), F.lit("name").alias("event_name"), F.lit("page").alias("page"),
        F.when(p % 6 == 0, "note").otherwise(F.col("url")).alias("url"), F.format_number(p * 37, 0).alias("n_comments"),
        F.when(p % 4 == 0, " ").otherwise("Done").alias("status"), p.alias("seq"))
    return crawl.sheet_links(rows).select("event_id", "url", "n_comments", "status")


def _sheet(spark, sf):
    p = F.col("page_id")
    link = F.concat(F.lit("see https://www.FACEBOOK.com/p"), p % 50, F.lit("/ and https://fb.watch/v"), p, F.lit("."))
    return table(spark, sf, "pages").select(
        p.alias("number"), F.concat(F.lit("ev"), p % 50).alias("id_content"),
        F.when((p >= 50) & (p % 50 == 3), "other name").otherwise("name").alias("event_name"),
        F.when(p % 40 == 7, F.lit("https://evil.example/x")).when(p % 40 == 9, "none").otherwise(link).alias("links"),
        F.when(p % 2 == 1, " Pending ").otherwise("done").alias("status"))


@catalog.add("f11_pending_jobs", """
WITH s AS (SELECT page_id AS p FROM pages WHERE page_id % 2 = 1 AND page_id % 40 NOT IN (7, 9)),
u AS (SELECT p, 'https://www.facebook.com/p' || p % 50 AS url FROM s UNION ALL SELECT p, 'https://fb.watch/v' || p FROM s)
SELECT 'ev' || p % 50 AS event_id, url, count(DISTINCT p) AS n_rows FROM u GROUP BY ALL""")
def f11_pending_jobs(spark, sf):
    return crawl.pending_jobs(_sheet(spark, sf))["jobs"].select("event_id", "url", F.size("sheet_rows").cast("long").alias("n_rows"))


@catalog.add("f11_violations", """
WITH s AS (SELECT page_id AS p FROM pages WHERE page_id % 2 = 1)
SELECT 'host not accepted' AS problem, count(*) AS n FROM s WHERE p % 40 = 7 HAVING count(*) > 0
UNION ALL SELECT 'no url', count(*) FROM s WHERE p % 40 = 9 HAVING count(*) > 0
UNION ALL SELECT 'two names for one event', 1 FROM s WHERE p % 50 = 3 HAVING count(*) > 1""")
def f11_violations(spark, sf):
    return crawl.pending_jobs(_sheet(spark, sf))["violations"].groupBy("problem").agg(F.count("*").alias("n"))


@catalog.add("j8_threads_by_author", """
WITH RECURSIVE t AS (SELECT event_id, user_id FROM events),
hop AS (SELECT event_id, event_id AS up, 0 AS d FROM t WHERE event_id % 5 = 0
        UNION ALL SELECT t.event_id, h.up, h.d + 1 FROM hop h JOIN t ON t.event_id = h.event_id + 1 AND t.event_id % 5 BETWEEN 1 AND 3)
SELECT t.event_id AS seq, 'c' || h.up AS thread FROM t LEFT JOIN hop h USING (event_id) WHERE t.event_id % 5 > 0""")
def j8_threads_by_author(spark, sf):
    """Reply n names the author of reply n - 1; the fifth of every five names nobody known."""
    e = table(spark, sf, "events").select("event_id").withColumn("g", F.lit("e"))
    who = lambda c: F.concat(F.lit("a"), c)
    tops = e.filter("event_id % 5 = 0").select(F.col("g").alias("event_id"), F.col("event_id").alias("seq"), who(F.col("event_id")).alias("author"),
                                               F.concat(F.lit("c"), F.col("event_id")).alias("comment_id"))
    replies = e.filter("event_id % 5 > 0").select(
        F.col("g").alias("event_id"), F.col("event_id").alias("seq"), who(F.col("event_id")).alias("author"),
        F.when(F.col("event_id") % 5 == 4, "nobody").otherwise(who(F.col("event_id") - 1)).alias("parent_author"))
    return crawl.thread_by_author(tops, replies).select("seq", "thread")


@catalog.add("t27_display_names", """
WITH d AS (SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS f FROM documents)
SELECT doc_id, CASE WHEN f IS NULL THEN 'url' WHEN length(f) <= 80 THEN f ELSE rtrim(substr(f, 1, 80)) || '…' END AS name FROM d""")
def t27_display_names(spark, sf):
    from canopy.operators.serving import display_name

    return table(spark, sf, "documents").select("doc_id", display_name(F.col("text"), F.lit("url")).alias("name"))


@catalog.add("t26_event_of_comment", """
SELECT page_id, 'news_' || page_id % 9 AS event_id FROM pages""")
def t26_event_of_comment(spark, sf):
    from canopy.operators.serving import event_of_comment

    p = F.col("page_id")
    cid = F.concat(F.lit("cmt_news_"), p % 9, F.lit("_000"), p)
    return table(spark, sf, "pages").select("page_id", event_of_comment(cid).alias("event_id"))
