"""Serving tables and their queries: platforms, contents, listings, search inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import excerpt, squeeze, strip


def domain_of(event_id: Column, override: Column | None = None) -> Column:
    """Domain by id prefix; null when neither prefix nor override tells."""
    d = F.when(event_id.startswith("showbiz"), "showbiz").when(event_id.startswith("education"), "education")
    return F.coalesce(override, d) if override is not None else d


def display_name(post: Column, url: Column, chars: int = 80) -> Column:
    """First non-blank line of a post, clipped; else its link."""
    lines = F.filter(F.transform(F.split(F.coalesce(post, F.lit("")), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    cut = F.concat(F.regexp_replace(F.substring(first, 1, chars), r"\s+$", ""), F.lit("…"))
    return F.when(first.isNull(), url).when(F.length(first) <= chars, first).otherwise(cut)


def event_of_comment(comment_id: Column) -> Column:
    """Event id inside a comment id: its first two parts after the cmt_ prefix."""
    return F.substring_index(F.regexp_replace(comment_id, "^cmt_", ""), "_", 2)


# --- contents ------------------------------------------------------------------------------------
# --- fixed values: the content field inside broken JSON ------------------------------------------
CONTENT_FIELD = r'(?s)"content"\s*:\s*"(.*?)"\s*,\s*"[a-z_]+"\s*:'


def rescued_content(c: Column) -> Column:
    """Plain text as it is; the content field of nested JSON; of broken JSON by pattern; else without brackets."""
    raw = strip(F.coalesce(c, F.lit("")))
    parsed = F.get_json_object(raw, "$.content")
    found = F.regexp_extract(raw, CONTENT_FIELD, 1)
    plain = strip(F.replace(F.replace(F.replace(found, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" ")))
    loose = squeeze(F.regexp_replace(raw, r'[{}"\[\]]', " "))
    return (F.when(~raw.startswith("{"), raw).when(F.coalesce(parsed, F.lit("")) != "", strip(parsed))
            .when(found != "", plain).otherwise(loose))


def context_text(title: Column, content: Column, chars: int = 400) -> Column:
    """Title, then the start of the content, cut at a word."""
    t, b = squeeze(F.coalesce(title, F.lit(""))), squeeze(rescued_content(content))
    text = F.when((t != "") & (b != ""), F.concat(t, F.lit(". "), b)).otherwise(F.concat(t, b))
    head = F.substring(text, 1, chars)
    return F.when(F.length(text) <= chars, text).otherwise(F.regexp_replace(head, " [^ ]*$", ""))


def article_text(df: DataFrame, md: str, name: str = "article", chars: int = 1500, least: int = 60) -> DataFrame:
    """Adds the plain paragraphs of a Markdown page: no images, links as text, no short or repeated lines, up to
    `chars` characters (the line that reaches them is the last)."""
    t = F.regexp_replace(F.regexp_replace(F.col(md), r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    clean = lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"^[#>*\-\s|]+", ""), r"[*_`|]+", ""))
    df = df.withColumn("_l", F.array_distinct(F.filter(F.transform(F.split(t, "\n"), clean), lambda x: F.length(x) >= least)))
    upto = F.aggregate("_l", F.struct(F.lit(0).alias("size"), F.lit(0).alias("n")), lambda a, x: F.struct(
        F.when(a["size"] >= chars, a["size"]).otherwise(a["size"] + F.length(x)).alias("size"),
        F.when(a["size"] >= chars, a["n"]).otherwise(a["n"] + 1).alias("n")))["n"]
    return df.withColumn(name, F.substring(F.array_join(F.slice("_l", F.lit(1), upto), "\n"), 1, chars)).drop("_l")


IMAGE_TAGS = [("meta", "property", "og:image"), ("meta", "name", "og:image"), ("meta", "name", "twitter:image"),
              ("meta", "property", "twitter:image"), ("link", "rel", "image_src")]  # fixed values, in order of trust


def with_share_image(df: DataFrame, html: str, base: str, name: str = "image") -> DataFrame:
    """Adds the image a page offers for sharing, as an absolute link; attributes may come in any order."""
    from canopy.functions.links import first_match

    value_of = r"""(?is)\b(?:content|href)\s*=\s*["']\s*([^"']*?[^"'\s])\s*["']"""
    tags = [first_match(F.col(html), rf"""(?is)<{tag}\b(?=[^>]*\b{attr}\s*=\s*["']?{value}["'\s>/])[^>]*>""", 0) for tag, attr, value in IMAGE_TAGS]
    df = df.withColumn("_url", F.coalesce(*[first_match(t, value_of) for t in tags]))
    df = df.withColumns({"_root": F.regexp_extract(base, r"^[a-z]+://[^/?#]*", 0), "_page": F.regexp_extract(base, r"^[^?#]*", 0)})
    folder = F.when(F.col("_page") == F.col("_root"), F.concat("_page", F.lit("/"))).otherwise(F.regexp_replace("_page", "[^/]*$", ""))
    u = F.col("_url")
    return df.withColumn(name, F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("http"), u)
                         .when(u.startswith("/"), F.concat("_root", u)).when(u.isNotNull(), F.concat(folder, u))).drop("_url", "_root", "_page")


# --- serving tables ------------------------------------------------------------------------------
def event_table(web: DataFrame, hot: DataFrame, links: DataFrame) -> DataFrame:
    """Serving row per event: content, excerpt, platform, hot rank and counts. hot: id_content, rank, total, clean,
    trash; links: id_content, links, status, platform."""
    from canopy.functions.links import platform, preferred_platform

    h = hot.select("id_content", F.col("rank").alias("hot_rank"), *[F.col(c).alias(f"{c}_comments") for c in ["total", "clean", "trash"]])
    l = links.select("id_content", "links", "status", F.col("platform").alias("_p"))
    out = web.join(h, "id_content", "left").join(l, "id_content", "left").withColumn("content_full", rescued_content(F.col("content")))
    zero = {f"{c}_comments": F.coalesce(F.col(f"{c}_comments"), F.lit(0)) for c in ["total", "clean", "trash"]}
    return out.withColumns({
        **zero, "excerpt": excerpt(F.col("content_full")), "is_hot": F.col("hot_rank").isNotNull(), "status": F.coalesce("status", F.lit("")),
        "platform": platform(F.col("links"), F.col("source_url"), preferred_platform(F.col("platform"), F.col("_p")))}).drop("_p", "content")


def actor_table(web: DataFrame) -> DataFrame:
    """(id_content, name, role) of the named actors."""
    a = web.select("id_content", F.explode("actor_related").alias("a"))
    return a.filter("a.name is not null and a.name <> ''").select("id_content", "a.name", F.coalesce("a.role", F.lit("")).alias("role"))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as the listing's text filter compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def list_events(events: DataFrame, category: str | None = None, q: str | None = None, platform: str | None = None) -> DataFrame:
    """Events by platform (aliases resolved), category, and a text in title or content."""
    from canopy.functions.links import normal_platform

    out = events
    if platform and platform.strip():
        out = out.filter(F.lower(strip(F.coalesce("platform", F.lit("")))) == normal_platform(F.lit(platform)))
    if category:
        out = out.filter(F.col("danh_muc") == category)
    if q:
        text = ascii_lower(F.lit(q))
        out = out.filter(F.contains(ascii_lower(F.col("ten_su_kien")), text) | F.contains(ascii_lower(F.col("content_full")), text))
    return out


def page_of(events: DataFrame, page: int = 1, per_page: int = 12) -> DataFrame:
    """One page, most comments first."""
    return events.orderBy(F.col("total_comments").desc(), "id_content").offset((page - 1) * per_page).limit(per_page)


def page_count(events: DataFrame, per_page: int = 12) -> DataFrame:
    return events.agg(F.count("*").alias("total")).withColumn("total_pages", F.expr(f"(total + {per_page - 1}) div {per_page}"))


def hot_events(events: DataFrame, limit: int = 10, category: str | None = None) -> DataFrame:
    hot = events.filter("is_hot")
    hot = hot.filter(F.col("danh_muc") == category) if category else hot
    return hot.orderBy(F.col("total_comments").desc(), "id_content").limit(limit)


def categories(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("danh_muc").alias("name")).agg(F.count("*").alias("count"), F.sum("total_comments").alias("comments"))


def overall(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.sum("total_comments").alias("total_comments"), F.count_if("is_hot").alias("hot_events"))
