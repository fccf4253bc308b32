"""Column functions over links: query parameters, hosts, ids inside permalinks, platforms, relative time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import strip

# --- fixed values: link shapes of the crawled platform -------------------------------------------
COMMENT_KEY = r"^comment:(\d+)_(\d+)$"
NOT_A_PROFILE = ["photo", "photo.php", "watch", "groups", "hashtag", "share", "story.php", "permalink.php", "posts",
                 "reel", "events", "pages", "login", "help"]
NOT_AN_OWNER = ["share", "permalink.php", "story.php"]
POST_PATH = r"/(?:posts|permalink|videos|reel)/([\w]+)"
SHARED_HOST = "facebook.com"
TIME_PATTERN = (r"(\d+|a|an|một)\s*(giây|phút|giờ|ngày|tuần|tháng|năm|seconds?|minutes?|hours?|days?|weeks?|months?|years?"
                r"|mins?|hrs?|mo|s|m|h|d|w|y)")
NOW_PATTERN = "vừa xong|vài giây|just now|few seconds"
YESTERDAY_PATTERN = "hôm qua|yesterday"


def none(c: Column) -> Column:
    """Empty string -> null."""
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one; c is evaluated once."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(0))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; null when there is none."""
    h = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", "")
    return first_match(F.lower(h), r"^(.*?[^.])\.*$")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def param(url: Column, key: str) -> Column:
    """First non-blank value of a query parameter, decoded; null without one."""
    return F.try_url_decode(first_match(url, rf"^[^?#]*\?(?:[^#]*?&)?{key}=([^&#]+)"))


def with_comment_link(df: DataFrame, href: str, name: str) -> DataFrame:
    """Adds struct(comment_id, parent_id, post_id) of a comment permalink: ids are bare numbers,
    comment:<post>_<id>, or the base64 of the latter. For a reply the parent is the top-level comment of its thread.
    Built in steps, so that each step's value is computed once."""
    top, reply = f"_{name}_top", f"_{name}_reply"
    each = lambda df, f: df.withColumns({c: f(F.col(c)) for c in (top, reply)})
    df = df.withColumns({top: param(F.col(href), "comment_id"), reply: param(F.col(href), "reply_comment_id")})
    df = each(df, lambda c: strip(F.coalesce(F.try_url_decode(c), c)))
    plain = lambda c: c.rlike(r"^\d+$") | c.rlike(COMMENT_KEY)
    padded = lambda c: F.rpad(c, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    df = each(df, lambda c: F.when(plain(c), c).otherwise(F.try_to_binary(padded(c), F.lit("base64")).cast("string")))
    df = each(df, lambda c: F.when(plain(c), c))
    cid = lambda c: first_match(c, r"(\d+)$")
    post = lambda c: first_match(c, COMMENT_KEY)
    t, r = F.col(top), F.col(reply)
    return df.withColumn(name, F.struct(
        F.coalesce(cid(r), cid(t)).alias("comment_id"), F.when(r.isNotNull(), cid(t)).alias("parent_id"),
        F.coalesce(post(r), post(t)).alias("post_id"))).drop(top, reply)


def with_author_id(df: DataFrame, href: str, name: str = "author_id") -> DataFrame:
    """Adds the numeric id or user name of a profile link."""
    link = F.col(href)
    df = df.withColumns({"_parts": path_parts(link), "_host": F.coalesce(none(netloc(link)), F.lit(SHARED_HOST)),
                         "_path": F.regexp_replace(path(link), "/+$", "")})
    at = lambda i: F.get("_parts", F.lit(i))
    user = F.array_position("_parts", "user")
    unknown = link.isNull() | (link == "") | ~F.contains(F.col("_host"), F.lit(SHARED_HOST))
    return df.withColumn(name, (
        F.when(unknown, F.lit(None).cast("string"))
        .when(F.col("_path").endswith("profile.php"), param(link, "id"))
        .when((at(0) == "people") & (F.size("_parts") >= 3), at(2))
        .when(user > 0, F.get("_parts", user.cast("int")))
        .when(~F.lower(at(0)).isin(NOT_A_PROFILE), at(0)))).drop("_parts", "_host", "_path")


def post_id(url: Column) -> Column:
    """Post id from the post's own link."""
    return F.coalesce(param(url, "story_fbid"), param(url, "fbid"), first_match(path(url), POST_PATH))


def owner(url: Column) -> Column:
    """Page or group that owns a post link."""
    parts = path_parts(url)
    first = F.get(parts, F.lit(0))
    group = F.concat_ws("/", first, F.get(parts, F.lit(1)))
    return F.when(first.isNull() | first.isin(NOT_AN_OWNER), F.lit(None).cast("string")).when(
        (first == "groups") & (F.size(parts) > 1), group).otherwise(first)


def approximate_time(shown: Column, scraped_at: Column) -> Column:
    """'8 giờ trước', '3 weeks ago', 'Hôm qua' relative to the scrape -> timestamp; null if unreadable."""
    t = F.lower(strip(shown))
    end = r"(?![\p{L}\p{N}_])"
    number = F.regexp_extract(t, TIME_PATTERN + end, 1)
    unit = F.regexp_extract(t, TIME_PATTERN + end, 2)
    units = F.create_map(*[F.lit(x) for kv in vocab.UNIT_SECONDS.items() for x in kv])
    size = F.coalesce(F.try_element_at(units, unit), F.try_element_at(units, F.regexp_replace(unit, "s+$", "")))
    n = F.when(number.isin("a", "an", "một"), F.lit(1).cast("long")).otherwise(number.try_cast("long"))
    delta = F.when(t.rlike(NOW_PATTERN), F.lit(0).cast("long")).when(t.rlike(YESTERDAY_PATTERN), F.lit(86400).cast("long")).when(
        unit != "", n * size)
    zoned = scraped_at.rlike(r"(Z|[+-]\d{2}:?\d{2})$")  # a time without zone is UTC
    base = F.when(zoned, scraped_at).otherwise(F.concat(scraped_at, F.lit("Z"))).try_cast("timestamp")
    return F.timestamp_micros(F.unix_micros(base) - delta * 1_000_000)


def normal_platform(c: Column) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = v
    for alias, name in vocab.PLATFORM_ALIASES.items():
        out = F.when(v == alias, name).otherwise(out)
    return out


def preferred_platform(*values: Column) -> Column:
    """First value that names a platform."""
    return F.coalesce(*[F.when(~normal_platform(v).isin("", "unknown"), normal_platform(v)) for v in values])


def link_platform(url: Column) -> Column:
    """Platform of one link; news for any other web host; null when it is no web link."""
    u = strip(url)
    h = host(u)
    out = F.when(~scheme(u).isin("http", "https", "hhttps") | h.isNull(), F.lit(None).cast("string"))
    for domain, name in vocab.SOCIAL_DOMAINS.items():
        out = out.when((h == domain) | h.endswith("." + domain), name)
    return out.otherwise("news")


def platform(links: Column, source_url: Column, explicit: Column) -> Column:
    """Explicit platform, else that of the first valid link, else unknown."""
    all_links = F.concat(F.coalesce(links, F.array().cast("array<string>")), F.array(source_url))
    known = F.filter(F.transform(all_links, link_platform), lambda p: p.isNotNull())
    return F.coalesce(preferred_platform(explicit), F.get(known, F.lit(0)), F.lit("unknown"))


def web_first(links: Column) -> Column:
    """Links with web pages before pages of the shared social host."""
    social = lambda u: F.coalesce(netloc(u).rlike(r"facebook\.com|fb\.com|fb\.watch"), F.lit(False))
    return F.concat(F.filter(links, lambda u: ~social(u)), F.filter(links, social))
