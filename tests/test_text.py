import base64
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from canopy.functions import links as ln
from canopy.functions import noise
from canopy.functions.text import fold, percent, round_exact, to_int
from canopy.functions.tokens import drop_name_tag, tokens
from canopy.operators import search, serving


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


LIGHT = [
    (None, "missing"), ("", "too_short"), ("  ab ", "too_short"), ("...!", "no_word"), ("😍😍😍", "no_word"), ("___", "no_word"),
    ("12345", "digits"), ("Hhh h", "repeated"), ("haha", "interjection"), (" vâng ", "interjection"), ("Hà Thị Nga", "name_tag"),
    ("đúng", "name_tag"), ("Nguyễn Văn A", "name_tag"), ("A B C", None), ("Mai ơi, hôm nay 3 giờ", None), ("Tên Tôi Là Ai Thế Nhỉ", None),
]


def test_light_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LIGHT)], "i int, t string")
    got = {r["i"]: r["w"] for r in rows.select("i", noise.light_reason(F.col("t")).alias("w")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LIGHT)}


STRICT = [
    ("a b", "too_short"), ("1234567", "no_letter"), ("hahaa", "laughter"), ("xem https://a.b/c nhé các bạn ơi", "link"),
    ("học ở trường THPT nào vậy", "school_page"), ("vào abc.vn mà xem đi các bạn", "host"), ("@an @binh ơi", "mention"),
    ("@an ơi em nghĩ thế nào về việc này", None), ("chia share cho mọi người cùng biết", "spam_word"), ("Lan Anh", "name_only"),
    ("Lan Anh " + "x" * 29, "name_prefix"), ("Lan Anh " + "x" * 30, None), ("Lan Anh 😂😂", "name_prefix"), ("hôm nay trời đẹp quá", None),
]


def test_strict_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRICT)], "i int, t string")
    got = {r["i"]: r["w"] for r in rows.select("i", noise.strict_reason(F.col("t")).alias("w")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(STRICT)}


def test_rounding_follows_the_binary_value(spark):
    pairs = [(p, w) for w in range(1, 90) for p in range(w + 1)]
    df = spark.createDataFrame(pairs, "p long, w long").select("p", "w", percent(F.col("p"), F.col("w")).alias("s"), round_exact(F.col("p") / F.col("w"), 3).alias("r"))
    for r in df.collect():
        assert r["s"] == f"{r['p'] / r['w'] * 100:.1f}%"
        assert r["r"] == round(Fraction(r["p"] / r["w"]) * 1000)


def test_small_functions(spark):
    assert one(spark, "145.7", to_int) == 145 and one(spark, "x", to_int) == 0
    assert one(spark, "Đường Ướt ÑANDÚ", fold) == "duong uot nandu"
    assert one(spark, "Tin_tức: (HOT) _!_ x_y…", tokens) == ["tin_tức", "hot", "x_y"]
    assert one(spark, "Thùy Vân không dám ra", drop_name_tag) == "không dám ra"
    assert one(spark, "Bộ Giáo dục cần xử lý", drop_name_tag) == "Bộ Giáo dục cần xử lý"


@pytest.mark.parametrize("shown,seconds", [
    ("8 giờ trước", 28800), ("khoảng 1 giờ trước", 3600), ("3 weeks ago", 1814400), ("an hour ago", 3600), ("Hôm qua", 86400), ("Vừa xong", 0),
    ("2 mins", 120), ("5m", 300), ("1 mo", 2592000), ("lúc nào đó", None)])
def test_relative_time(spark, shown, seconds):
    f = lambda c: F.unix_seconds(ln.approximate_time(c, F.lit("2026-01-02T00:00:00Z")))
    got = one(spark, shown, f)
    assert got == (None if seconds is None else 1767312000 - seconds)


def test_links(spark):
    key = base64.b64encode(b"comment:77_99").decode()
    rows = [("https://www.facebook.com/p/posts/pf?comment_id=5", None), ("https://x/?a=1&comment_id=5&reply_comment_id=6#f", None),
            (f"https://x/?comment_id={key.replace('=', '%3D')}", None), ("https://x/#comment_id=5", None), (None, None)]
    df = ln.with_comment_link(spark.createDataFrame(rows, "h string, z string"), "h", "l")
    got = [tuple(r["l"]) for r in df.collect()]
    assert got == [("5", None, None), ("6", "5", None), ("99", None, "77"), (None, None, None), (None, None, None)]
    people = [("https://www.facebook.com/profile.php?id=12&x=1", "12"), ("https://www.facebook.com/people/A-B/777/", "777"),
              ("https://www.facebook.com/groups/5/user/9/", "9"), ("/some.name?x", "some.name"), ("https://www.facebook.com/photo/?f", None),
              ("https://other.example/abc", None)]
    df = ln.with_author_id(spark.createDataFrame(people, "h string, want string"), "h")
    assert all(r["author_id"] == r["want"] for r in df.collect())
    hosts = [("https://facebook.com.evil.example/", "news"), ("hhttps://fb.watch/x", "facebook"), ("https://m.tiktok.com/@a", "tiktok"), ("ftp://youtube.com", None)]
    df = spark.createDataFrame(hosts, "h string, want string").withColumn("got", ln.link_platform(F.col("h")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_contents(spark):
    assert one(spark, '{"content": " a b ", "x": 1}', serving.rescued_content) == "a b"
    assert one(spark, '{"content": "say "hi" \\"now\\"", "actor_related": []}', serving.rescued_content) == 'say "hi" "now"'
    assert one(spark, "{a [b] \"c\"", serving.rescued_content) == "a b c"
    md = "# Menu\n![i](x.png)\n" + "word " * 20 + "\n" + "word " * 20 + "\n[" + "link " * 15 + "](http://a)\n"
    got = serving.article_text(spark.createDataFrame([(md,)], "m string"), "m").first()["article"]
    assert got == ("word " * 20).strip() + "\n" + ("link " * 15).strip()


def test_news_queries(spark):
    rows = [("Hiền Hồ dạo này thế nào rồi?", "Hiền Hồ"), ("drama giáo dục gần đây", "giáo dục"), ("có gì mới không", ""), ("Vụ cô giáo Trang mới nhất!", "cô giáo Trang")]
    df = search.news_queries(spark.createDataFrame(rows, "message string, want string"))
    got = {r["message"]: (r["keywords"], r["generic"], r["query"]) for r in df.collect()}
    assert all(got[m][0] == w for m, w in rows)
    assert got["drama giáo dục gần đây"][1:] == (True, "giáo dục gây xôn xao")
    assert got["có gì mới không"][1:] == (True, "ồn ào showbiz Việt")


def test_routes(spark):
    rows = [("đm mày", None, False, "spam"), ("xin chào bạn", None, False, "greeting"), ("bạn là ai", None, False, "info"), ("top drama", None, False, "insights_top"),
            ("thống kê toàn hệ thống", None, False, "insights_stats"), ("có gì mới không", None, False, "clarify"), ("có gì mới không", None, True, "event_followup_live"),
            ("vụ đó thế nào", None, True, "event_followup"), ("chuyện của Jack", 30.0, False, "event"), ("thời tiết đẹp", None, False, "unrelated")]
    df = spark.createDataFrame(rows, "message string, best double, has_session boolean, want string")
    out = search.route(search.flag_intents(search.news_queries(df)))
    assert [(r["message"], r["intent"]) for r in out.collect() if r["intent"] != r["want"]] == []
