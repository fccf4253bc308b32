"""Comment trees: flatten nested documents, build threads from parent ids, nest them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import null_parent, strip, to_int
from canopy.operators.ordering import buckets, first_row, last_before, number_rows, running_sum, spread_rows
from canopy.session import cut

NODE = """array<struct<comment_id:string,`order`:string,reply_to_id:string,text:string,likes:string,
reply_count:string,replies:string>>"""
DOCUMENT = "id_content string, event_name string, sort_mode string, post_content string, comments string"


# --- flatten -------------------------------------------------------------------------------------
def flatten_two_levels(posts: DataFrame) -> DataFrame:
    """Roots (depth 0) and their replies (depth 1) of typed post documents, one scan of the input."""
    root = posts.select("id_content", "event_name", F.explode("comments").alias("c"))
    same = lambda c, parent, depth: F.struct(
        c["comment_id"].alias("comment_id"), parent.alias("parent_comment_id"), c["order"].alias("order"),
        c["text"].alias("text"), c["likes"].alias("likes"), F.lit(depth).alias("depth"))
    replies = F.transform(F.coalesce("c.replies", F.array()), lambda r: same(r, F.col("c.comment_id"), 1))
    first = F.array(same(F.col("c"), F.lit(None).cast("string"), 0))
    return root.select("id_content", "event_name", F.explode(F.concat(first, replies)).alias("n")).select(
        "id_content", "event_name", "n.*")


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Nodes of nested documents of any depth, with path (array positions from the root): sorting by path is
    depth-first order. The parent is the place in the tree, not reply_to_id. docs has id_content and the
    comments as JSON text; each level parses its replies from the text the level above left unparsed."""
    level = docs.select("id_content", F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("path"),
                        F.col("comments").alias("replies"))
    parts, depth = [], 1
    while True:
        nodes = level.filter("replies is not null").select(
            "id_content", "parent_id", "path", F.posexplode(F.from_json("replies", NODE)).alias("pos", "n"))
        nodes = nodes.filter("n is not null").select(
            "id_content", F.col("n.comment_id").alias("comment_id"), "parent_id", F.col("n.reply_to_id").alias("reply_to_id"),
            F.lit(depth).alias("level"), F.concat("path", F.array("pos")).alias("path"), F.col("n.text").alias("text"),
            to_int(F.col("n.likes")).alias("likes"), to_int(F.col("n.reply_count")).alias("reply_count"),
            F.col("n.replies").alias("replies"))
        nodes = cut(nodes, "level")
        if nodes.isEmpty():
            break
        parts.append(nodes.drop("replies"))
        level = nodes.select("id_content", F.col("comment_id").alias("parent_id"), "path", "replies")
        depth += 1
    out = parts[0] if parts else nodes.drop("replies")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- threads from parent ids ---------------------------------------------------------------------
def keep_first(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return first_row(df, keys, [F.col(seq)])


def keep_last(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return first_row(df, keys, [F.col(seq).desc()])


def valid_parents(rows: DataFrame) -> DataFrame:
    """Adds parent (null when missing, absent or the row itself) and orphan (had a parent id that is not
    usable). rows: event_id, comment_id (unique per event), parent_id."""
    ids = rows.select(F.col("event_id").alias("_event"), F.col("comment_id").alias("parent"))
    asked = rows.withColumn("_asked", null_parent(F.col("parent_id")))
    on = (F.col("event_id") == F.col("_event")) & (F.col("_asked") == F.col("parent")) & (F.col("_asked") != F.col("comment_id"))
    out = asked.join(ids, on, "left").drop("_event")
    return out.withColumn("orphan", F.col("_asked").isNotNull() & F.col("parent").isNull()).drop("_asked")


def build_threads(rows: DataFrame) -> DataFrame:
    """root_id, level and orphan per comment, for trees of any depth and for parent cycles.

    Each round doubles how far a row sees up its parent chain, so depth d takes log2(d) joins. A row carries the
    2^k-th ancestor (ptr), the steps to it (dist), and the earliest row on the way (low). While a row that has a
    root is open, every round closes some rows; so once a round closes none, all open rows sit on or below a
    cycle. When 2^k has reached their number they have seen their whole cycle: the earliest row in sight becomes an
    orphan root, which is where a walk in source order would have entered.
    """
    first = valid_parents(keep_first(rows, ["event_id", "comment_id"]))
    base = cut(first.select("event_id", "comment_id", "parent", "orphan", "seq"), "parents")
    low = lambda seq, cid, dist: F.struct(seq.alias("seq"), cid.alias("id"), dist.alias("dist"))
    closed = base.filter("parent is null").select(
        "event_id", "comment_id", F.lit(None).cast("string").alias("ptr"), F.col("comment_id").alias("root_id"),
        F.lit(0).alias("dist"), low(F.col("seq"), F.col("comment_id"), F.lit(0)).alias("low"))
    open_ = base.filter("parent is not null").select(
        "event_id", "comment_id", F.col("parent").alias("ptr"), F.lit(None).cast("string").alias("root_id"),
        F.lit(1).alias("dist"), low(F.col("seq"), F.col("comment_id"), F.lit(0)).alias("low"))
    done, seen, before = [closed], 1, None
    while True:
        n_open = open_.count()
        if n_open == 0 or (n_open == before and seen >= n_open):
            break
        before = n_open
        state = open_
        for part in done:
            state = state.unionByName(part)
        up = state.select("event_id", F.col("comment_id").alias("ptr"), F.col("ptr").alias("up_ptr"),
                          F.col("root_id").alias("up_root"), F.col("dist").alias("up_dist"), F.col("low").alias("up_low"))
        lower = F.when(F.col("up_low.seq") < F.col("low.seq"), low(
            F.col("up_low.seq"), F.col("up_low.id"), F.col("dist") + F.col("up_low.dist"))).otherwise(F.col("low"))
        moved = cut(open_.join(up, ["event_id", "ptr"]).select(
            "event_id", "comment_id", F.col("up_ptr").alias("ptr"), F.col("up_root").alias("root_id"),
            (F.col("dist") + F.col("up_dist")).alias("dist"), lower.alias("low")), "threads")
        done.append(moved.filter("ptr is null"))
        open_ = moved.filter("ptr is not null")
        seen *= 2
    loops = open_.select("event_id", "comment_id", F.lit(None).cast("string").alias("ptr"), F.col("low.id").alias("root_id"),
                         F.col("low.dist").alias("dist"), "low")
    placed = loops
    for part in done:
        placed = placed.unionByName(part)
    in_loop = open_.select("event_id", "comment_id", F.lit(True).alias("_loop"))
    out = first.join(placed.select("event_id", "comment_id", "root_id", (F.col("dist") + 1).alias("level")),
                     ["event_id", "comment_id"]).join(in_loop, ["event_id", "comment_id"], "left")
    cycle_root = F.coalesce("_loop", F.lit(False)) & (F.col("root_id") == F.col("comment_id"))
    return out.withColumn("orphan", F.col("orphan") | cycle_root).withColumn(
        "parent", F.when(cycle_root, F.lit(None)).otherwise(F.col("parent"))).drop("_loop")


def sibling_order(rows: DataFrame, position: Column | None = None) -> DataFrame:
    """Place among siblings (1..n) and number of direct replies. rows: event_id, comment_id, parent, seq."""
    out = number_rows(rows, ["event_id", "parent"], [F.col("seq")], position if position is not None else buckets("seq"), "place")
    kids = rows.filter("parent is not null").groupBy("event_id", F.col("parent").alias("comment_id")).agg(
        F.count("*").alias("n_replies"))
    return out.join(kids, ["event_id", "comment_id"], "left").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))


def renumber(df: DataFrame) -> DataFrame:
    """Survivors numbered 1..n per event with a fresh padded id."""
    out = number_rows(df, ["event_id"], [F.col("seq")], buckets("seq"), "order")
    return out.withColumn("new_id", F.concat(F.lit("cmt_"), F.col("event_id"), F.lit("_"),
                                             F.lpad(F.col("order").cast("string"), F.greatest(F.lit(4), F.length(F.col("order").cast("string"))), F.lit("0"))))


def attach_parent_text(rows: DataFrame) -> DataFrame:
    """Text of the parent next to each reply (null for roots)."""
    up = rows.select("event_id", F.col("comment_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return rows.join(up, ["event_id", "parent_id"], "left")


# --- nest ----------------------------------------------------------------------------------------
CHUNK = 20_000


def tree_paths(threads: DataFrame) -> DataFrame:
    """A sortable path per node (12-digit places from the root down): its text order is depth-first order. Every round
    puts a node's stretch of path behind that of the ancestor it has reached, which doubles the stretch: log2(depth)
    joins."""
    placed = cut(sibling_order(threads), "places")
    key = F.lpad(F.col("place").cast("string"), 12, "0")
    done = placed.filter("parent is null").select("event_id", "comment_id", F.lit(None).cast("string").alias("ptr"), key.alias("path"))
    open_ = placed.filter("parent is not null").select("event_id", "comment_id", F.col("parent").alias("ptr"), key.alias("path"))
    while not open_.isEmpty():
        up = done.unionByName(open_).select("event_id", F.col("comment_id").alias("ptr"), F.col("ptr").alias("up_ptr"), F.col("path").alias("up_path"))
        moved = cut(open_.join(up, ["event_id", "ptr"]).select(
            "event_id", "comment_id", F.col("up_ptr").alias("ptr"), F.concat_ws("/", "up_path", "path").alias("path")), "paths")
        done = done.unionByName(moved.filter("ptr is null"))
        open_ = moved.filter("ptr is not null")
    return placed.join(done.drop("ptr"), ["event_id", "comment_id"])


def nest(threads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nested JSON comments per event, as (event_id, chunk, json): an event up to `chunk` nodes is one row; a
    larger one continues over rows whose texts, joined in chunk order, are its document. Each node contributes
    the brackets it opens and those that close before the next node, so no task holds a whole large event."""
    paths = tree_paths(threads)
    rows = spread_rows(paths, ["event_id"], ["path"], "pos")
    nxt = rows.select("event_id", (F.col("pos") - 1).alias("pos"), F.col("level").alias("next_level"))
    rows = rows.join(nxt, ["event_id", "pos"], "left")
    fields = F.to_json(F.struct(
        "comment_id", F.col("place").alias("order"), F.col("parent").alias("reply_to_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(0).alias("likes"), F.col("n_replies").alias("reply_count")), {"ignoreNullFields": "false"})
    opening = F.concat(
        F.when(F.col("pos") == 1, "[").when(F.col("place") > 1, ",").otherwise(""),
        F.regexp_replace(fields, r"\}$", ""), F.lit(',"replies":['))
    # Going to level m next closes this node and its open ancestors down to level m; the last node closes all.
    closing = F.repeat(F.lit("]}"), F.col("level") - F.coalesce("next_level", F.lit(1)) + 1)
    end = F.when(F.col("next_level").isNull(), "]").otherwise("")
    piece = F.concat(opening, closing, end)
    return rows.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)).groupBy("event_id", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "")
        .alias("json"))


BODY = "struct<comment_id:string,`order`:string,reply_to_id:string,text:string,likes:string,reply_count:string>"


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """Nodes of the documents that nest writes, of any size and depth, in depth-first order (pos): event_id, comment_id,
    parent_id, reply_to_id, level, text, likes, reply_count. chunks: event_id, chunk, json.

    A raw `,"replies":[` never occurs inside a JSON string (its quotes would be escaped), so it separates the nodes. What
    closes before a node and what opens with it gives its level by a running sum over the chunks; its parent is the last
    earlier node one level up. A chunk is the unit of work, whatever the size of its document.
    """
    parts = chunks.select("event_id", "chunk", F.posexplode(F.split("json", r',"replies":\[')).alias("i", "piece"))
    closes = (F.length(F.regexp_extract("piece", r"^((?:\]\})*)", 1)) / 2).cast("int")
    body = F.regexp_extract("piece", r"(?s)^(?:\]\})*[\[,]?(\{.*)$", 1)
    parts = parts.select("event_id", "chunk", "i", closes.alias("closes"), body.alias("body"))
    opens = (F.col("body") != "").cast("int")
    order, bucket = ["chunk", "i"], F.col("chunk")
    rows = cut(running_sum(parts, ["event_id"], order, bucket, opens - F.col("closes"), "level").filter("body <> ''"), "nodes")
    n = F.from_json(F.concat("body", F.lit("}")), BODY)
    nodes = rows.select("event_id", "chunk", "i", F.col("level").cast("int").alias("level"), n.alias("n"))
    nodes = nodes.select("event_id", "chunk", "i", "level", "n.*")
    # Every node offers its id to the level below it and asks the level above.
    offers = nodes.select("event_id", "chunk", "i", F.col("level").alias("at"), F.col("comment_id").alias("offer"), F.lit(False).alias("asks"))
    asks = nodes.select("event_id", "chunk", "i", (F.col("level") - 1).alias("at"), F.lit(None).cast("string").alias("offer"), F.lit(True).alias("asks"))
    found = last_before(offers.unionByName(asks), ["event_id", "at"], order, bucket, F.col("offer"), "parent_id").filter("asks")
    both = nodes.join(found.select("event_id", "chunk", "i", "parent_id"), ["event_id", "chunk", "i"])
    return both.select("event_id", "comment_id", "parent_id", "reply_to_id", "level", "text", to_int(F.col("likes")).alias("likes"),
                       to_int(F.col("reply_count")).alias("reply_count"), F.struct("chunk", "i").alias("pos"))


# --- links to documents --------------------------------------------------------------------------
def event_heads(links: DataFrame) -> DataFrame:
    """Event row from its links with status done: name of the first link, post texts joined by blank lines.
    links: event_id, event_name, page, post_text, status, seq. Posts per event are its few source links."""
    done = links.filter(F.col("status") == "done")
    text = F.when(strip(F.coalesce("post_text", F.lit(""))) != "", F.concat(
        F.lit("["), F.col("page"), F.lit("] "), strip(F.col("post_text"))))
    posts = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("seq", text.alias("t")))))
    return done.groupBy("event_id").agg(
        F.min_by("event_name", "seq").alias("event_name"),
        F.array_join(F.transform(posts, lambda x: x["t"]), "\n\n").alias("post_content"))
