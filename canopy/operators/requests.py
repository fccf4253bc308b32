"""Label requests: pack threads into requests, write request texts, read responses back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.noise import is_strict_noise
from canopy.functions.text import squeeze, strip
from canopy.operators.ordering import buckets, number_rows, spread_rows
from canopy.operators.tree import tree_paths
from canopy.session import cut, spread

SPAN = 65_536


# --- packing -------------------------------------------------------------------------------------
def thread_sizes(threads: DataFrame) -> DataFrame:
    """Per thread: nodes, nodes that are not rule noise, and the root's place in the source."""
    return threads.groupBy("event_id", "root_id").agg(
        F.count("*").alias("size"), F.count_if(~F.col("rule_trash")).alias("asked"),
        F.min(F.when(F.col("comment_id") == F.col("root_id"), F.col("seq"))).alias("seq"))


def _openings(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(running sums with a leading 0, next opening): where the next request opens if one opens at each thread. A thread
    above the limit goes alone."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    after = np.searchsorted(upto[1:], upto[:-1] + limit, side="right")
    return upto, np.append(np.maximum(after, np.arange(1, len(sizes) + 1)), len(sizes))


def _first_opening(upto: np.ndarray, fill: np.ndarray, limit: int) -> np.ndarray:
    """First thread that opens a request when one is filled so far (0: none is open)."""
    return np.where(fill == 0, 0, np.searchsorted(upto[1:], limit - fill, side="right"))


def pack_threads(sizes: DataFrame, limit: int = vocab.MAX_PER_REQUEST, span: int = SPAN) -> DataFrame:
    """Request number (batch, from 1) per thread that needs labels: greedy in order, a thread is never split, one
    above the limit goes alone.

    The packing of a thread depends on all earlier threads of its event, but only through the fill of the open
    request, a number from 0 to the limit. Each span of threads is therefore run once for every possible fill, in
    parallel; chaining the spans' results (one short row per span) gives the true fill at each span's start, and
    a second parallel run numbers the requests.
    """
    needed = sizes.filter("asked > 0")
    rows = number_rows(needed, ["event_id"], [F.col("seq")], buckets("seq"), "pos").withColumn(
        "span", F.expr(f"(pos - 1) div {span}"))
    rows = cut(rows.select("event_id", "root_id", F.col("size").cast("long").alias("size"), "pos", "span"), "spans")

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        upto, after = _openings(pdf.sort_values("pos")["size"].to_numpy(), limit)
        n, states = len(after) - 1, np.arange(limit + 1)
        # Pointer doubling: openings from each thread to the end, and the last of them.
        count, last, jump = np.append(np.ones(n, np.int64), 0), np.arange(n + 1), after
        while (jump[:n] < n).any():
            count, last, jump = count + count[jump], np.where(jump < n, last[jump], last), jump[jump]
        first = _first_opening(upto, states, limit)
        end = upto[n]
        left = np.where(first < n, np.minimum(end - upto[last[first]], limit), np.minimum(states + end, limit))
        return pd.DataFrame({"event_id": [pdf["event_id"].iloc[0]], "span": [pdf["span"].iloc[0]], "leaves": [left.tolist()], "opened": [count[first].tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, fill, batch, out = pdf.sort_values("span"), 0, 0, []
        for leaves, opened in zip(pdf["leaves"], pdf["opened"]):
            out.append((fill, batch))
            fill, batch = int(leaves[fill]), batch + int(opened[fill])
        return pd.DataFrame({"event_id": pdf["event_id"], "span": pdf["span"], "fill": [a for a, _ in out],
                             "before": [b for _, b in out]})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        upto, after = _openings(pdf["size"].to_numpy(), limit)
        at, opens = int(_first_opening(upto, np.asarray(pdf["fill"].iloc[0]), limit)), np.zeros(len(pdf), np.int64)
        while at < len(pdf):  # one step per request
            opens[at] = 1
            at = int(after[at])
        return pdf[["event_id", "root_id", "size", "pos"]].assign(batch=int(pdf["before"].iloc[0]) + np.cumsum(opens))

    probed = spread(rows, "event_id", "span").groupBy("event_id", "span").applyInPandas(
        probe, "event_id string, span long, leaves array<int>, opened array<long>")
    chained = spread(probed, "event_id").groupBy("event_id").applyInPandas(chain, "event_id string, span long, fill int, before long")
    return spread(rows.join(chained, ["event_id", "span"]), "event_id", "span").groupBy("event_id", "span").applyInPandas(
        replay, "event_id string, root_id string, size long, pos long, batch long")


def expected_requests(threads: DataFrame, packed: DataFrame, domain: DataFrame) -> DataFrame:
    """Requests, comments, threads and rule noise per event; education events with requests need one more for
    their event summary. domain: event_id, domain."""
    n = threads.groupBy("event_id").agg(
        F.count("*").alias("comments"), F.count_if(F.col("comment_id") == F.col("root_id")).alias("clusters"),
        F.count_if("rule_trash").alias("rule_trash"))
    b = packed.groupBy("event_id").agg(F.max("batch").alias("batches"))
    out = n.join(b, "event_id", "left").join(domain, "event_id", "left").withColumn("batches", F.coalesce("batches", F.lit(0)))
    extra = F.when((F.col("domain") == "education") & (F.col("batches") > 0), 1).otherwise(0)
    return out.withColumn("requests", F.col("batches") + extra)


# --- request texts -------------------------------------------------------------------------------
def request_members(threads: DataFrame, packed: DataFrame) -> DataFrame:
    """Every node of a packed thread with its request and local id K<thread>.<node>, counted inside the request
    and in depth-first order inside the thread. The result is staged, as what follows reads it several times."""
    w = Window.partitionBy("event_id", "batch").orderBy("pos")  # a request holds at most `limit` threads
    heads = packed.withColumn("k", F.row_number().over(w)).select("event_id", "root_id", "batch", "k")
    walk = spread_rows(tree_paths(threads), ["event_id"], ["path"], "dfs")
    starts = walk.filter(F.col("comment_id") == F.col("root_id")).select("event_id", "root_id", F.col("dfs").alias("start"))
    m = walk.join(heads, ["event_id", "root_id"]).join(starts, ["event_id", "root_id"]).withColumn("n", F.col("dfs") - F.col("start"))
    return cut(m.withColumn("local_id", F.concat(F.lit("K"), "k", F.lit("."), "n")), "members")


def request_lines(members: DataFrame) -> DataFrame:
    """One text line per node, and one heading per thread (line -1 of the thread)."""
    up = members.select("event_id", F.col("comment_id").alias("parent"), F.col("local_id").alias("up_id"))
    rows = members.join(up, ["event_id", "parent"], "left")
    line = F.concat(
        F.repeat(F.lit("  "), F.col("level") - 1), F.lit("["), F.col("local_id"), F.lit("] (cấp "), F.col("level"),
        F.coalesce(F.concat(F.lit(", trả lời "), F.col("up_id")), F.lit("")), F.lit(")"),
        F.when(F.col("rule_trash"), " [rác - không gán nhãn]").otherwise(""), F.lit(': "'),
        F.substring(squeeze(F.coalesce("text", F.lit(""))), 1, vocab.MAX_TEXT_CHARS), F.lit('"'))
    heads = members.filter("n = 0").select(
        "event_id", "batch", "k", F.lit(-1).cast("long").alias("n"), F.concat(F.lit("### Cụm K"), "k").alias("line"))
    return rows.select("event_id", "batch", "k", F.col("n").cast("long").alias("n"), line.alias("line")).unionByName(heads)


def legend(domain: str) -> str:
    """How answers are written: two-letter codes."""
    text = ", ".join(f"{k}={v}" for k, v in vocab.CODES[domain].items())
    if domain in vocab.TOXIC_DOMAINS:
        text += "; toxic_type: " + ", ".join(f"{k}={v}" for k, v in vocab.TOXIC_CODES.items())
    return text


def request_texts(lines: DataFrame, events: DataFrame, part: int = 5_000) -> DataFrame:
    """Request texts as (event_id, batch, part, text). A request of ordinary threads is one part; one made of a
    single very large thread continues over parts of `part` lines. events: event_id, domain, event_name,
    post_content."""
    body = lines.withColumn("part", F.greatest(F.floor(F.col("n") / part), F.lit(0))).groupBy("event_id", "batch", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    rules = F.when(F.col("domain") == "showbiz", legend("showbiz")).otherwise(legend("education"))
    head = F.concat(
        F.lit("Sự kiện: "), F.col("event_name"), F.lit("\nBài đăng: "),
        F.substring(squeeze(F.coalesce("post_content", F.lit(""))), 1, vocab.MAX_POST_CHARS),
        F.lit("\nMã nhãn: "), rules, F.lit("\n\n"))
    return body.join(events, "event_id").select(
        "event_id", "batch", "part", F.concat(F.when(F.col("part") == 0, head).otherwise(""), "body").alias("text"))


# --- responses -----------------------------------------------------------------------------------
ITEM = "struct<id:string,is_trash:string,emotion:string,stance:string,toxic:string,toxic_type:string>"
ANSWER = f"struct<clusters:array<struct<cluster:string,summary:string,comments:array<{ITEM}>>>,_bad:string>"
LOOSE = {"allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
# --- fixed values: what can be read from a broken response ---------------------------------------
ITEM_PATTERN = r'\{\s*"id"\s*:\s*"K\d+\.\d+"[^{}]*\}'
SUMMARY_PATTERN = r'(?s)"cluster"\s*:\s*"(K\d+)"\s*,\s*"summary"\s*:\s*"?(.*?)"?\s*(?:,\s*"comments"|\})'


def unwrapped(c: Column) -> Column:
    """Response text without thinking blocks and code fences."""
    t = strip(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(t, r"^```(?:json)?\s*|\s*```$", ""))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds groups: array of {cluster, summary, comments}. Broken JSON is salvaged item by item. The result is staged, so
    that no later filter on groups parses the responses again."""
    responses = spread(responses, "event_id", "batch")
    t = unwrapped(F.col("response"))
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    out = responses.withColumn("_t", t).withColumn("_a", F.from_json(body, ANSWER, LOOSE))
    whole = F.when(F.col("_a._bad").isNull(), F.col("_a.clusters"))
    items = F.transform(F.regexp_extract_all("_t", F.lit(ITEM_PATTERN), 0), lambda x: F.from_json(x, ITEM, {"allowUnquotedControlChars": "true"}))
    no_items = F.array().cast(f"array<{ITEM}>")
    names = F.regexp_extract_all("_t", F.lit(SUMMARY_PATTERN), 1)
    texts = F.regexp_extract_all("_t", F.lit(SUMMARY_PATTERN), 2)
    heads = F.zip_with(names, texts, lambda a, b: F.struct(a.alias("cluster"), b.alias("summary"), no_items.alias("comments")))
    salvaged = F.concat(heads, F.array(F.struct(
        F.lit("").alias("cluster"), F.lit(None).cast("string").alias("summary"), items.alias("comments"))))
    return cut(out.withColumn("groups", F.coalesce(whole, salvaged)).drop("_t", "_a"), "parsed")


def decode(value: Column, codes: dict[str, str]) -> Column:
    """Code or full label -> label; anything else null."""
    v = strip(value)
    out = F.when(v.isin(list(codes.values())), v)
    for code, label in codes.items():
        out = out.when(F.upper(v) == code, label)
    return out


def read_labels(responses: DataFrame, members: DataFrame) -> DataFrame:
    """Label of every member. responses: event_id, batch, response; members: event_id, batch, domain, local_id,
    comment_id, rule_trash. Ids that were not asked are ignored, the last answer to an id counts, missing and
    unknown labels fall back to the neutral one."""
    parsed = parse_responses(responses)
    items = parsed.select("event_id", "batch", F.posexplode("groups").alias("g", "grp")).select(
        "event_id", "batch", "g", F.posexplode("grp.comments").alias("i", "item")).filter("item is not null")
    answers = items.select("event_id", "batch", strip(F.col("item.id")).alias("local_id"), F.struct("g", "i").alias("at"), "item")
    answers = answers.groupBy("event_id", "batch", "local_id").agg(F.max_by("item", "at").alias("item"))
    m = members.join(answers, ["event_id", "batch", "local_id"], "left")
    show = F.col("domain") == "showbiz"
    label = F.when(show, decode(F.col("item.emotion"), vocab.CODES["showbiz"])).otherwise(
        decode(F.col("item.stance"), vocab.CODES["education"]))
    neutral = F.when(show, vocab.FALLBACK["showbiz"]).otherwise(vocab.FALLBACK["education"])
    trash = F.col("rule_trash") | F.coalesce(F.col("item.is_trash") == "true", F.lit(False))
    toxic = F.coalesce(F.col("item.toxic") == "true", F.lit(False))
    source = (F.when(F.col("rule_trash"), "rule").when(F.col("item").isNull(), "fallback_missing")
              .when(trash, "llm").when(label.isNull(), "fallback_invalid_label").otherwise("llm"))
    found = source == "llm"
    return m.select(
        "event_id", "batch", "comment_id", trash.alias("is_trash"),
        F.when(~trash, F.coalesce(F.when(found, label), neutral)).alias("label"),
        F.when(show & ~trash, found & toxic).alias("toxic"),
        F.when(show & ~trash & found & toxic, decode(F.col("item.toxic_type"), vocab.TOXIC_CODES)).alias("toxic_type"),
        source.alias("label_source"))


def read_summaries(responses: DataFrame, members: DataFrame) -> DataFrame:
    """Summary text per thread (the last one given)."""
    g = parse_responses(responses).select("event_id", "batch", F.posexplode("groups").alias("g", "grp"))
    g = g.filter("grp.summary is not null").groupBy("event_id", "batch", strip(F.col("grp.cluster")).alias("cluster")).agg(
        F.max_by(strip(F.col("grp.summary")), "g").alias("summary"))
    roots = members.filter("n = 0").select("event_id", "batch", F.concat(F.lit("K"), "k").alias("cluster"), "root_id")
    return g.join(roots, ["event_id", "batch", "cluster"]).select("event_id", "root_id", "summary")


def array_answers(c: Column, schema: str) -> Column:
    """Objects of an older array-shaped response, also of one cut off in the middle: every complete object."""
    whole = r"\{[^{}]*\}"
    return F.filter(F.transform(F.regexp_extract_all(unwrapped(c), F.lit(whole), 0), lambda x: F.from_json(x, schema)),
                    lambda x: x.isNotNull())


def answer_quality(labels: DataFrame) -> DataFrame:
    """Share of asked comments per request that fell back, and what follows from it."""
    per = labels.groupBy("event_id", "batch").agg(
        F.count_if(F.col("label_source").startswith("fallback")).alias("bad"),
        F.count_if(F.col("label_source") != "rule").alias("asked"))
    ratio = F.when(F.col("asked") > 0, F.col("bad") / F.col("asked")).otherwise(0.0)
    verdict = F.when(ratio > vocab.BAD_FAIL_RATIO, "fail").when(ratio > vocab.BAD_WARN_RATIO, "warn").otherwise("ok")
    return per.withColumn("ratio", ratio).withColumn("verdict", verdict)


def complete_events(events: DataFrame, packed: DataFrame, quality: DataFrame) -> DataFrame:
    """Whether every request of an event came back usable: an incomplete event is not written."""
    want = packed.groupBy("event_id").agg(F.max("batch").alias("n_batches"))
    have = quality.filter("verdict <> 'fail'").groupBy("event_id").agg(F.countDistinct("batch").alias("n_done"))
    out = events.select("event_id").join(want, "event_id", "left").join(have, "event_id", "left").na.fill(
        0, ["n_batches", "n_done"])
    return out.withColumn("complete", F.col("n_batches") == F.col("n_done"))


def attach_labels(threads: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels onto comments; comments of threads that were never sent are rule noise."""
    out = threads.join(labels.drop("batch"), ["event_id", "comment_id"], "left")
    return out.withColumn("is_trash", F.coalesce("is_trash", F.lit(True))).withColumn(
        "label_source", F.coalesce("label_source", F.lit("rule")))


def review_pass(labels: DataFrame, second: DataFrame, mark: str = "cần xem xét", neutral: str = "trung lập") -> DataFrame:
    """A second answer overrides labels marked for review; what is still marked becomes neutral."""
    s = second.select("comment_id", F.col("label").alias("_second"))
    out = labels.join(s, "comment_id", "left")
    new = F.when(F.col("label") == mark, F.coalesce("_second", F.lit(mark))).otherwise(F.col("label"))
    return out.withColumn("label", F.when(new == mark, neutral).otherwise(new)).drop("_second")


def add_rule_noise(threads: DataFrame) -> DataFrame:
    return threads.withColumn("rule_trash", is_strict_noise(F.col("text")))
