"""Mixing sources to target weights with a low-discrepancy schedule of source slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.ordering import buckets, number_rows, running_sum
from canopy.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096             # words of a slot, about
RANGE = 2 ** 31          # points of the unit interval
STEP = 1_327_217_885     # RANGE divided by the golden ratio, to the next odd number: visits every point once
CELL = 19                # low bits of a point that an interval lookup leaves out (4,096 cells)
ROWS = 32_768            # rows of a sorted bucket, about


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, limit: int) -> DataFrame:
    """(source_no, source, source_size, target), one row per source, from rows (source, size).

    Sources in code-point order, null last, weigh weights in turn and divide share times all sizes; a target stops at
    limit times its source's size and the excess goes to the others by weight, until none is above. Sorted by the size
    at which a source fills up, the full ones come first, so one running sum over the sources finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    no = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("source_no", no)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * limit).cast("double"))
    everyone = Window.partitionBy(F.lit(0))
    before = everyone.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    per = per.withColumn("total", F.sum(F.col("source_size")).over(everyone) * F.lit(share)).withColumn("w_all", F.sum("w").over(everyone))
    left = (F.col("total") - earlier("cap")) / (F.col("w_all") - earlier("w"))
    per = per.withColumn("full", F.col("cap") / F.col("w") <= left)
    none = F.lit(0.0)
    per = per.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(none)).over(everyone))
    per = per.withColumn("w_rest", F.sum(F.when(F.col("full"), none).otherwise(F.col("w"))).over(everyone))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("rest") * F.col("w") / F.col("w_rest"))
    return per.select("source_no", "source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, rank): the order in which the mix visits sources, rank counting a source's slots from 0.

    Slot i falls on the golden-ratio point i of the unit interval, which cumulative targets divide among the sources, so
    every stretch of the schedule has the sources in proportion. A source with a target but without a slot gets one at
    the end.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n = math.ceil(total / block)
    upto = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("source_no"))
    edge = lambda c: F.least(F.floor(c / F.lit(total or 1.0) * F.lit(float(RANGE))), F.lit(RANGE)).cast("long")
    spans = sources.withColumn("hi", edge(upto)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("source_no")), F.lit(0).cast("long")))
    spans = spans.filter("hi > lo").select("source_no", "lo", "hi")
    cells = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", CELL), F.shiftright(F.col("hi") - 1, CELL))))
    point = (F.col("slot") % F.lit(RANGE)) * F.lit(STEP) % F.lit(RANGE)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.shiftright("point", CELL))
    placed = slots.join(cells, "cell").filter("point >= lo and point < hi").select("slot", "source_no")
    late = sources.filter("target >= 0.5").join(placed.select("source_no").distinct(), "source_no", "left_anti")
    placed = cut(placed.unionByName(late.select((F.lit(n) + F.col("source_no")).cast("long").alias("slot"), "source_no")), "slots")
    ranked = number_rows(placed, ["source_no"], [F.col("slot")], buckets("slot"), "rank")
    return ranked.select("slot", "source_no", (F.col("rank") - 1).cast("long").alias("rank"))


def mix(docs: DataFrame, keys: list[str], weights: list[int], share: float = 1.5, limit: int = 2, block: int = BLOCK,
        seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(slots, documents) of the mix of docs, which has the columns keys (first: the id), source and size.

    A source's documents, in an order shuffled by seed and id, form one line of words, as often as the limit allows. Its
    target is cut into blocks of equal size, about block words, one for each of its slots; slot of rank k takes block k.
    slots has a row for each document that a slot takes words of: slot, source_no, start (the document's place in its
    source) and words. documents has keys, source, size, source_size, target, start and taken, one row per row of docs.

    The taken words of a source are its target to the nearest word; no document is taken more than limit times. Reruns
    agree. A null source is a source of its own. Documents without words are taken 0 times; repeated rows are documents
    of their own; an empty table gives an empty mix.
    """
    rows = cut(docs.select(*keys, "source", "size"), "sizes")
    sources = cut(source_targets(rows, weights, share, limit), "sources")
    count = rows.count()
    digits = max(0, math.ceil(math.log(max(1, count) / ROWS, 16))) if count > ROWS else 0
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(keys[0]).cast("string")))
    named = rows.join(sources, rows.source.eqNullSafe(sources.source)).select(*keys, rows.source, "size", "source_no", "source_size", "target")
    named = cut(named.withColumn("_order", order), "named")
    bucket = F.substring("_order", 1, digits) if digits else F.lit("")
    line = running_sum(named, ["source_no"], ["_order", "size", *keys], bucket, F.col("size"), "end")
    line = cut(line.withColumn("start", F.col("end") - F.col("size")).drop("end", "_order"), "line")

    slots = cut(schedule(sources, block), "schedule")
    per = slots.groupBy("source_no").agg(F.count("*").alias("n_slots"))
    words = F.floor(F.col("target") + 0.5).cast("long")
    rule = sources.select("source_no", words.alias("words_due"), F.col("source_size").alias("once")).join(per, "source_no")
    rule = rule.withColumn("width", F.ceil(F.col("words_due") / F.col("n_slots")).cast("long"))
    laid = line.filter("size > 0").select("source_no", "start", "size").join(rule, "source_no")
    laid = laid.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(limit - 1))))
    laid = laid.withColumn("a", F.col("start") + F.col("lap") * F.col("once")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words_due")))
    laid = laid.filter("a < b").withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / F.col("width")), F.floor((F.col("b") - 1) / F.col("width")))))
    part = F.least(F.col("b"), (F.col("rank") + 1) * F.col("width")) - F.greatest(F.col("a"), F.col("rank") * F.col("width"))
    taken = laid.withColumn("words", part).join(slots, ["source_no", "rank"]).select("slot", "source_no", "start", "words")
    per_doc = taken.groupBy("source_no", "start").agg(F.sum("words").alias("n"))
    line, per_doc = line.alias("l"), per_doc.alias("t")
    on = (F.col("l.source_no") == F.col("t.source_no")) & (F.col("l.start") == F.col("t.start")) & (F.col("l.size") > 0)
    out = line.join(per_doc, on, "left").select(*[F.col(f"l.{c}") for c in [*keys, "source", "size", "source_size", "target", "start"]],
                                                F.coalesce("t.n", F.lit(0).cast("long")).alias("taken"))
    return taken, out


def apply_mix(docs: DataFrame, weights: list[int], share: float = 1.5, limit: int = 2) -> DataFrame:
    """docs as the mix has them: each document as often as the mix takes its words, to the nearest whole number.

    Documents without words stand once. Rows equal in doc_id, source and text are numbered and taken one by one.
    """
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    columns = docs.columns
    sized = docs.select("doc_id", key.alias("key"), "source", word_count("text").alias("size"))
    _, plan = mix(sized, ["doc_id", "key"], weights, share, limit)
    # One key, never null, for what tells rows apart: the join and the window by it need a single shuffle of the texts.
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    place = lambda k: F.unhex(F.sha2(F.concat_ws("|", named("doc_id"), k, named("source")), 256))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    each = F.transform(F.array_sort(F.collect_list(F.struct("start", times.alias("times")))), lambda x: x["times"])
    plan = plan.groupBy(place(F.col("key")).alias("_plan")).agg(each.alias("_times")).filter(F.exists("_times", lambda n: n > 0))
    found = docs.withColumn("_place", place(key)).join(plan, F.col("_place") == F.col("_plan"))
    order = "n_chars" if "n_chars" in columns else "doc_id"
    copy = F.row_number().over(Window.partitionBy("_place").orderBy(order))
    found = found.withColumn("_due", F.get(F.col("_times"), copy - 1)).filter("_due > 0")
    found = found.withColumn("_lap", F.explode(F.sequence(F.lit(1), F.col("_due"))))
    return found.select(*[F.col(c) for c in columns])
