"""Label curation: final labels, samples by quota, splits, class weights, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import blank, squeeze, truthy
from canopy.operators.ordering import hash_buckets, number_rows, running_sum, top_rows
from canopy.session import cut


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order: 32 hex digits from key and seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


# --- labels --------------------------------------------------------------------------------------
def canonical_label(c: Column, valid: list[str]) -> Column:
    """Label spelled as in `valid`, by case, spaces and known aliases; null if unknown."""
    key = F.lower(squeeze(c.cast("string")))
    table = {k: v for k, v in vocab.LABEL_ALIASES.items() if v in valid}
    table.update({v.lower(): v for v in valid})
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(~blank(c), F.try_element_at(names, key))


def final_labels(df: DataFrame, domain: str, verified_only: bool = False) -> DataFrame:
    """Adds final_label and drop_reason. df: label, verified_label, is_trash, model_label, text (missing ones
    null). A merged label wins, then the verified one (it beats noise), then noise, then the model's."""
    valid = [*vocab.LABELS[domain], vocab.TRASH_LABEL]
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    merged, verified = canonical_label(c("label"), valid), canonical_label(c("verified_label"), valid)
    model = F.when(truthy(c("is_trash")), vocab.TRASH_LABEL).otherwise(canonical_label(c("model_label"), valid))
    out = df.withColumns({"_m": merged, "_v": verified, "_l": model})
    bad_verified = F.col("_v").isNull() & ~blank(c("verified_label"))
    rest = F.when(F.col("_v").isNotNull(), F.col("_v")).when(bad_verified | F.lit(verified_only), F.lit(None)).otherwise(F.col("_l"))
    final = rest if verified_only else F.coalesce("_m", rest)
    reason = (
        F.when(final.isNotNull() & blank(c("text")), "no_text").when(final.isNotNull(), F.lit(None))
        .when(bad_verified, "invalid_verified_label")
        .when(F.lit(verified_only), "no_verified_label").otherwise("no_valid_label"))
    return out.withColumn("final_label", final).withColumn("drop_reason", reason).drop("_m", "_v", "_l")


# --- samples -------------------------------------------------------------------------------------
def quota_sample(df: DataFrame, group: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """min(quota, available) rows per group in a seeded order; groups without quota are left out."""
    wanted = df.filter(F.col(group).isin(list(quotas))).withColumn("_draw", draw(F.col(key), seed))
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    top = top_rows(wanted, [group], ["_draw", key], max(quotas.values()), "_rank")
    return top.filter(F.col("_rank") <= quota[F.col(group)]).drop("_draw", "_rank")


def minority_sample(df: DataFrame, key: str, labels: list[str], common: str, target: int = 5000, cap: int = 2000, seed: int = 42) -> DataFrame:
    """All rare labels, up to `cap` of the common one, noise fills up to `target`. df: label, is_trash."""
    part = F.when(F.col("is_trash"), "noise").when(F.col("label") == common, "common").when(F.col("label").isin(labels), "rare")
    rows = df.withColumn("part", part).filter("part is not null")
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    rare, mid = n.get("rare", 0), min(cap, n.get("common", 0))
    quotas = {"common": cap, "noise": max(target - rare - mid, 0)}
    rest = quota_sample(rows.filter("part <> 'rare'"), "part", key, quotas, seed)
    chosen = rows.filter("part = 'rare'").unionByName(rest)
    if rare + mid > target:
        chosen = chosen.withColumn("_d", draw(F.col(key), seed)).orderBy("_d", key).limit(target).drop("_d")
    return chosen.drop("part")


def balanced_sample(df: DataFrame, key: str, rare: list[str], common: tuple[str, str], target: int = 5000, noise: int = 800, seed: int = 42) -> DataFrame:
    """All rare labels, up to `noise` noise rows, the rest half and half from two common labels; what the first
    cannot give comes from the second."""
    part = F.when(F.col("is_trash"), "noise").otherwise(F.col("label"))
    rows = df.withColumn("part", part).filter(F.col("part").isin("noise", *rare, *common))
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    left = max(target - sum(n.get(r, 0) for r in rare) - min(noise, n.get("noise", 0)), 0)
    first = min(left // 2, n.get(common[0], 0))
    quotas = {"noise": noise, common[0]: first, common[1]: left - first}
    rest = quota_sample(rows.filter(~F.col("part").isin(rare)), "part", key, quotas, seed)
    return rows.filter(F.col("part").isin(rare)).unionByName(rest).drop("part")


# --- splits --------------------------------------------------------------------------------------
def row_split(df: DataFrame, label: str, key: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split: test, val or train by seeded rank inside each label (over all rows if a label has fewer than
    three). Ranks are exact and no label is gathered in one task."""
    sizes = cut(df.groupBy(label).agg(F.count("*").alias("_n")), "sizes")
    low, high, every = sizes.agg(F.min("_n"), F.max("_n"), F.sum("_n")).first()
    rows = df.withColumn("_draw", draw(F.col(key), seed))
    if low is not None and low < 3:
        high, sizes = every, sizes.agg(F.sum("_n").alias("_n")).withColumn("_g", F.lit("all"))
        rows = rows.withColumn("_g", F.lit("all"))
    else:
        sizes, rows = sizes.withColumnRenamed(label, "_g"), rows.withColumn("_g", F.col(label))
    ranked = number_rows(rows, ["_g"], ["_draw", key], hash_buckets("_draw", high or 0), "_rn").join(sizes, "_g")
    n_test, n_val = (F.round(F.round(F.col("_n") * share, 9)) for share in (test, val))
    split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_draw", "_g", "_rn", "_n")


def group_split(df: DataFrame, group: str, seed: int = 42, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Whole groups per split: a share of the groups in seeded order, at least one each for val and test."""
    groups = df.select(group).distinct().withColumn("_draw", draw(F.col(group), seed))
    n = groups.count()
    n_test, n_val = max(1, round(n * test)), max(1, round(n * val))
    ranked = number_rows(groups, [], ["_draw", group], hash_buckets("_draw", n), "_rn")
    split = F.when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    return df.join(ranked.select(group, split.alias("split")), group)


FINE = 65536   # groups of one hash bucket of an order, about


def fitted_group_split(df: DataFrame, group: str, label: str, val: float = 0.15, test: float = 0.15, tries: int = 300, seed: int = 42) -> DataFrame:
    """Whole groups per split, chosen among seeded orders of the groups: each order is filled greedily (test, then
    val, then train), and the one whose sizes and label shares come closest to the whole wins.

    A split is a prefix of an order, so no order is sorted: groups are counted by bucket of their draw (sizes and labels, combined
    before the shuffle), a running sum over the buckets finds the one in which a split ends, and only that bucket's groups are placed
    one by one. Rows that move: buckets of every try, and the groups of two buckets a try. Only the winner orders all groups.
    """
    labels = [r[label] for r in df.select(label).distinct().orderBy(label).collect()]  # one row per class
    per = df.groupBy(group).agg(F.count("*").alias("size"), F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(x))) for x in labels]).alias("parts"))
    per = cut(per, "groups")
    n_groups, n_rows = per.agg(F.count("*"), F.sum("size")).first()
    if not n_groups:
        return df.withColumn("split", F.lit("train"))
    every = [per.agg(*[F.sum(F.col("parts")[i]) for i in range(len(labels))]).first()[i] / n_rows for i in range(len(labels))]
    t_test, t_val = test * n_rows, val * n_rows
    digits = 2
    while 16 ** digits * FINE < n_groups:
        digits += 1
    drawn = per.select(group, "size", "parts", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try")).withColumn(
        "_draw", draw(F.concat_ws("/", "try", group), seed)).withColumn("_bucket", F.substring("_draw", 1, digits))
    summed = [F.sum("size").alias("size"), F.count("*").alias("groups"), F.array(*[F.sum(F.col("parts")[i]) for i in range(len(labels))]).alias("parts")]
    tallies = drawn.groupBy("try", "_bucket").agg(*summed)
    order = Window.partitionBy("try").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    tallies = cut(tallies.select("try", "_bucket", earlier("size").alias("size"), earlier("groups").alias("groups"),
                                 F.array(*[earlier(F.col("parts")[i]) for i in range(len(labels))]).alias("parts")), "buckets")

    def prefix(ends: DataFrame) -> DataFrame:
        """(try, size, groups, parts) of the groups that start below each try's end. ends: try, end."""
        w = Window.partitionBy("try").orderBy(F.desc("_bucket"))
        last = tallies.join(ends, "try").filter(F.col("size") < F.col("end")).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        last = last.select("try", "_bucket", "end", F.col("size").alias("s0"), F.col("groups").alias("g0"), F.col("parts").alias("p0"))
        opened = drawn.join(F.broadcast(last), ["try", "_bucket"])
        inside = Window.partitionBy("try").orderBy("_draw", group).rowsBetween(Window.unboundedPreceding, -1)
        taken = opened.withColumn("before", F.col("s0") + F.coalesce(F.sum("size").over(inside), F.lit(0))).filter(F.col("before") < F.col("end"))
        out = taken.groupBy("try").agg((F.first("s0") + F.sum("size")).alias("size"), (F.first("g0") + F.count("*")).alias("groups"),
                                       F.array(*[F.first(F.col("p0")[i]) + F.sum(F.col("parts")[i]) for i in range(len(labels))]).alias("parts"))
        return cut(out, "prefix")

    tests = prefix(per.sparkSession.range(tries).select(F.col("id").cast("int").alias("try"), F.lit(float(t_test)).alias("end")))
    both = prefix(tests.select("try", (F.col("size") + F.lit(float(t_val))).alias("end")))
    sides = tests.select("try", *[F.col(c).alias(f"t_{c}") for c in ("size", "groups", "parts")]).join(both, "try")

    def cost(size: Column, groups: Column, parts: list[Column], target: float) -> Column:
        apart = sum((F.abs(p / size - share) for p, share in zip(parts, every)), F.lit(0.0))
        missing = sum((F.when(p == 0, 0.3).otherwise(0.0) for p in parts), F.lit(0.0))
        return F.when(groups > 0, F.abs(size - target) / n_rows + 0.5 * apart + F.when(groups < 3, 1.0).otherwise(0.0) + missing).otherwise(0.0)

    at = range(len(labels))
    of_test = cost(F.col("t_size"), F.col("t_groups"), [F.col("t_parts")[i] for i in at], t_test)
    of_val = cost(F.col("size") - F.col("t_size"), F.col("groups") - F.col("t_groups"), [F.col("parts")[i] - F.col("t_parts")[i] for i in at], t_val)
    filled = F.when(F.col("groups") > F.col("t_groups"), 2).otherwise(1)
    best = sides.select("try", F.round(of_test + of_val, 9).alias("cost"), filled.alias("filled"), "t_size").orderBy(F.desc("filled"), "cost", "try").first()
    chosen = per.select(group, "size").withColumn("_draw", draw(F.concat_ws("/", F.lit(best["try"]), group), seed))
    done = running_sum(chosen, [], ["_draw", group], hash_buckets("_draw", n_groups), F.col("size"), "upto")
    before = F.col("upto") - F.col("size")
    split = F.when(before < t_test, "test").when(before - best["t_size"] < t_val, "val").otherwise("train")
    return df.join(done.select(group, split.alias("split")), group)


def frozen_test(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a frozen evaluation set, the others)."""
    return df.join(ids.select(key).distinct(), key, "left_semi"), df.join(ids.select(key).distinct(), key, "left_anti")


def add_synthetic(split: DataFrame, synthetic: DataFrame, group: str | None) -> DataFrame:
    """Synthetic rows join train only; with group splits only those whose group is in train and in no held-out split."""
    extra = synthetic
    if group:
        held = split.filter("split <> 'train'").select(group).distinct()
        extra = extra.join(split.filter("split = 'train'").select(group).distinct(), group, "left_semi").join(held, group, "left_anti")
    return split.unionByName(extra.withColumn("split", F.lit("train")), allowMissingColumns=True)


def augmentation_jobs(df: DataFrame, have: DataFrame, targets: dict[str, int], batch: int, keep_rate: float, least: int = 3, seed: int = 7) -> DataFrame:
    """Batches still to generate per label, spread over its events in proportion to their samples. df: event_id,
    label; have: label, n (already generated)."""
    per = df.groupBy("event_id", "label").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("label").isin(list(targets)))
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    need = per.select("label").distinct().join(have.withColumnRenamed("n", "done"), "label", "left").withColumn(
        "batches", F.ceil(F.greatest(goal[F.col("label")] - F.coalesce("done", F.lit(0)), F.lit(0)) / F.lit(batch * keep_rate)))
    whole = per.groupBy("label").agg(F.sum("n").alias("all_n"))
    # Largest remainder: every event gets the whole part of its share, the rest goes to the largest fractions.
    share = per.join(need, "label").join(whole, "label").withColumn("exact", F.col("batches") * F.col("n") / F.col("all_n")).withColumn(
        "base", F.floor("exact"))
    left = share.groupBy("label").agg((F.first("batches") - F.sum("base")).alias("left"))
    share = share.withColumn("over", F.col("exact") - F.col("base")).withColumn("_d", draw(F.col("event_id"), seed))
    ranked = number_rows(share, ["label"], [F.col("over").desc(), "_d"], F.floor((1 - F.col("over")) * 4096), "place")
    out = ranked.join(left, "label").withColumn("jobs", F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))
    return out.filter("jobs > 0").select("event_id", "label", "n", "jobs")


def examples_for(df: DataFrame, jobs: DataFrame, key: str, n: int = 12, seed: int = 7) -> DataFrame:
    """Up to n example rows per planned (event, label)."""
    rows = df.join(jobs.select("event_id", "label"), ["event_id", "label"], "left_semi").withColumn("_d", draw(F.col(key), seed))
    return top_rows(rows, ["event_id", "label"], ["_d", key], n).drop("_d")


# --- weights and evaluation ----------------------------------------------------------------------
def class_weights(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Weights per class; a class without rows counts as one row, and weighs 1 in the balanced scheme."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    c = every.join(n, label, "left").na.fill(0, ["n"])
    w = c.agg(F.sum(F.greatest("n", F.lit(1))).alias("t"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 0).alias("present")).first()
    c = c.withColumns({"m": F.greatest("n", F.lit(1)), "t": F.lit(w["t"]), "rows": F.lit(w["rows"]), "present": F.lit(w["present"])})
    k = len(labels)
    return c.select(
        label, "n", (F.col("t") / (k * F.col("m"))).alias("inverse"), F.log(F.col("t") / F.col("m")).alias("log_inverse"),
        F.sqrt(F.col("t") / (k * F.col("m"))).alias("sqrt_inverse"),
        F.when(F.col("n") > 0, F.col("rows") / (F.col("present") * F.col("n"))).otherwise(1.0).alias("balanced"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts (0 where nothing divides)."""
    m = cut(confusion(pred), "confusion")
    t = m.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    p = m.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    h = m.filter("true_label = pred_label").select(F.col("true_label").alias("label"), F.col("n").alias("hits"))
    c = t.join(p, "label", "full_outer").join(h, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def overall_scores(report: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1."""
    s = F.sum("support")
    return report.agg(s.alias("n"), (F.sum("hits") / s).alias("accuracy"), F.avg("f1").alias("f1_macro"),
                      (F.sum(F.col("f1") * F.col("support")) / s).alias("f1_weighted"))


def labelling_cost(counts: DataFrame) -> DataFrame:
    """What labelling n comments one call each would take. counts: domain, n."""
    usd = (vocab.TOKENS_IN * vocab.USD_PER_MILLION_IN + vocab.TOKENS_OUT * vocab.USD_PER_MILLION_OUT) / 1_000_000
    return counts.withColumn("seconds", F.col("n") * vocab.SECONDS_PER_CALL).withColumn("usd", F.col("n") * usd).withColumn(
        "vnd", F.col("n") * usd * vocab.USD_TO_VND)


def check_accuracy(df: DataFrame) -> DataFrame:
    """Share of checked labels that were right, per test set."""
    return df.groupBy("test_set").agg(F.sum("is_label_correct").alias("right"), F.count("*").alias("n"), F.avg("is_label_correct").alias("accuracy"))


def score_batches(df: DataFrame, text: str, labels: list[str], scorer) -> DataFrame:
    """Adds label, confidence and per-class probabilities. scorer(list of texts) -> rows of probabilities, once per
    Arrow batch; the choice of the label stays in Spark."""
    schema = df.withColumn("probabilities", F.array().cast("array<double>")).schema

    def run(batches):
        for pdf in batches:
            pdf["probabilities"] = [list(map(float, p)) for p in scorer(pdf[text].fillna("").tolist())]
            yield pdf

    out = df.mapInPandas(run, schema)
    best = F.array_max("probabilities")
    return out.withColumn("confidence", best).withColumn(
        "label", F.element_at(F.array(*map(F.lit, labels)), F.array_position("probabilities", best).cast("int")))


def fill_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Blank ids looked up by event name. known: event_name, id_content; the last of equal names counts."""
    k = known.groupBy("event_name").agg(F.max_by("id_content", "seq").alias("_id"))
    return rows.join(k, "event_name", "left").withColumn("id_content", F.coalesce(F.nullif(F.trim("id_content"), F.lit("")), "_id")).drop("_id")


def with_context(comments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Event context next to each comment; empty where the event has none. contexts: event_id, context - one short
    text per event."""
    return comments.join(contexts, "event_id", "left").withColumn("missing", F.col("context").isNull()).na.fill("", ["context"])
