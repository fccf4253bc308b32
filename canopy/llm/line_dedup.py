"""Line dedup by an exact set-similarity join: rarity order, prefix, positional and length filters, verified Jaccard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.ordering import top_rows
from canopy.session import cut, discard

OVER, UNDER = 4, 5        # least Jaccard similarity of two lines' word sets, as a fraction
MIN_WORDS = 1             # distinct words; below four, 0.8 means equal sets
TABLE = 20                # bits of the index of a table of marks
OFTEN = 17                # bits of the index of the table that tells rare prefix words from others
RARITY = 16               # bits of the index of the rarity table
LONG = 80                 # distinct words above which a line has a second sketch, of half its words
WIDE = 8                  # 64-bit sketches that candidates of still longer lines are compared by before their words
LONGER = 200              # distinct words above which a line has them; two sketches tell shorter lines apart
WORD_BITS = 31            # of a prefix word as a join key: words that share them only cost comparisons; up to 56 for huge corpora
LIGHT = 256               # lines of one prefix word that are compared pair by pair
LEADERS = 4               # lines, earliest and most frequent ones each, that all lines of a heavier word meet first
LINE = ["doc_id", "text_key", "line_no"]  # the order of lines, and their identity


def _spaced(text: Column) -> Column:
    """The text with all ASCII white space but line breaks as blanks; texts without any other are passed as they are."""
    others = "\t\x0b\x0c\r"
    some = F.contains(text, F.lit(others[0]))
    for c in others[1:]:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.translate(text, others, "    ")).otherwise(text)


def words_of(line: Column) -> Column:
    """Distinct lower-cased words of a line."""
    return F.array_remove(F.array_distinct(F.split(_spaced(F.lower(line)), " ")), "")


def _full(counts: DataFrame, bits: int) -> DataFrame:
    """Rows (slot, n) for every slot of a table."""
    slots = counts.sparkSession.range(1 << bits).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(slots).groupBy("slot").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, bits: int = TABLE) -> DataFrame:
    """One row with a binary of 2^bits bytes from rows (slot, n): 1 + 2 log2(1 + n), by slot. Its size is fixed."""
    level = F.least(F.lit(126), F.lit(1) + F.floor(2 * F.log2(F.col("n") + 1))).cast("int")
    joined = lambda c, x: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(c, x))), lambda s: s[x]))
    rows = _full(counts, bits).select(F.col("slot"), F.shiftright("slot", 10).alias("row"), F.char(level).alias("x")).groupBy("row").agg(joined("slot", "x").alias("x"))
    return cut(rows.agg(joined("row", "x").cast("binary").alias("t")).coalesce(1), "table")


def _rarities(counts: DataFrame) -> DataFrame:
    """One row with an array of 2^RARITY numbers from rows (slot, n): 4 log2(1 + n) in the top byte, by slot."""
    level = F.shiftleft(F.least(F.lit(127), F.floor(4 * F.log2(F.col("n") + 1))).cast("long"), 56)
    every = _full(counts, RARITY).agg(F.array_sort(F.collect_list(F.struct("slot", level.alias("x")))).alias("a"))
    return cut(every.select(F.transform("a", lambda s: s["x"]).alias("t")), "rarity")


def _slot(h: Column, bits: int = TABLE) -> Column:
    return F.pmod(h, F.lit(1 << bits)).cast("long")


def _level(table: str, h: Column, bits: int = TABLE) -> Column:
    return F.ascii(F.substring(F.col(table), _slot(h, bits).cast("int") + 1, 1).cast("string"))


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _sketch(hashes: Column, part: int = 0) -> Column:
    """64 bits, each telling whether an odd number of words falls on it: two sets differ in at least as many words as
    their sketches in bits. Parts take other bits of the hashes, so their counts add up over the words split among them."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 20 + 6 * part).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(bit(h)))


def _near(s: str, t: str) -> Column:
    """Length, positional and sketch filters for two sets that share the words at these places of their orders. Where both
    have a sketch of half their words, that half and the rest are counted apart."""
    n1, n2 = (F.shiftright(f"np_{x}", 32) for x in (s, t))
    p1, p2 = (F.col(f"np_{x}").bitwiseAND(F.lit((1 << 32) - 1)) for x in (s, t))
    need = _ceil_div((n1 + n2) * OVER, OVER + UNDER)
    fits = (n1 * UNDER >= n2 * OVER) & (n2 * UNDER >= n1 * OVER)
    every, half = (F.col(f"{c}_{s}").bitwiseXOR(F.col(f"{c}_{t}")) for c in ("sketch", "half"))
    bits = F.when(half.isNull(), F.bit_count(every)).otherwise(F.bit_count(half) + F.bit_count(every.bitwiseXOR(half)))
    return (bits <= n1 + n2 - 2 * need) & fits & (1 + F.least(n1 - p1 - 1, n2 - p2 - 1) >= need)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid) of the classes that have an earlier similar one, from candidate pairs (a, b) of classes, either way round, as they are met."""
    pairs = cut(pairs, "candidates")
    # Wider sketches first: they rule out most pairs of the longest lines before any text moves.
    wide = classes.filter("s0 is not null").select("cid", "n", *[f"s{i}" for i in range(WIDE)])
    named = lambda s: wide.select(*[F.col(c).alias(f"{c}_{s}") for c in wide.columns]).withColumnRenamed(f"cid_{s}", s)
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(WIDE)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    close = F.coalesce(apart <= total - 2 * _ceil_div(total * OVER, OVER + UNDER), F.lit(True))
    few = cut(pairs.distinct().join(named("a"), "a", "left").join(named("b"), "b", "left").filter(close).select("a", "b"), "few")
    ids = few.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = cut(classes.select("cid", *LINE).join(ids, "cid", "left_semi"), "wanted")
    # Only texts that may hold a wanted line are shuffled: a fixed-size table of their keys' slots tells.
    marks = _table(wanted.groupBy(_slot(F.col("text_key")).alias("slot")).agg(F.count("*").alias("n")))
    held = docs.withColumn("text_key", F.xxhash64("text")).withColumn("_t", marks.scalar()).filter(_level("_t", F.col("text_key")) > 1)
    # The lines of a text that are wanted, as a list: a text and its list meet once.
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("line_no", "cid")).alias("x")).withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    found = held.select("doc_id", "text_key", "text").join(lists, on).dropDuplicates(["doc_id", "text_key"])
    parts = found.select("doc_id", "text_key", F.split("text", "\n").alias("lines"), F.explode("x").alias("x"))
    at = F.struct("doc_id", "text_key", F.col("x.line_no").alias("line_no")).alias("at")
    sets = cut(parts.select(F.col("x.cid").alias("cid"), at, F.get(F.col("lines"), F.col("x.line_no")).alias("line")), "texts")
    side = lambda s: sets.select(F.col("cid").alias(s), F.col("at").alias(f"at_{s}"), words_of(F.col("line")).alias(f"words_{s}"))
    both = F.size(F.array_intersect("words_a", "words_b"))
    similar = both * UNDER >= (F.size("words_a") + F.size("words_b") - both) * OVER
    hit = few.join(side("a"), "a").join(side("b"), "b").filter((F.col("at_a") != F.col("at_b")) & similar)
    late = cut(hit.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("cid")).distinct(), "late")
    discard(pairs, wanted, marks, sets, few)
    return late


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, removed): numbers, from 0, of the lines that go, for the texts that lose any.

    A line goes if an earlier line of any text has a set of lower-cased words whose Jaccard similarity with its own is 0.8 or more; lines
    are ordered by doc_id (null first), text and place, and an earlier line counts whether it stays or not. Lines of
    fewer than min_words distinct words are left alone. Rows equal in doc_id and text are one text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select(F.explode(F.split(F.translate(_spaced(F.lower("text")), "\n", " "), " ")).alias("w"))
    place = lambda h: h.bitwiseAND(F.lit((1 << RARITY) - 1).cast("long"))
    rarity = _rarities(words.filter("w <> ''").groupBy(place(F.xxhash64("w")).alias("slot")).agg(F.count("*").alias("n")))

    # A word is a number: its rarity above its hash, so that sorting numbers orders words by rarity.
    hashes = lambda line: F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # Lines are hashed in the generator: what stands behind it reads h often, and would hash them each time. The table's column
    # is used once, so that it is read in place; it must not be written into rows, as it is larger than they are.
    spaced = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _spaced(F.lower("text")).alias("low"))
    hashed = spaced.select("doc_id", "text_key", F.posexplode(F.transform(F.split("low", "\n"), hashes)).alias("line_no", "h")).withColumn("_t", rarity.scalar())
    number = lambda h: F.get(F.col("_t"), place(h).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 8))
    share = lambda i, n: F.filter("h", lambda h: h.bitwiseAND(F.lit(n - 1).cast("long")) == i)
    wide = ["half", *[f"s{i}" for i in range(WIDE)]]
    long = [F.when(F.size("h") > LONG, _sketch(share(1, 2))).alias("half")]
    long += [F.when(F.size("h") > LONGER, _sketch(share(i, WIDE), 1)).alias(f"s{i}") for i in range(WIDE)]
    ordered = hashed.select(*LINE, _sketch(F.col("h")).alias("sketch"), *long, F.sort_array(F.transform("h", number)).alias("s"))
    size, short = F.size("s"), lambda x: x.bitwiseAND(F.lit(2**WORD_BITS - 1)).cast("int" if WORD_BITS < 32 else "long")
    lines = cut(ordered.select(*LINE, F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), F.col("s")).alias("k2"), size.alias("n"), "sketch", *wide,
                               F.transform(F.slice("s", 1, size - _ceil_div(size * OVER, UNDER) + 1), short).alias("prefix")), "lines")
    lines = lines.filter(F.col("n") >= min_words)

    # Lines with equal sets are one class, met by its first line; only prefixes of classes are joined.
    grouped = lines.groupBy("k1", "k2").agg(F.min(F.struct(*LINE)).alias("at"), F.count("*").alias("times"), F.min(F.struct("n", "sketch", *wide, "prefix")).alias("x"))
    # Numbered in the order of their first lines, so that a number is all that pairs need to know which line is earlier.
    ranked = grouped.select("k1", "k2", "at.*", "times", "x.*").sort(*LINE)
    classes = cut(ranked.select(F.monotonically_increasing_id().alias("cid"), *ranked.columns), "classes")
    discard(rarity)
    # Sets too small to be similar to any other than their equals have no prefix words.
    large = classes.filter(F.col("n") * (UNDER - OVER) >= OVER)
    entry = (F.col("n").cast("long") * F.lit(1 << 32) + F.col("p")).alias("np")
    heads_of = lambda some, *more: some.select("cid", "n", "sketch", "half", *more, F.posexplode("prefix").alias("p", "word")).select(
        "word", "cid", entry, "sketch", "half", *more)
    heads = heads_of(large)
    carried = ["cid", "np", "sketch", "half"]

    often = _table(heads.groupBy(_slot(F.col("word"), OFTEN).alias("slot")).agg(F.count("*").alias("n")), OFTEN)
    bound = 1 + int(2 * (LIGHT.bit_length() - 1))
    marked = heads.withColumn("_t", often.scalar()).select("word", *carried, (_level("_t", F.col("word"), OFTEN) >= bound).alias("maybe"))
    heavy = cut(marked.filter("maybe").groupBy("word").agg(F.count("*").alias("lines")).filter(F.col("lines") > LIGHT).select("word"), "heavy")
    some = heavy.limit(1).count() > 0
    light = marked.filter("not maybe").unionByName(marked.filter("maybe").join(heavy, "word", "left_anti")).select("word", *carried) if some else heads
    side = lambda df, s: df.select("word", *[F.col(c).alias(f"{c}_{s}") for c in carried])
    near = _near("a", "b")
    earlier = lambda x, y: side(x, "a").join(side(y, "b"), "word").filter((F.col("cid_a") < F.col("cid_b")) & near).select(
        F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    pairs = earlier(light, light)
    if some:
        dense = cut(marked.filter("maybe").join(heavy, "word", "left_semi").select("word", *carried), "dense")
        copied = heads_of(large.filter("times > 1"), "times").join(heavy, "word", "left_semi")
        lead = top_rows(dense, ["word"], ["cid"], LEADERS).unionByName(top_rows(copied, ["word"], [F.desc("times"), F.col("cid")], LEADERS).select("word", *carried))
        lost = _verified(pairs.unionByName(earlier(lead.distinct(), dense)), classes, docs)
        lost = lost.unionByName(_verified(earlier(dense, dense.join(lost, "cid", "left_anti")), classes, docs)).distinct()
        discard(dense)
    else:
        lost = _verified(pairs, classes, docs)
    discard(often, heavy)
    fate = classes.select("cid", "k1", "k2", F.struct(*LINE).alias("at")).join(lost.withColumn("late", F.lit(True)), "cid", "left").drop("cid")
    out = lines.select(*LINE, "k1", "k2").join(fate, ["k1", "k2"]).filter(F.col("late") | ~F.struct(*LINE).eqNullSafe(F.col("at")))
    removed = cut(out.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")
    discard(lines, classes)
    return removed


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that removed_lines names, with n_lines and removed (their numbers, empty if none).

    A text that loses nothing, null or empty ones too, stays as it is; the rest keep their lines in order. Repeated rows
    get the same result; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "removed")]
    removed = removed_lines(docs, min_words)
    gone = removed.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("removed").alias("_r"))
    keyed = docs.select(*columns).withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Texts that lose nothing need no join: a fixed-size table of the others' slots tells most of them.
    marks = _table(removed.groupBy(_slot(F.col("text_key")).alias("slot")).agg(F.count("*").alias("n")))
    marked = keyed.withColumn("_t", marks.scalar()).withColumn("_some", _level("_t", F.col("_key")) > 1).drop("_t")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))
    some = marked.filter("_some").join(gone, on, "left").select(*columns, "_r")
    both = some.unionByName(marked.filter("not _some").select(*columns, F.lit(None).cast("array<int>").alias("_r")))
    parts = F.split("text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_r")), lambda i: F.get(parts, i))
    text = F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    none = F.array().cast("array<int>")
    return both.select(*[F.col(c) for c in columns if c != "text"], text.alias("text"), n_lines.alias("n_lines"), F.coalesce("_r", none).alias("removed")).select(
        *columns, "n_lines", "removed")
