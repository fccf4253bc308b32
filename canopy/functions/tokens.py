"""Tokens and n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import WORD, WS, fold

# --- fixed values: leading name tag --------------------------------------------------------------
NAME_TAG_PREFIX = rf"^((?:[A-ZĐÀ-Ỹ][a-zđà-ỹ]+[{WS}]+){{1,3}}[A-ZĐÀ-Ỹ][a-zđà-ỹ]+)(?:[^{WORD}]|$)"


def drop_name_tag(c: Column) -> Column:
    """Text without a leading tag of 2-4 capitalised words whose first is a known name; the remainder
    must keep at least 3 characters, else the text stays as it is."""
    tag = F.regexp_extract(c, NAME_TAG_PREFIX, 1)
    first = F.regexp_extract(tag, f"^[^{WS}]+", 0)
    rest = F.regexp_replace(F.substring(c, F.length(tag) + 1, 1_000_000_000), f"^[{WS}]+", "")
    return F.when((tag != "") & first.isin(vocab.NAME_STARTS) & (F.length(rest) >= 3), rest).otherwise(c)


def tokens(c: Column) -> Column:
    """Lower-case words without punctuation; an underscore inside a word stands for a space. The work is
    done on the whole text, so only the split leaves generated code. Classes name the most frequent characters first, as
    Java tests the parts of a class in turn; single spaces are left alone, as every match copies text; few texts hold underscores."""
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^a-z {WORD}{WS}]+", "")
    edges = F.regexp_replace(clean, f"(?=_)(?:(?<=^|[{WS}])_+|_+(?=[{WS}]|$))", "")
    clean = F.when(clean.contains("_"), edges).otherwise(clean)
    spaced = F.regexp_replace(clean, f"[{WS}&&[^ ]]+", " ")
    return F.array_remove(F.split(spaced, " "), "")   # names spaced once: a generator works it out for every mention


def each(df: DataFrame, *keep: Column | str, of: Column | str, name: str) -> DataFrame:
    """(keep..., name): a row per element that is not null. A plain explode makes the planner filter on the array's size below the
    shuffle that spreads a small scan, where one task would build all arrays, and then build them again."""
    return df.select(*keep, F.explode_outer(of).alias(name)).filter(F.col(name).isNotNull())


def shown(token: Column) -> Column:
    """Token as users see it: underscores back to spaces. Few tokens hold one, and translate walks over every character."""
    return F.when(token.contains("_"), F.translate(token, "_", " ")).otherwise(token)


def valid_token(t: Column) -> Column:
    """At least 3 characters, no stopword, no link, not only digits and symbols. A token that starts with a plain letter needs no regex."""
    return (
        (F.length(t) >= 3) & ~t.isin(vocab.STOPWORDS) & ~t.startswith("http") & ~t.startswith("www")
        & (((t >= "a") & (t < "{")) | t.rlike(r"[\p{L}\p{Nl}\p{No}]"))
    )


def grams(toks: Column, n: int) -> Column:
    """Every run of n neighbouring tokens, joined by a space."""
    run = lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " ")
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), run)).otherwise(
        F.array().cast("array<string>"))


def search_words(c: Column) -> Column:
    """Accent-free words in order, abbreviations spelled out."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "  ")), F.lit(" "))
    for short, full in vocab.ABBREVIATIONS.items():
        flat = F.replace(flat, F.lit(f" {short} "), F.lit(f" {full} "))
    flat = F.trim(F.regexp_replace(flat, " +", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def term_list(w: Column) -> Column:
    """Distinct search terms of a text's search_words: content words, and word pairs unless both words are stopwords. w is a column
    of its own: a lambda would rebuild it for every element."""
    stop = lambda x: x.isin(vocab.SEARCH_STOPWORDS)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n),
                       lambda a, b: F.when(~(stop(a) & stop(b)), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.array_compact(F.concat(F.filter(w, lambda x: ~stop(x)), pairs)))


def explode_terms(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., term): distinct search terms of a text."""
    rows = df.select(*keep, search_words(text).alias("_w"))
    return each(rows, *keep, of=term_list(F.col("_w")), name="term")
