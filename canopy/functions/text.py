"""Column functions over text. Regexes name their Unicode classes so that Java and RE2 agree."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a regex class body.
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
# What is left of both classes in ASCII: Java tests every part of a class for every character, so short ones are several times faster.
ASCII_WS = r"\x{09}-\x{0d}\x{1c}-\x{20}"
ASCII_WORD = "a-zA-Z0-9_"
_WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))



def _fold_table() -> tuple[str, str]:
    """Precomposed Latin lower-case letters and their base letters, from the Unicode decompositions."""
    pairs = [("đ", "d")]
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", letter) if unicodedata.category(x) != "Mn")
        if letter == letter.lower() and base != letter and len(base) == 1:
            pairs.append((letter, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(c, F.lit(_WS_CHARS))


def squeeze(c: Column) -> Column:
    """Trim and collapse every run of white space to one space."""
    run = lambda ws: F.regexp_replace(c, f"[{ws}]+", " ")
    return F.trim(F.when(is_ascii(c), run(ASCII_WS)).otherwise(run(WS)))


def words(c: Column) -> Column:
    """White-space separated words of a text, never an empty word."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    flat = squeeze(c)
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)


def blank(c: Column) -> Column:
    """True for null and for the spellings that stand for null."""
    return c.isNull() | strip(c.cast("string")).isin("", "nan", "None")


def null_parent(c: Column) -> Column:
    """A parent id with the null spellings mapped to null."""
    return F.when(c.isin("", "None", "none", "null"), F.lit(None)).otherwise(c)


def to_int(c: Column) -> Column:
    """'145', '1.5', 7 -> int; anything unreadable -> 0."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "1.0", "yes", "x"), F.lit(False))


def fold(c: Column) -> Column:
    """Lower case without accents: precomposed letters by table, combining marks by class."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{Mn}+", ""))


def folded_words(c: Column) -> Column:
    """Accent-free words joined by single spaces (only a-z and 0-9 survive)."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def clip(c: Column, n: int, mark: str = "…") -> Column:
    """At most n characters of the stripped text, with a mark where it was cut."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(
        F.concat(F.regexp_replace(F.substring(t, 1, n), f"[{WS}]+$", ""), F.lit(mark)))


def cut_at_word(c: Column, n: int, mark: str = "") -> Column:
    """First n characters, without the last partial word; whole text if it fits."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit(mark)))


def excerpt(c: Column, n: int = 220) -> Column:
    return cut_at_word(squeeze(F.coalesce(c, F.lit(""))), n, "…")


def hash16(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def record_key(post_url: Column, author: Column, text: Column) -> Column:
    """Stable key of a record without an id: hash of url, author and the first 80 characters."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return hash16(F.concat_ws("|", part(post_url), part(author), F.substring(part(text), 1, 80)))


def round_exact(c: Column, digits: int) -> Column:
    """A value in [0, 128) rounded as its binary value demands, ties to even, times 10^digits. Spark's round works
    on the decimal text of a double, half up: 31.25 and 0.35 would come out as 31.3 and 0.4, not 31.2 and 0.3."""
    big = "decimal(20,0)"
    unit = F.when(c < 1, F.lit(2 ** 62)).otherwise(F.lit(2 ** 52))
    x = (c * unit.cast("double")).cast("bigint").cast(big)
    u = unit.cast(big)
    whole = F.floor(x * F.lit(10 ** digits).cast("decimal(5,0)") / u).cast(big)
    twice = F.lit(2 * 10 ** digits).cast("decimal(6,0)") * x - (whole * 2 + 1) * u
    up = (twice > 0) | ((twice == 0) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """'12.0%' for display; '0%' when there is nothing to divide by."""
    tenths = round_exact(part / whole * 100.0, 1)
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(whole > 0, shown).otherwise("0%")
