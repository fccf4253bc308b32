"""Two noise rules as Column expressions. They disagree on purpose: the first is the light filter of the
cleaning job, the second the stricter one in front of labelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy import vocab
from canopy.functions.text import WORD, WS, squeeze, strip, word_count

# --- fixed values: patterns of the light rule ----------------------------------------------------
NO_WORD = r"^[^\p{L}\p{N}]+$"
DIGITS = r"^\p{Nd}+$"
NAME = "[A-ZÀ-Ỹ][a-zà-ỹ]*"
NAME_TAG = f"^{NAME}(?:[{WS}]+{NAME}){{0,4}}$"
TWO_CHARS = f"[^{WS}][^{WS}]"

# --- fixed values: patterns of the strict rule ---------------------------------------------------
LETTER = "[a-zàáâãèéêìíòóôõùúăđĩũơ]"
LAUGH = "^(h+|k+|ok+e*|lol+|haha+|he+|hi+|uh+|ah+|ew+|hehe+)$"
LINK = "https?://"
SCHOOL = f"(^|[^{WORD}])(thpt|thcs|hocmai|fanpage|trường thpt|trường thcs|trường đh|trường đại học)([^{WORD}]|$)"
VN_HOST = f"[a-z]\\.vn([^{WORD}]|$)"
_REST = rf"[^{WS}\p{{Lu}}\p{{Lt}}\p{{Nd}}\x{{b2}}\x{{b3}}\x{{b9}}\x{{2070}}-\x{{2079}}\x{{2080}}-\x{{2089}}]*"
NAME_WORD = rf"\p{{Lu}}(?:{_REST}\p{{Ll}}{_REST})?"
NAME_ONLY = f"^{NAME_WORD}(?: {NAME_WORD}){{1,4}}$"
NAME_PREFIX = f"^({NAME_WORD}(?: {NAME_WORD}){{1,3}})(?: |$)"
EMOJI_TAIL = "^[=:;<>()\\-/\\\\🫨😂😭😅😆🥲👍👎❤️🔥💀🙄😑😐🤣" + WS + "]+$"


def light_reason(c: Column) -> Column:
    """Why the light rule calls a text noise; null when it keeps it. Symbols-only text is always caught
    by no_word first, so it has no reason of its own."""
    t = strip(c)
    packed = F.regexp_replace(F.lower(t), f"[{WS}]+", "")
    return (
        F.when(c.isNull(), "missing")
        .when(F.length(t) < 3, "too_short")
        .when(t.rlike(NO_WORD), "no_word")
        .when(t.rlike(DIGITS), "digits")
        .when((F.length(packed) >= 3) & (F.replace(packed, F.substring(packed, 1, 1), F.lit("")) == ""), "repeated")
        .when(F.lower(t).isin(vocab.INTERJECTIONS), "interjection")
        .when(t.rlike(NAME_TAG) & t.rlike(TWO_CHARS), "name_tag")
    )


def is_light_noise(c: Column) -> Column:
    return light_reason(c).isNotNull()


def strict_reason(c: Column) -> Column:
    """Why the strict rule calls a text noise; null when it keeps it."""
    raw = strip(c)
    low = F.lower(raw)
    flat = squeeze(c)
    prefix = F.regexp_extract(flat, NAME_PREFIX, 1)
    rest = F.substring(flat, F.length(prefix) + 2, 1_000_000_000)
    spam = F.lit(False)
    for word in vocab.SPAM_WORDS:
        spam = spam | F.contains(low, F.lit(word))
    return (
        F.when(c.isNull(), "missing")
        .when(F.length(F.replace(low, F.lit(" "), F.lit(""))) < 4, "too_short")
        .when(~low.rlike(LETTER), "no_letter")
        .when(low.rlike(LAUGH), "laughter")
        .when(low.rlike(LINK), "link")
        .when(low.rlike(SCHOOL), "school_page")
        .when(low.rlike(VN_HOST), "host")
        .when(F.contains(low, F.lit("@")) & (word_count(c) <= 4), "mention")
        .when(spam, "spam_word")
        .when(flat.rlike(NAME_ONLY), "name_only")
        .when((prefix != "") & ((F.length(rest) < 30) | rest.rlike(EMOJI_TAIL)), "name_prefix")
    )


def is_strict_noise(c: Column) -> Column:
    return strict_reason(c).isNotNull()
