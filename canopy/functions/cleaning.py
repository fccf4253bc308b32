"""Column functions of the cleaning job: normal form, spam reasons, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import vocab
from canopy.functions.text import WS

CONTROL = r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}]"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}]"
# Characters that can take part in a canonical composition or have a singleton mapping.
NOT_COMPOSED = (r"[\p{M}\x{1100}-\x{11ff}\x{340}\x{341}\x{343}\x{344}\x{374}\x{37e}\x{387}\x{1f71}-\x{1fff}"
                r"\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{f900}-\x{faff}\x{1d15e}-\x{1d1c0}"
                r"\x{2f800}-\x{2fa1f}]")
# --- fixed values: redaction patterns ------------------------------------------------------------
PHONE = r"\b(0|\+84)(3[2-9]|5[6|8|9]|7[0|6-9]|8[1-9]|9[0-9])\d{7}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_MARK, EMAIL_MARK = "[REDACTED_PHONE]", "[REDACTED_EMAIL]"
URL = f"http[s]?://[^{WS}]+"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Canonical composition (NFC). Spark has no such function; only texts that may change are sent to the
    Arrow worker, the others travel as null."""
    return F.coalesce(_compose(F.when(c.rlike(NOT_COMPOSED), c)), c)


def normal_text(c: Column, compose: bool = True) -> Column:
    """NFC, no control or zero-width characters, single spaces."""
    t = composed(c) if compose else c
    t = F.regexp_replace(F.regexp_replace(t, CONTROL, ""), ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def spam_reasons(c: Column) -> Column:
    """All spam reasons of a raw text; an empty array for none."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(c, r"[^\p{Lu}]+", ""))
    links = F.regexp_count(c, F.lit(URL))
    rules = [F.when(c.rlike("(?iU)" + p), F.lit("pattern:" + p[:30])) for p in vocab.SPAM_PATTERNS]
    rules.append(F.when(links >= 3, F.concat(F.lit("link_count="), links)))
    rules.append(F.when((letters > 0) & (upper / letters > 0.6), F.lit("all_caps")))
    return F.array_compact(F.array(*rules))


def phones(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + PHONE))


def redact_phones(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + PHONE, PHONE_MARK)


def emails(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + EMAIL))


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + EMAIL, EMAIL_MARK)
