"""Text functions: Catalyst expressions wherever Spark has them, Arrow kernels for the rest.

Conventions: null in, null out; an empty text gives 0 counts or empty arrays.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The character classes of the text metrics.
BIDI_MARKS = "\u061c\u200e\u200f"
BIDI_EMBEDDINGS = "\u202a\u202b\u202c"
BIDI_OVERRIDES = "\u202d\u202e"
BIDI_ISOLATES = "\u2066\u2067\u2068\u2069"
BIDI_CONTROLS = BIDI_MARKS + BIDI_EMBEDDINGS + BIDI_OVERRIDES + BIDI_ISOLATES
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
HEBREW_MARKS = "\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7"
PRESENTATION = "\ufb1d-\ufb4f"
PUNCTUATION = r"\p{P}"
NUMBER_RUN = r"[0-9]+(?:[.,:/\-][0-9]+)*"
LTR_RUN = r"(?:https?://|www\.)[^\s]+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|[A-Za-z0-9]+(?:[._:/?&=%+#@\-][A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+(?:[.,:/\-][0-9]+)*"
VISUAL_TOKEN = "[\u0590-\u05ff\ufb1d-\ufb4f]+|" + r"[A-Za-z0-9._:/?&=%+#@\-]+|\s+|."
BRACKETS = r"[()\[\]{}<>]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_newlines(c) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def without_bidi(c) -> Column:
    return F.translate(_col(c), BIDI_CONTROLS, "")


@pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@pandas_udf(T.StringType())
def nfkc_folded(s: pd.Series) -> pd.Series:
    """NFKC, case folded, format characters dropped, blanks made one, ends stripped: the text of the leakage audit."""

    def one(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).casefold()
        return " ".join("".join(c for c in t if unicodedata.category(c) != "Cf").split())

    return s.map(one)


@pandas_udf(T.StringType())
def base_letters(s: pd.Series) -> pd.Series:
    """NFKD without Hebrew marks, recomposed."""
    marks = regex.compile(f"[{HEBREW_MARKS}]+")
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", marks.sub("", unicodedata.normalize("NFKD", t))))


def strict(c) -> Column:
    """Newlines made plain, the 12 direction controls dropped, NFC; nothing trimmed or collapsed."""
    return nfc(without_bidi(plain_newlines(c)))


def graphemes(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"(\X)"), F.lit(1))


def word_list(c) -> Column:
    """Words between Unicode blanks."""
    return F.filter(F.split(_col(c), r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), lambda w: w != "")


def punctuation_list(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({PUNCTUATION})"), F.lit(1))


def number_runs(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({NUMBER_RUN})"), F.lit(1))


def ltr_runs(c) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(f"({LTR_RUN})"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;!?)\]}]+$", "")), lambda x: x != "")


def bracket_list(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({BRACKETS})"), F.lit(1))


def count_of(c, chars: str) -> Column:
    return F.regexp_count(_col(c), F.lit(f"[{chars}]")).cast("long")


def hygiene(c) -> dict[str, Column]:
    """Counts of the signs a clean text has none of."""
    c = _col(c)
    return {
        "n_marks": count_of(c, BIDI_MARKS),
        "n_embeddings": count_of(c, BIDI_EMBEDDINGS),
        "n_overrides": count_of(c, BIDI_OVERRIDES),
        "n_isolates": count_of(c, BIDI_ISOLATES),
        "n_zero_width": count_of(c, ZERO_WIDTH),
        "n_replacement": count_of(c, "\ufffd"),
        "n_private": count_of(c, "\ue000-\uf8ff"),
        "n_presentation": count_of(c, PRESENTATION),
        "n_unsafe": count_of(c, BIDI_EMBEDDINGS + BIDI_OVERRIDES),
    }


def unbalanced(c, openers: str, closer: str) -> Column:
    """Openers left open plus closers without opener, folded left to right."""
    signs = F.regexp_extract_all(_col(c), F.lit(f"([{openers}{closer}])"), F.lit(1))
    zero = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("bad"))
    step = F.aggregate(
        signs,
        zero,
        lambda a, x: F.when(x != closer, F.struct((a["open"] + 1).alias("open"), a["bad"].alias("bad"))).when(a["open"] > 0, F.struct((a["open"] - 1).alias("open"), a["bad"].alias("bad"))).otherwise(F.struct(a["open"].alias("open"), (a["bad"] + 1).alias("bad"))),
        lambda a: a["open"] + a["bad"],
    )
    return step


def mark_class(code: Column) -> Column:
    """The class of a Hebrew mark by its code point."""
    return (
        F.when(code.between(0x0591, 0x05AF), "cantillation")
        .when(code.between(0x05B0, 0x05BB) | (code == 0x05C7), "vowel")
        .when(code == 0x05BC, "dagesh_mapiq")
        .when(code.isin(0x05C1, 0x05C2), "shin_sin_dot")
        .when(code.isin(0x05BD, 0x05BF), "meteg_rafe")
        .when(code.isin(0x05C4, 0x05C5), "other")
    )


def mixed_direction(c) -> Column:
    """Whether right-to-left letters stand beside Latin letters or digits."""
    c = _col(c)
    return c.rlike("[\u0590-\u08ff\ufb1d-\ufdff]") & c.rlike(r"[A-Za-zÀ-ɏ0-9]")


def first_strong(c) -> Column:
    """rtl, ltr or neutral by the first strong character."""
    first = F.regexp_extract(_col(c), "[A-Za-zªµºÀ-ÖØ-öø-\u02b8Ͱ-ͳͶ-\u0482Ҋ-\u058f\u05be\u05c0\u05c3\u05c6א-ۿ\ufb1d-\ufdff]", 0)
    return F.when(first == "", "neutral").when(first.rlike("[\u0590-\u08ff\ufb1d-\ufdff]"), "rtl").otherwise("ltr")


def visual_order(c) -> Column:
    """What a reader of left-to-right storage would see: tokens reversed, Hebrew tokens reversed by grapheme."""
    tokens = F.reverse(F.regexp_extract_all(_col(c), F.lit(f"(?s)({VISUAL_TOKEN})"), F.lit(1)))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[\u0590-\u05ff]"), F.array_join(F.reverse(graphemes(t)), "")).otherwise(t)), "")


@pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("ch", "code", "name", "bidi", "category")])))
def code_points(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else [(c, f"U+{ord(c):04X}", unicodedata.name(c, ""), unicodedata.bidirectional(c), unicodedata.category(c)) for c in t])


@pandas_udf(T.LongType())
def dangling_marks(s: pd.Series) -> pd.Series:
    """Combining marks at the start of the text or after a blank or control."""

    def one(t):
        if t is None:
            return None
        n, ok = 0, False
        for c in t:
            if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me"):
                n += not ok
            else:
                ok = unicodedata.category(c)[0] not in "ZC"
        return n

    return s.map(one)


def scope_issues(c) -> Column:
    """What puts a text outside the modern scope."""
    c = _col(c)
    rules = [
        ("no_hebrew_letters", ~c.rlike("[א-ת]")),
        ("yiddish_codepoint", c.rlike("[װ-ײ]")),
        ("biblical_mark", c.rlike("[\u0591-\u05af\u05c4\u05c5]")),
        ("bidi_control", c.rlike(f"[{BIDI_CONTROLS}]")),
        ("invalid_unicode_content", c.rlike("[\ue000-\uf8ff\ufffd\ufffe\uffff]")),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
