"""Problem 5: one form for texts that look the same.

DuckDB runs inside each Arrow partition; the whole mapping is one embedded SQL expression
over ``nfc_normalize``, ``translate`` and regular expressions.

Two texts get equal keys exactly when they differ only in: invisible signs (format and control
characters, joiners, soft hyphens, variation selectors), the kind of a blank, the width of a letter
or sign, composed against decomposed letters and the order of marks, joined letters, and letters of
another script with the same shape. Points, case, digits, raised and circled digits stay distinct.
Nulls stay null, an empty text stays empty, texts of any length are processed whole.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of another script with the same shape, foreign letter then Latin letter.
SAME_SHAPE = (
    ("АВЕЅІЈКМНОРСТУХӀԚԜЁЇ", "ABESIJKMHOPCTYXIQWËÏ"),  # Cyrillic capitals
    ("аеѕіјорсухһӏԁԛԝёї", "aesijopcyxhldqwëï"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ", "ABEZHIKMNOPTYXJC"),  # Greek capitals
    ("νοϲϳ", "vocj"),  # Greek small letters
    ("Օօ", "Oo"),  # Armenian
    ("ɡ", "g"),  # Latin
)
# Yiddish joined letters, which have no decomposition of their own.
JOINED = (("װ", "וו"), ("ױ", "וי"), ("ײ", "יי"))
# Single letters whose compatibility form looks alike (micro sign, alef to dalet symbols).
ALIKE_SYMBOLS = (0x00B5, 0x2135, 0x2136, 0x2137, 0x2138)
BLANKS = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\x00-\x08\x0e-\x1f\x7f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff"


@lru_cache(1)
def mappings() -> tuple[dict[str, str], dict[str, str]]:
    """(one to one, one to many), read off the Unicode data of this Python by rule."""
    one: dict[str, str] = {}
    many: dict[str, str] = dict(JOINED)
    for cp in range(0xA0, sys.maxunicode + 1):
        d = unicodedata.decomposition(ch := chr(cp))
        if not d.startswith("<"):
            continue
        tag, *codes = d.split()
        cat = unicodedata.category(ch)
        to = "".join(chr(int(c, 16)) for c in codes)
        letters = cat[0] == "L" or cat == "Nl"
        keep = tag in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
        keep |= tag == "<compat>" and letters and (len(to) > 1 or cat == "Nl" or cp in ALIKE_SYMBOLS)
        if not keep or " " in to:
            continue
        to = unicodedata.normalize("NFC", to)
        (one if len(to) == 1 else many)[ch] = to
    for a, b in SAME_SHAPE:
        one.update(zip(a, b, strict=True))
    for table in (one, many):
        for k, v in table.items():
            table[k] = "".join(many.get(c, one.get(c, c)) for c in v)
    return {k: v for k, v in one.items() if len(v) == 1}, many | {k: v for k, v in one.items() if len(v) > 1}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(8)
def canonical_sql(column: str) -> str:
    """The SQL expression that brings ``column`` to the one form."""
    one, many = mappings()
    joined = "".join(k for k in many)
    x = f"regexp_replace({column}, '[{INVISIBLE}]', '', 'g')"
    x = f"regexp_replace({x}, '[{BLANKS}]', ' ', 'g')"
    x = f"translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    split = x
    for k, v in many.items():
        split = f"replace({split}, {_quoted(k)}, {_quoted(v)})"
    x = f"CASE WHEN regexp_matches({column}, '[{joined}]') THEN {split} ELSE {x} END"
    plain = f"regexp_full_match({column}, '[ -~א-ת]*')"  # nothing to map
    return f"CASE WHEN {plain} THEN {column} ELSE nfc_normalize({x}) END"


def canonical_columns(df: DataFrame, columns: list[str], suffix: str = "_one_form") -> DataFrame:
    """``df`` with one more text column for each of ``columns``; an added name that clashes replaces the old column."""
    added = [c + suffix for c in columns]
    df = df.select(*[c for c in df.columns if c not in added])
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in added]])

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        exprs = ", ".join(canonical_sql(f'"t{i}"') for i in range(len(columns)))
        for batch in batches:
            texts = pa.table({f"t{i}": batch.column(c) for i, c in enumerate(columns)}) if batch.num_rows else None
            if texts is None:
                continue
            con.register("texts", texts)
            out = con.sql(f"SELECT {exprs} FROM texts").to_arrow_table().combine_chunks()
            con.unregister("texts")
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[a.cast(pa.string()) for a in arrays]], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def same_look(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Distinct ``key`` of the rows whose two texts differ in characters and have one form. Rows with a null in any of the three give none."""
    differ = df.select(F.col(key).alias("k"), F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b and k is not null")
    forms = canonical_columns(differ, ["a", "b"])
    return forms.where("a_one_form = b_one_form").select(F.col("k").alias(key)).distinct()
