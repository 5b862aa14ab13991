"""Corpus side: hash splits and shards, opaque ids, leaks between splits, near duplicates, validation rules, selection."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.align import indel_ratio
from ..functions.text import nfkc_folded, word_list
from ..plans.shared import workers, written

#: Signs that stand between two words without blanks.
JOINERS = tuple("־-–—/")

SPLIT_SALT = "paraleaf-split-v1"


def hash_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_split(key: Column, ratios: dict[str, float], seed: int = 0) -> Column:
    """The split whose cumulative share first exceeds the key's number; the last one catches the rest."""
    if abs(sum(ratios.values()) - 1) > 1e-9 or any(r < 0 for r in ratios.values()):
        raise ValueError("ratios must be non-negative and add up to 1")
    u, acc, out = hash_unit(key, f"{SPLIT_SALT}|{seed}"), 0.0, None
    names = list(ratios)
    for name in names[:-1]:
        acc += ratios[name]
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def shard(key: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(n))


def hmac_id(key: str, kind: str, value: Column, digits: int = 24) -> Column:
    """HMAC-SHA256 of kind and value in builtin functions; hex, shortened."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), F.encode(F.concat(F.lit(kind + "|"), value), "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), inner), 256), 1, digits)


def split_leaks(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """(field, value, n_rows, splits) of every value that stands in two or more splits; nulls and blanks do not count."""
    long = df.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x"))
    seen = long.where("trim(x.value) <> ''").groupBy("x.field", "x.value", "s").agg(F.count("*").alias("n"))
    return seen.groupBy("field", "value").agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("splits"), F.count("*").alias("k")).where("k > 1").drop("k")


def audit_near_duplicates(df: DataFrame, key: str, text: str, split: str, ratio: float = 0.94, least: int = 32) -> DataFrame:
    """(key_a, key_b, ratio): pairs across splits with an indel ratio from ``ratio`` on, exact copies not included.

    A replaced letter costs two indels and breaks one word, so texts within the ratio keep all but ``lost`` of their distinct
    words, and any two of the kept ones stand among the ``lost + 2`` rarest of both: texts are joined on pairs of such words, which are far
    rarer than words. Texts that differ in inserted or deleted letters only, one per word, from end to end can be missed.
    Copies are met once: pairs are between distinct texts of a split, ``key`` being the least key of the copies.
    """
    t = df.where(F.col(split).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(split).alias("s"), nfkc_folded(text).alias("t")).where(F.length("t") >= least)
    t = t.groupBy("t", "s").agg(F.min("k").alias("k"))
    word = t.select("k", "s", F.length("t").alias("n"), F.explode(F.array_distinct(word_list(F.col("t")))).alias("w"))
    counts = word.groupBy("w").agg(F.count("*").alias("c"))
    lost = (F.ceil((F.floor(F.first("n") * (1 - ratio) * 2 / ratio) + 1) / 2) + 2).cast("int")
    rare = word.join(counts, "w").groupBy("k", "s").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", F.xxhash64("w").alias("h")))).alias("o"), lost.alias("lost"))
    rare = rare.select("k", "s", "n", "lost", F.transform("o", lambda x: x["h"]).alias("all"), F.transform(F.slice("o", 1, F.col("lost") + 2), lambda x: x["h"]).alias("h"))
    both = F.flatten(F.transform("h", lambda a, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b)))))
    grams = rare.select("k", "s", "n", F.explode(both).alias("g"))
    a, b = grams.select("g", F.col("k").alias("ka"), F.col("s").alias("sa"), F.col("n").alias("na")), grams.select("g", F.col("k").alias("kb"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    close = 2 * F.least("na", "nb") >= ratio * (F.col("na") + F.col("nb"))
    cand = a.join(b, "g").where((F.col("sa") < F.col("sb")) & close).select("ka", "sa", "kb", "sb").distinct()
    wa, wb = rare.select(F.col("k").alias("ka"), F.col("s").alias("sa"), F.col("all").alias("wa"), F.col("lost").alias("la")), rare.select(F.col("k").alias("kb"), F.col("s").alias("sb"), F.col("all").alias("wb"), F.col("lost").alias("lb"))
    kept = F.size(F.array_intersect("wa", "wb")) >= F.greatest(F.size("wa"), F.size("wb")) - F.greatest("la", "lb")
    cand = cand.join(wa, ["ka", "sa"]).join(wb, ["kb", "sb"]).where(kept).select("ka", "sa", "kb", "sb")
    ta, tb = t.select(F.col("k").alias("ka"), F.col("s").alias("sa"), F.col("t").alias("ta")), t.select(F.col("k").alias("kb"), F.col("s").alias("sb"), F.col("t").alias("tb"))
    full = cand.join(ta, ["ka", "sa"]).join(tb, ["kb", "sb"]).where("ta <> tb").repartition(workers(df.sparkSession) * 2)
    full = full.withColumn("ratio", indel_ratio("ta", "tb"))
    return full.where(F.col("ratio") >= ratio).select(F.col("ka").alias("key_a"), F.col("kb").alias("key_b"), F.round("ratio", 9).alias("ratio"))


QUOTA_ROWS = 100_000


def greedy_quota(df: DataFrame, order: str, family: str, per_family: int, targets: dict[str, int]) -> DataFrame:
    """Rows by the number ``order`` (unique), at most ``per_family`` of a family, up to the first at which every running total meets its target.

    The running totals need one order over all rows: rows are laid out in ranges of the order of about ``QUOTA_ROWS`` rows, totals are taken over
    the sums of the ranges first and then inside each range.
    """
    kept = df.withColumn("_f", F.row_number().over(W.partitionBy(family).orderBy(order))).where(F.col("_f") <= per_family).drop("_f")
    n = kept.count()
    if not n:
        return df.limit(0)
    kept = written(kept.repartitionByRange(max(1, -(-n // QUOTA_ROWS)), order).withColumn("_b", F.spark_partition_id()), "quota")
    sums = kept.groupBy("_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in targets])
    before = sums.select("_b", *[(F.coalesce(F.sum(f"_s_{c}").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias(f"_o_{c}") for c in targets])
    w = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = kept.join(before, "_b").select("*", *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"_r_{c}") for c in targets])
    done = F.lit(True)
    for c, n in targets.items():
        done = done & (F.col(f"_r_{c}") - F.col(c) >= n)
    return run.where(~done).drop("_b", *[f"_o_{c}" for c in targets], *[f"_r_{c}" for c in targets])


def join_tokens(tokens) -> str:
    """Tokens as text: no blank before closing and after opening signs nor around joiners."""
    out: list[str] = []
    last = ""
    for t in tokens:
        if not (t := (t or "").strip()):
            continue
        if last and not (t[0] in ".,;:!?%)]}׳״" or t in JOINERS or last in "([{״" or last in JOINERS):
            out.append(" ")
        out.append(t)
        last = t[-1]
    return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(T.StringType())
def smart_join(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else join_tokens(t))


@F.pandas_udf(T.StringType())
def smart_lines(text: pd.Series) -> pd.Series:
    """``join_tokens`` over all tokens of every line."""
    return text.map(lambda t: None if t is None else "\n".join(join_tokens(line.split()) for line in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")))


# Private glyphs of PDF fonts and what a reader sees.
GLYPHS = {"\uf027": "☎", "\uf0b7": "•"}
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Every eth of a run that has no Latin letter at either end.
LONE_ETH = f"(?:(?<!{_LATIN})(?=ð+(?!{_LATIN}))|\\G(?!^))ð"


def repair_pdf_text(c: Column) -> Column:
    """Byte-order marks dropped, private glyphs replaced; the eths of a run are the letter nun unless a Latin letter stands beside it."""
    x = F.translate(c, "".join(GLYPHS) + "\ufeff", "".join(GLYPHS.values()))
    return F.regexp_replace(x, LONE_ETH, "נ")


def repair_counts(c: Column) -> dict[str, Column]:
    """How many of each repair a text takes."""
    names = {"bom": "\ufeff"} | {f"glyph_{ord(g):04x}": g for g in GLYPHS}
    return {k: F.regexp_count(c, F.lit(v)).cast("long") for k, v in names.items()} | {"eth": F.regexp_count(c, F.lit(LONE_ETH)).cast("long")}
