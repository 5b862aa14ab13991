"""Edit scripts over any units, as additive counters.

Of all scripts of least length the one with the fewest substitutions counts (then, going back from the end, deletion before insertion
before diagonal), so distance and substitutions fix every counter: insertions - deletions = n_pred - n_ref,
correct = n_ref - substitutions - deletions.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from itertools import chain, count
from operator import ne

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

COUNTERS = ("n_ref", "n_pred", "substitutions", "deletions", "insertions", "correct")
_BIG = 1 << 20


def _least(ref: np.ndarray, pred: np.ndarray) -> int:
    m = len(pred)
    steps = np.arange(m + 1, dtype=np.int64) * _BIG
    row = steps.copy()
    for x in ref:
        cand = row + _BIG
        np.minimum(cand[1:], row[:-1] + np.where(pred == x, 0, _BIG + 1), out=cand[1:])
        row = np.minimum.accumulate(cand - steps) + steps
    return int(row[-1])


def align(ref: Sequence, pred: Sequence) -> tuple[int, int, int, int, int, int]:
    """(n_ref, n_pred, substitutions, deletions, insertions, correct)."""
    n, m = len(ref), len(pred)
    if ref == pred:
        return n, m, 0, 0, 0, n
    r, p = _trimmed(ref, pred)
    ids: dict = {}
    cost = _least(np.array([ids.setdefault(x, len(ids)) for x in r], np.int64), np.array([ids.setdefault(x, len(ids)) for x in p], np.int64)) if r and p else max(len(r), len(p)) * _BIG
    dist, subs = cost // _BIG, cost % _BIG
    dels = (dist - subs - (m - n)) // 2
    return n, m, subs, dels, dels + m - n, n - subs - dels


def _plain(r: Sequence, p: Sequence) -> int | None:
    """The edits of two sides without common start and end, where no table is needed."""
    if not r or not p:
        return len(r) + len(p)
    if len(r) == len(p) and (alone := set(r).difference(p)):
        differ = sum(map(ne, r, p))
        if differ == sum(x in alone for x in r):  # units that the other side lacks are edits in any script
            return differ
    return None


def distance(ref: Sequence, pred: Sequence) -> int:
    """Substitutions, deletions and insertions of `align` together, a column of the table at a time as the bits of two numbers."""
    if ref == pred:
        return 0
    r, p = _trimmed(ref, pred)
    if (found := _plain(r, p)) is not None:
        return found
    if len(r) < len(p):
        r, p = p, r
    at: dict = {}
    for i, x in enumerate(r):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(r)) - 1
    up, down = full, 0
    for x in p:
        eq = at.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = (down | full & ~(diagonal | up)) << 1 | 1, (diagonal & up) << 1
        up, down = (left | ~(diagonal | right)) & full, right & diagonal & full
    return len(p) + up.bit_count() - down.bit_count()


#: Pairs of texts whose tables are filled together, and units of all their longer texts.
_TOGETHER, _UNITS = 1000, 1 << 20


def distances(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """`distance` of each pair; the tables of many pairs are filled together, 64 rows of a table in a word."""
    out, left = [0] * len(pairs), []
    for k, (ref, pred) in enumerate(pairs):
        if ref == pred:
            continue
        r, p = _trimmed(ref, pred)
        found = _plain(r, p)
        if found is None:
            left.append((k, r, p) if len(r) >= len(p) else (k, p, r))
        else:
            out[k] = found
    left.sort(key=lambda x: len(x[1]))
    while left:
        n = min(_TOGETHER, max(1, _UNITS // len(left[-1][1])))
        some, left = left[-n:], left[:-n]
        for (k, *_), d in zip(some, _together([x[1:] for x in some]), strict=True):
            out[k] = d
    return out


def _together(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """The edits of pairs (longer, shorter)."""
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    rows, cols = np.array([len(pairs[k][0]) for k in order]), np.array([len(pairs[k][1]) for k in order])
    n, words, ids = len(order), -(-int(rows.max()) // 64), defaultdict(count(2).__next__)
    long = np.zeros((n, 64 * words), np.uint32)
    short = np.ones((n, int(cols.max())), np.uint32)
    for side, which, size in ((long, 0, rows), (short, 1, cols)):
        side[np.arange(side.shape[1]) < size[:, None]] = list(map(ids.__getitem__, chain.from_iterable(pairs[k][which] for k in order)))
    if len(ids) < 60_000:
        long, short = long.astype(np.uint16), short.astype(np.uint16)
    one, last = np.uint64(1), np.uint64(63)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    first = 0
    for j in range(short.shape[1]):
        first += int(np.searchsorted(cols[first:], j, "right"))  # texts that end here stay as they are
        same = np.packbits(long[first:] == short[first:, j, None], axis=1, bitorder="little").view(np.uint64)
        carry, right_in, left_in = np.uint64(0), one, np.uint64(0)
        for w in range(words):
            eq, u, d = same[:, w], up[w, first:], down[w, first:]
            both = eq & u
            part = both + u
            total = part + carry
            if w + 1 < words:
                carry = ((part < u) | (total < part)).astype(np.uint64)
            diagonal = (total ^ u) | eq | d
            right, to_left = d | ~(diagonal | u), diagonal & u
            shifted = right << one | right_in
            down[w, first:] = shifted & diagonal
            up[w, first:] = to_left << one | left_in | ~(diagonal | shifted)
            right_in, left_in = right >> last, to_left >> last
    bits = np.clip(rows - 64 * np.arange(words)[:, None], 0, 64)  # rows of the table in each word
    held = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
    found = cols + np.bitwise_count(up & held).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & held).sum(axis=0, dtype=np.int64)
    out = [0] * n
    for k, d in zip(order, found.tolist(), strict=True):
        out[k] = d
    return out


def _trimmed(ref: Sequence, pred: Sequence) -> tuple[Sequence, Sequence]:
    """The two without their common start and end."""
    n, m = len(ref), len(pred)
    least = min(n, m)
    a = 0
    while a < least and ref[a] == pred[a]:
        a += 1
    e, least = 0, least - a
    while e < least and ref[-1 - e] == pred[-1 - e]:
        e += 1
    return ref[a : n - e], pred[a : m - e]


def confusions(ref: Sequence, pred: Sequence) -> Counter:
    """(reference, prediction) of every edit of the script: substituted pairs, (unit, "") for deletions, ("", unit) for insertions."""
    ref, pred = _trimmed(ref, pred)
    ids: dict = {}
    r = np.array([ids.setdefault(x, len(ids)) for x in ref], np.int64)
    p = np.array([ids.setdefault(x, len(ids)) for x in pred], np.int64)
    n, m = len(r), len(p)
    steps = np.arange(m + 1, dtype=np.int64) * _BIG
    t = np.empty((n + 1, m + 1), np.int64)
    t[0] = steps
    for i in range(n):
        cand = t[i] + _BIG
        np.minimum(cand[1:], t[i, :-1] + np.where(p == r[i], 0, _BIG + 1), out=cand[1:])
        t[i + 1] = np.minimum.accumulate(cand - steps) + steps
    out: Counter = Counter()
    i, j = n, m
    while i or j:
        here = int(t[i, j])
        if i and here == int(t[i - 1, j]) + _BIG:
            i -= 1
            out[ref[i], ""] += 1
        elif j and here == int(t[i, j - 1]) + _BIG:
            j -= 1
            out["", pred[j]] += 1
        else:
            i, j = i - 1, j - 1
            if ref[i] != pred[j]:
                out[ref[i], pred[j]] += 1
    return out


_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTERS])


@pandas_udf(_SCHEMA)
def aligned_text(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Counters over code points; a null side counts as empty."""
    return pd.DataFrame([align(a or "", b or "") for a, b in zip(ref, pred, strict=True)], columns=list(COUNTERS))


@pandas_udf(_SCHEMA)
def aligned_units(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
    """Counters over the elements of two arrays; a null side counts as empty."""
    return pd.DataFrame([align(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(ref, pred, strict=True)], columns=list(COUNTERS))


@pandas_udf(T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("pred", T.StringType()), T.StructField("n", T.LongType())])))
def confusion_list(ref: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([[(a, b, n) for (a, b), n in sorted(confusions(x or "", y or "").items())] for x, y in zip(ref, pred, strict=True)])


@pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - (insertions + deletions) / (n + m); 1 for two empty texts."""

    def one(x, y):
        if x is None or y is None:
            return None
        if not x and not y:
            return 1.0
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << i
        full = v = (1 << len(x)) - 1
        for c in y:
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def error_rate(a: Column) -> Column:
    return (a["substitutions"] + a["deletions"] + a["insertions"]) / F.greatest(a["n_ref"], F.lit(1))


def summed(prefix: str, a: Column) -> list[Column]:
    """Sums of the counters: add first, divide afterwards."""
    return [F.sum(a[c]).alias(f"{prefix}_{c}") for c in COUNTERS]


MARKS = ("cantillation", "vowel", "dagesh_mapiq", "shin_sin_dot", "meteg_rafe", "other")
_MARK = regex.compile("[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7]")


def _based(text: str) -> list[tuple[str, tuple[str, ...]]]:
    import unicodedata

    out: list[tuple[str, list[str]]] = []
    for c in unicodedata.normalize("NFD", text):
        if _MARK.match(c) and out:
            out[-1][1].append(c)
        elif not _MARK.match(c):
            out.append((c, []))
    return [(b, tuple(m)) for b, m in out]


def diacritics(ref: str, pred: str) -> tuple[int, int, int, int, int]:
    """(marks in reference, marks in prediction, right marks, bases paired, bases with marks all right).

    Bases are aligned first; marks of a pair of equal bases are compared as bags, marks of other bases are lost or made up.
    """
    import difflib

    r, p = _based(ref), _based(pred)
    right = pairs = exact = 0
    rb, pb = [x[0] for x in r], [x[0] for x in p]
    for tag, i1, i2, j1, _ in difflib.SequenceMatcher(None, rb, pb, autojunk=False).get_opcodes():
        if tag == "equal":
            for k in range(i2 - i1):
                a, b = Counter(r[i1 + k][1]), Counter(p[j1 + k][1])
                right += sum((a & b).values())
                pairs += 1
                exact += a == b
    return sum(len(m) for _, m in r), sum(len(m) for _, m in p), right, pairs, exact


@pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("ref_marks", "pred_marks", "right_marks", "paired_bases", "exact_bases")]))
def diacritic_counts(ref: pd.Series, pred: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([diacritics(a or "", b or "") for a, b in zip(ref, pred, strict=True)], columns=["ref_marks", "pred_marks", "right_marks", "paired_bases", "exact_bases"])
