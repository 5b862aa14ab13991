"""Problem 7: held-out passages inside training texts.

Rare n-gram seeds join texts to passages: three words of a passage, in a row or with one word between (``SHAPES``), without those that so
many different passages of the whole set share that they are stock formulas; a passage of which that would leave less than two thirds of its
words covered (one of many near copies) keeps all. Every five words in a row of which no two neighbours are misspelt and three are right hold such a
seed. Passages of the same words are searched once. Where a text and a passage meet in enough seeds within the window,
Smith-Waterman alignment over words scores the stretch of text (a word misspelt by a few letters still
matches), and an exact chain of the aligned stretches decides.

The passages are a stated test set. They are taken in blocks of ``BLOCK`` passages, each small enough to send to every
executor whatever the set's size; the texts are streamed through each block and never shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .words import alike, plain_words

BLOCK = 20_000
STOCK_SHARE = 0.05
#: Where the three words of a seed stand.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
SUB_BATCH = 256
GAP = 0.01
CELLS = 1_000_000
RANGES = 1 << 16


class Passages:
    """The seed index of one block of passages."""

    def __init__(self, numbers: list[list[int]], texts: list[list[str]], window: int, stock: set[str]):
        """``numbers`` has all passages of each word sequence of ``texts``; ``stock`` the seeds to do without."""
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.numbers, self.words = numbers, texts
        self.ids = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64) for w in texts]
        base = self.base = len(self.vocabulary) + 1
        if base**3 * len(SHAPES) >= 1 << 63:
            raise ValueError("too many different words in one block of passages")
        offsets = self.offsets = np.array(SHAPES, np.int64)
        keys, owner, place, shape, cover = [], [], [], [], []
        for p, (ids, w) in enumerate(zip(self.ids, texts, strict=True)):
            found = [(k, i) for k, at in enumerate(SHAPES) for i in range(len(w) - at[2]) if not stock or seed_name(k, [w[i + x] for x in at]) not in stock]
            if len({i + x for k, i in found for x in SHAPES[k]}) * 3 < 2 * len(w):
                found = [(k, i) for k, at in enumerate(SHAPES) for i in range(len(w) - at[2])]
            k, i = np.array(found, np.int64).reshape(-1, 2).T
            at = i[:, None] + offsets[k]
            keys.append(((ids[at[:, 0]] * base + ids[at[:, 1]]) * base + ids[at[:, 2]]) * len(SHAPES) + k)
            owner.append(np.full(len(k), p))
            place.append(i)
            shape.append(k)
            cover.append(len(np.unique(at)))
        none = [np.zeros(0, np.int64)]
        key, own, pos, kind = (np.concatenate(x or none) for x in (keys, owner, place, shape))
        order = np.argsort(key, kind="stable")
        self.key, self.own, self.pos, self.shape = key[order], own[order], pos[order], kind[order]
        n, cover = np.array([len(w) for w in self.words], np.int64), np.array(cover, np.int64)
        self.signs = signatures([x for w in texts for x in w])
        self.n, self.flat, self.starts = n, np.concatenate(self.ids or none), np.cumsum(n) - n
        self.half = (n + 1) // 2
        #: Words of the passage that seeds must cover within the window: half of what must stand there less what rare seeds do not cover at all.
        self.least = np.maximum(3, (self.half - (n - cover) + 1) // 2)
        #: Words that must stand in runs on the diagonals of the seeds.
        self.in_runs = np.maximum(1, self.half - (n - cover))

    def seeds(self, ids: np.ndarray, ends: np.ndarray):
        """(position, passage, place in it, shape) of every seed in a run of texts; ``ends`` marks where texts end."""
        if len(ids) < 3 or not len(self.key):
            return (np.zeros(0, np.int64),) * 4
        room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(ids))
        first = np.flatnonzero(ids >= 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (_, x, y) in enumerate(SHAPES):
            at = first[room[first] > y]
            at = at[(ids[at + x] >= 0) & (ids[at + y] >= 0)]
            found.append((at, ((ids[at] * self.base + ids[at + x]) * self.base + ids[at + y]) * len(SHAPES) + k))
        at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        lo = np.searchsorted(self.key, key, "left")
        hit = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == key)
        at, lo = at[hit], lo[hit]
        n = np.searchsorted(self.key, key[hit], "right") - lo
        rep = np.repeat(np.arange(len(at)), n)
        inside = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return at[rep], self.own[inside], self.pos[inside], self.shape[inside]


@lru_cache(1 << 16)
def _signature(word: str) -> tuple[int, int]:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return len(word), bits


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of words and maps of the letters they hold."""
    both = [_signature(w) for w in words]
    return np.array([n for n, _ in both], np.int64), np.array([b for _, b in both], np.uint64)


def may_be_alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether words with these signatures can be `alike`: an edit changes the length by one at most and the map in two letters at most."""
    most = np.maximum(1, np.maximum(a[0], b[0]) // 3)
    return (np.abs(a[0] - b[0]) <= most) & (np.bitwise_count(a[1] ^ b[1]) <= 2 * most)


def enough_in_runs(index: Passages, own: np.ndarray, seed_diagonal: np.ndarray, seed_group: np.ndarray, first: np.ndarray, end: np.ndarray, ids: np.ndarray, signs_at, shortest: int) -> np.ndarray:
    """Of each seed whether runs on the diagonals of seeds nearby can hold enough words of the passage; seeds are grouped by text and passage.

    A run has at least ``shortest`` - 1 words, equal ones and between two of them single ones whose letters do not speak against a misspelling; one more word
    may follow at either end. So this is an upper bound of what `stretches` finds there. ``signs_at`` gives the signatures of the words at places of the text. Diagonals are looked at in overlapping ranges, one of
    which holds all that a window of text can. ``own``, ``first`` and ``end`` (of the text in ``ids``) are per group.
    """
    reach_of = index.window + index.n[own]
    at_range = (seed_diagonal - first[seed_group]) // reach_of[seed_group] + 4  # the diagonals of a text start at most one passage before it
    pair = np.unique(np.concatenate([(seed_group * RANGES + at_range - k) << 32 | (seed_diagonal + (1 << 30)) for k in (0, 1)]))
    window, diagonal = pair >> 32, (pair & 0xFFFFFFFF) - (1 << 30)
    windows, group = np.unique(window, return_inverse=True)
    good = _full_windows(index, own[windows // RANGES], diagonal, group, first[windows // RANGES], end[windows // RANGES], ids, signs_at, shortest)
    key = seed_group * RANGES + at_range
    return np.isin(key, windows[good]) | np.isin(key - 1, windows[good])


def _full_windows(index, own, diagonal, group, first, end, ids, signs_at, shortest) -> np.ndarray:
    size = index.n[own]
    good = np.zeros(len(own), bool)
    order = np.argsort(size[group], kind="stable")
    group, diagonal = group[order], diagonal[order]
    by_size = np.argsort(size, kind="stable")
    rows_of = np.bincount(group, minlength=len(own))[by_size]
    cells = np.cumsum(rows_of * size[by_size])
    lo = 0
    while lo < len(by_size):  # groups of about equal length together, in tables of bounded size
        hi = max(lo + 1, int(np.searchsorted(cells, (cells[lo - 1] if lo else 0) + CELLS, "right")))
        chosen = by_size[lo:hi]
        inside = np.zeros(len(own), bool)
        inside[chosen] = True
        take = np.flatnonzero(inside[group])
        take = take[np.argsort(group[take], kind="stable")]
        g, d = group[take], diagonal[take]
        at = np.arange(int(size[chosen].max()))
        p, t = index.starts[own[g]][:, None] + at, d[:, None] + at
        eq = (at < size[g][:, None]) & (t >= first[g][:, None]) & (t < end[g][:, None])
        eq &= index.flat[np.minimum(p, len(index.flat) - 1)] == ids[np.clip(t, 0, len(ids) - 1)]
        run = eq.copy()
        r, c = np.nonzero(eq[:, :-2] & eq[:, 2:] & ~eq[:, 1:-1])
        if len(r):
            here = p[r, c + 1]
            alike = may_be_alike((index.signs[0][here], index.signs[1][here]), signs_at(t[r, c + 1]))
            run[r[alike], c[alike] + 1] = True
        small = at.astype(np.int16 if len(at) < 1 << 15 else np.int32)
        left = np.maximum.accumulate(np.where(run, small.dtype.type(-1), small), axis=1)
        right = np.minimum.accumulate(np.where(run, small.dtype.type(len(at)), small)[:, ::-1], axis=1)[:, ::-1]
        long = run & (right - left > shortest - 1)
        reach = long.copy()
        reach[:, 1:] |= long[:, :-1]
        reach[:, :-1] |= long[:, 1:]
        reach &= at < size[g][:, None]
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        got = np.logical_or.reduceat(reach, cut, axis=0).sum(1)
        good[g[cut]] = got >= index.in_runs[own[g[cut]]]
        lo = hi
    return good


def seed_name(shape: int, words: list[str]) -> str:
    return f"{shape} {' '.join(words)}"


def smith_waterman(p: np.ndarray, t: np.ndarray) -> float:
    """The best local alignment score of two word lists: match 1, mismatch -0.5, a gap costs little, for passages may be quoted in parts."""
    m = len(t)
    step = GAP * np.arange(m + 1)
    h = np.zeros(m + 1)
    best = 0.0
    for x in p:
        d = np.zeros(m + 1)
        d[1:] = np.maximum(h[:-1] + np.where(t == x, 1.0, -0.5), 0.0)
        d = np.maximum(d, h - GAP)
        h = np.maximum(np.maximum.accumulate(d + step) - step, 0.0)
        best = max(best, float(h.max()))
    return best


def stretches(pw: list[str], p: np.ndarray, tw: list[str], t: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(passage start, text start, words) of the maximal runs of equal words, single misspelt words between equal ones included."""
    i, j = np.nonzero(p[:, None] == t[None, :])
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    out = []
    k = 0
    while k < len(i):
        a, b, e = int(i[k]), int(j[k]), int(i[k])
        d = b - a
        k += 1
        while k < len(i) and j[k] - i[k] == d and (i[k] == e + 1 or (i[k] == e + 2 and alike(pw[e + 1], tw[e + 1 + d]))):
            e = int(i[k])
            k += 1
        # A misspelt word at either end belongs to the run too.
        while a > 0 and b > 0 and e - a + 1 >= shortest - 1 and len(pw[a - 1]) > 2 and alike(pw[a - 1], tw[b - 1]):
            a, b = a - 1, b - 1
            break
        if e + 1 < len(pw) and e + 1 + d < len(tw) and e - a + 1 >= shortest - 1 and len(pw[e + 1]) > 2 and alike(pw[e + 1], tw[e + 1 + d]):
            e += 1
        if e - a + 1 >= shortest:
            out.append((a, b, e - a + 1))
    return out


def chain(runs: list[tuple[int, int, int]], window: int, shortest: int) -> tuple[int, int, int]:
    """(words, from, to) of the best chain of runs in the passage's order within ``window`` words of text."""
    best = (0, 0, 0)
    runs = sorted(runs, key=lambda r: (r[1], r[0]))
    for first in range(len(runs)):
        b0 = runs[first][1]
        got: list[tuple[int, int, int]] = []  # words so far, passage end, text end
        for a, b, n in runs[first:]:
            n = min(n, b0 + window - b)
            if n < shortest:
                continue
            top = (n, a + n, b + n) if b == b0 else None
            for w, pe, te in got:
                cut = max(0, pe - a, te - b)
                if n - cut >= shortest and (top is None or w + n - cut > top[0]):
                    top = (w + n - cut, a + n, b + n)
            if top:
                got.append(top)
                if top[0] > best[0]:
                    best = (top[0], b0, top[2])
    return best


def _leaks_in(index: Passages, docs: list, word_lists: list[list[str]], shortest: int):
    get = index.vocabulary.get
    lens = np.array([len(w) for w in word_lists])
    ends = np.cumsum(lens)
    ids = np.fromiter((get(x, -1) for w in word_lists for x in w), np.int64, int(ends[-1]) if len(ends) else 0)
    at, own, place, shape = index.seeds(ids, ends)
    if not len(at):
        return

    def signs_at(t: np.ndarray):
        t, back = np.unique(t, return_inverse=True)
        d = np.searchsorted(ends, t, "right")
        n, bits = signatures([word_lists[k][i] for k, i in zip(d.tolist(), (t - (ends - lens)[d]).tolist(), strict=True)])
        return n[back], bits[back]

    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((at, own, doc))
    at, own, place, shape, doc = at[order], own[order], place[order], shape[order], doc[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])
    stop = np.r_[start[1:], len(at)]
    # Words of the passage covered by seeds, before anything costly is done; a seed covers three.
    able = np.flatnonzero((stop - start) * 3 >= index.least[own[start]])
    start, stop = start[able], stop[able]
    group = np.repeat(np.arange(len(start)), stop - start)
    take = np.arange(len(group)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + np.repeat(start, stop - start)
    cover = np.unique((group * (1 << 32) + place[take])[:, None] + index.offsets[shape[take]])
    enough = np.bincount(cover >> 32, minlength=len(start)) >= index.least[own[start]]
    if enough.any():
        number = np.cumsum(enough) - 1
        mine = take[enough[group]]
        start, stop = start[enough], stop[enough]
        d = doc[start]
        mine = mine[enough_in_runs(index, own[start], at[mine] - place[mine], number[group[enough[group]]], ends[d] - lens[d], ends[d], ids, signs_at, shortest)]
        at, own, place, shape, doc = at[mine], own[mine], place[mine], shape[mine], doc[mine]
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]) if len(at) else mine
        stop = np.r_[start[1:], len(at)] if len(at) else mine
    else:
        return
    for s, e in zip(start.tolist(), stop.tolist(), strict=True):
        spots, words_at = at[s:e], place[s:e, None] + index.offsets[shape[s:e]]
        p, d = int(own[s]), int(doc[s])
        first, need = int(ends[d] - lens[d]), int(index.least[p])
        pw, half = index.words[p], int(index.half[p])
        # Regions around the spots from which on seeds within the window cover enough, joined where they touch.
        regions: list[list[int]] = []
        till = np.searchsorted(spots, spots + index.window, "right")
        for k in np.flatnonzero((till - np.arange(len(spots))) * 3 >= need).tolist():
            if regions and int(spots[till[k] - 1]) + len(pw) + index.window - first <= regions[-1][1]:
                continue
            if len(np.unique(words_at[k : till[k]])) < need:
                continue
            x = max(int(spots[k]) - len(pw) - index.window - first, 0)
            y = min(int(spots[till[k] - 1]) + len(pw) + index.window - first, int(lens[d]))
            if regions and x <= regions[-1][1]:
                regions[-1][1] = max(y, regions[-1][1])
            else:
                regions.append([x, y])
        best, score = (0, 0, 0), 0.0
        for x, y in regions:
            t = ids[first + x : first + y]
            sw = smith_waterman(index.ids[p], t)
            score = max(score, sw)
            if sw < 0.35 * half:
                continue
            w, a, b = chain(stretches(pw, index.ids[p], word_lists[d][x:y], t, shortest), index.window, shortest)
            if w > best[0]:
                best = (w, a + x, b + x)
        if best[0] * 2 >= len(pw):
            for no in index.numbers[p]:
                yield docs[d], no, best[0], len(pw), round(score, 2), best[1], best[2]


def word_sequences(held: DataFrame) -> DataFrame:
    """(w, numbers): each different word sequence of the passages (n, p), blanks between, and the passages that are it."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(plain_words(x)) for x in batch.column(1).to_pylist()], pa.string())], names=["n", "w"])

    return held.select("n", "p").mapInArrow(run, "n long, w string").where("w <> ''").groupBy("w").agg(F.sort_array(F.collect_list("n")).alias("numbers"))


def stock_seeds(sequences: DataFrame, n: int) -> set[str]:
    """Seeds in more than ``STOCK_SHARE`` of all ``n`` word sequences; their number is bounded by the seeds of a passage over that share."""
    w = sequences.select(F.split("w", " ").alias("w"))
    found = None
    for k, (_, x, y) in enumerate(SHAPES):
        name = f"transform(sequence(0, size(w) - {y + 1}), i -> concat('{k} ', w[i], ' ', w[i + {x}], ' ', w[i + {y}]))"
        one = w.where(F.size("w") > y).select(F.explode(F.array_distinct(F.expr(name))).alias("g"))
        found = one if found is None else found.unionByName(one)
    return {r["g"] for r in found.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > max(3, STOCK_SHARE * n)).collect()}


def leaks(docs: DataFrame, passages: DataFrame, key: str, text: str, number: str, passage: str, window: int = 200, shortest: int = 5) -> DataFrame:
    """(doc_id, passage_no, words_found, passage_words, score, first_word, last_word), one row per text and passage it leaks.

    A passage leaks if at least half of its words stand in the text, in order, in stretches of ``shortest`` words or more,
    within ``window`` words. Case, marks, punctuation, line breaks, character forms and single misspelt words
    do not count. Null or empty texts and passages give nothing; a passage shorter than ``shortest`` words cannot leak.
    ``key`` and ``number`` must be integers; other columns are not read.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, passage_no long, words_found int, passage_words int, score double, first_word int, last_word int")
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    held = passages.select(F.col(number).cast("long").alias("n"), F.col(passage).alias("p")).where("n is not null and p is not null").dropDuplicates(["n"])
    held = written(word_sequences(held), "passages")
    n = held.count()
    blocks = max(1, -(-n // BLOCK))
    stock = stock_seeds(held, n)
    result = None
    for b in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).collect() if blocks > 1 else held.collect()
        shared = docs.sparkSession.sparkContext.broadcast(Passages([r["numbers"] for r in rows], [r["w"].split(" ") for r in rows], window, stock))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                out: list[tuple] = []
                for lo in range(0, batch.num_rows, SUB_BATCH):
                    part = ids.slice(lo, SUB_BATCH).to_pylist()
                    out.extend(_leaks_in(index, part, [plain_words(x) for x in texts.slice(lo, SUB_BATCH).to_pylist()], shortest))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=schema.names)

        one = src.mapInArrow(run, schema)
        result = one if result is None else result.unionByName(one)
    return result
