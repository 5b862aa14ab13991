"""Problem 2: the same or near-same records across splits, by a compressed full-text index.

The distinct texts of the evaluation splits are laid out in shards of bounded size, by length. The distinct training texts
are streamed past the shards where they lie (they are never shuffled) and meet only texts of lengths that can reach the ratio.
Pairs are first bounded by the characters that they hold in any order: by groups of characters, one addition of small counts
per group for a training text and all texts of a shard; then by single characters and by pairs of neighbours. Where a training text has many
partners left, the shard's FM-index (the Burrows-Wheeler transform as one bit vector with rank counts per symbol, and the order of the
suffixes for locating) is searched backwards from every position for short seeds (4 characters at 0.88), and partners with fewer
seeds than the ratio forces on them are dropped. The rest are decided by the exact number of characters shared in order.

All bounds hold wherever the edits stand, so every pair is found. Shards live in the shared folder, so a lost executor only reads again; a task
takes in ``BLOCK_CHARS`` of training text before it goes through the shards, so reading them stays small beside comparing.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import new_path, workers, written
from .words import bare

LONGEST_SEED = 12
SPAN = 12
SHARD_CHARS = 4_000_000
BLOCK_CHARS = 8_000_000
TASK_CHARS = 8_000_000
SYMBOLS = 63
#: Classes of characters that texts are counted by, groups of them, of each training text the groups that are compared, and classes of neighbours.
CLASSES, GROUPS, MOST, NEIGHBOURS = 64, 48, 24, 2048
#: Held texts compared at once, bytes of counts kept for that, pairs bounded at a time; partners of a training text in a shard beyond which seeds are looked up.
RUN, KEPT_BYTES, BATCH, MANY = 50_000, 64 << 20, 16_384, 64
#: What is kept of an index.
KEPT = {"starts": np.int64, "alphabet": np.uint32, "symbols": np.uint8, "order": np.int32, "owner": np.int32, "held_symbols": np.int32, "bits": np.uint64, "ranks": np.int32, "before": np.int64}
_OTHER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits only; case, marks, punctuation, blanks and invisible signs set aside."""
    return _OTHER.sub("", bare(text))


def _as_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a 0 after each, and where each starts."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\0".join(texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lens) - lens


class Index:
    """One shard: searched backwards with rank counts on a bit vector per symbol."""

    def __init__(self, texts: list[str]):
        chars, self.starts = _as_codes(texts)
        found, counts = np.unique(chars[chars != 0], return_counts=True)
        place = np.empty(len(found), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(found))
        self.alphabet, self.symbols = found, (place % SYMBOLS + 1).astype(np.uint8)
        x = self.encode(chars)
        n = self.n = len(x)
        pad = np.concatenate([x, np.zeros(32, np.uint8)]).astype(np.uint64)
        two = (pad[:-1] << np.uint64(6)) | pad[1:]
        four = (two[:-2] << np.uint64(12)) | two[2:]
        eight = (four[:-4] << np.uint64(24)) | four[4:]
        ten = (eight[: n + 10] << np.uint64(12)) | two[8 : n + 18]
        self.order = np.lexsort((ten[10 : n + 10], ten[:n])).astype(np.int32)  # right for the first 20 symbols
        last = x[self.order - 1]
        self.words = n // 64 + 1
        bits = np.zeros((SYMBOLS + 1, self.words), np.uint64)
        ranks = np.zeros((SYMBOLS + 1, self.words), np.int32)
        for c in range(1, SYMBOLS + 1):
            w = np.zeros(self.words * 64, bool)
            w[:n] = last == c
            bits[c] = np.packbits(w, bitorder="little").view(np.uint64)
            ranks[c, 1:] = np.cumsum(np.bitwise_count(bits[c]))[:-1]
        self.bits, self.ranks = bits.ravel(), ranks.ravel()
        self.before = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=SYMBOLS + 1))])[: SYMBOLS + 1].astype(np.int64)
        owner = np.searchsorted(self.starts, np.arange(n), "right") - 1
        self.owner = owner[self.order].astype(np.int32)
        self.held_symbols = np.bincount(owner * (SYMBOLS + 1) + x, minlength=len(self.starts) * (SYMBOLS + 1)).reshape(-1, SYMBOLS + 1).astype(np.int32)
        self.held_symbols[:, 0] = 0

    def encode(self, chars: np.ndarray) -> np.ndarray:
        """Symbols 1 to ``SYMBOLS``; separators and characters that the shard lacks are 0, which matches nothing.

        Every character of the shard has a symbol; beyond ``SYMBOLS`` characters rare ones share it with others, which can only add matches.
        """
        if not len(self.alphabet):
            return np.zeros(len(chars), np.uint8)
        i = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == chars, self.symbols[i], 0).astype(np.uint8)

    def _step(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        k = c * self.words + (at >> 6)
        low = self.bits[k] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[c] + self.ranks[k] + np.bitwise_count(low)

    def search(self, x: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, from, to): the rows of the index that start with the ``depth`` symbols before each end; ends without any are left out."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for j in range(1, depth + 1):
            c = x[ends - j].astype(np.int64)
            lo, hi = self._step(c, lo), self._step(c, hi)
            live = (lo < hi) & (c > 0)
            if not live.all():
                ends, lo, hi = ends[live], lo[live], hi[live]
        return ends, lo, hi

    def save(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in KEPT}

    @classmethod
    def load(cls, parts: dict[str, bytes]) -> Index:
        x = cls.__new__(cls)
        for k, kind in KEPT.items():
            setattr(x, k, np.frombuffer(parts[k], kind))
        x.n = len(x.order)
        x.words = x.n // 64 + 1
        x.held_symbols = x.held_symbols.reshape(-1, SYMBOLS + 1)
        return x


def shared_in_order(a: str, b: str) -> int:
    """The number of characters two texts share in order, with one machine word operation per character and block of ``a``."""
    s = 0
    while s < min(len(a), len(b)) and a[s] == b[s]:
        s += 1
    e = 0
    while e < min(len(a), len(b)) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if not a or not b:
        return s + e
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    get = where.get
    for c in b:
        u = v & get(c, 0)
        v = ((v + u) | (v - u)) & full
    return s + e + len(a) - v.bit_count()


def seed_length(ratio: Fraction) -> int:
    """The longest seed that texts of ``ratio`` must share if they are long enough, wherever the edits stand."""
    a, b = ratio.numerator, ratio.denominator
    return LONGEST_SEED if a >= b else max(1, min(LONGEST_SEED, -(-a // (2 * (b - a)))))


def common_spans(a: str, b: str, least: int = SPAN) -> tuple[int, int]:
    """(spans, longest): the maximal common runs of at least ``least`` characters."""
    if a == b:
        return 1, len(a)
    where: dict[str, list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(b[j : j + least], []).append(j)
    ends: dict[int, tuple[int, int]] = {}  # of each diagonal the last run's start and last seed
    n = longest = 0
    for i in range(len(a) - least + 1):
        for j in where.get(a[i : i + least], ()):
            start, last = ends.get(j - i, (i, -2))
            if last != i - 1:
                start = i
                n += 1
            ends[j - i] = (start, i)
            longest = max(longest, i - start + least)
    return n, longest


class Signs:
    """Classes of characters: the ``CLASSES`` - 1 most frequent ones of a sample and the rest (0). Any sample gives right bounds, a good one close bounds."""

    def __init__(self, sample: list[str]):
        chars = _as_codes(sample)[0]
        found, counts = np.unique(chars[chars != 0], return_counts=True)
        self.top = np.sort(found[np.argsort(-counts, kind="stable")[: CLASSES - 1]])
        weight = np.sqrt(np.bincount(self.of(found), counts, CLASSES))
        middle = (np.cumsum(weight) - weight / 2) / max(weight.sum(), 1)
        # Neighbours by code point, so that scripts stay apart.
        self.group = np.minimum((middle * GROUPS).astype(np.int64), GROUPS - 1)
        # The classes whose share differs most between texts.
        share = _counts(sample, self) / np.maximum([[len(t)] for t in sample] or np.zeros((0, 1)), 1)
        self.part = np.zeros(CLASSES, bool)
        if len(share) > 1:
            axes = np.linalg.eigh(np.cov(share.T))[1].T[-8:] > 0
            apart = np.median(np.abs(np.diff(share @ axes.T, axis=0)), 0)
            self.part = axes[int(apart.argmax())]

    def of(self, chars: np.ndarray) -> np.ndarray:
        return _table(self.top.tobytes())[chars]


@lru_cache(2)
def _table(top: bytes) -> np.ndarray:
    codes = np.frombuffer(top, np.uint32)
    table = np.zeros(0x110000, np.uint8)
    table[codes] = np.arange(1, len(codes) + 1)
    return table


def _counts(texts: list[str], signs: Signs, neighbours: bool = False) -> np.ndarray:
    """How often each text has each class of characters, or of two neighbours."""
    width = NEIGHBOURS if neighbours else CLASSES
    out, piece, chars = [np.zeros((0, width), np.uint8)], [], 0
    for i, text in enumerate(texts, 1):
        piece.append(text)
        chars += len(text)
        if i == len(texts) or len(piece) >= (100 if neighbours else 1000) or chars >= 500_000:
            codes, starts = _as_codes(piece)
            owner = np.repeat(np.arange(len(piece)), np.diff(np.append(starts, len(codes))))
            keys = signs.of(codes).astype(np.int64)
            inside = codes != 0
            if neighbours:
                keys, inside, owner = (keys[:-1] * 37 + keys[1:]) % NEIGHBOURS, inside[:-1] & inside[1:], owner[:-1]
            n = np.bincount(owner[inside] * width + keys[inside], minlength=len(piece) * width).reshape(-1, width)
            out.append(n.astype(np.uint8 if n.max() < 256 else np.int32))
            piece, chars = [], 0
    return np.concatenate(out)


class Side:
    """Texts in order of length, with what is counted of them; ``at`` are their numbers in the order given."""

    def __init__(self, names: list[str], texts: list[str], signs: Signs):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.argsort(lens, kind="stable")
        self.names, self.texts, self.lens = [names[i] for i in self.at], [texts[i] for i in self.at], lens[self.at]
        self.signs, self.symbols = signs, _counts(self.texts, signs)
        self.groups = np.zeros((GROUPS, len(texts)), np.int32)
        for c in range(CLASSES):
            self.groups[signs.group[c]] += self.symbols[:, c]
        self.part = self.symbols[:, signs.part].sum(1, dtype=np.int64)


def _lowest(size, lens, ratio: Fraction):
    """The characters that texts of these lengths must share."""
    return -(-ratio.numerator * (size + lens) // (2 * ratio.denominator))


def _same_groups(train: Side, held: Side, ratio: Fraction):
    """(numbers of training texts, numbers of held texts), in batches: pairs that the counts of groups leave possible.

    Of a training text of n characters that shares L in order with another, at most n - L are missing there; those missing by group are added up.
    In bytes a sum may pass 255 and begin again, which can only let a pair through.
    """
    most = np.argsort(-train.groups, axis=0, kind="stable")[:MOST]
    counts = np.take_along_axis(train.groups, most, 0)
    keys, used = (most << 32) + counts, (counts > 0).sum(0).tolist()
    sizes, starts = np.unique(train.lens, return_index=True)
    ends = [*starts[1:].tolist(), len(train.lens)]
    runs = -(-len(held.texts) // RUN)
    ts: list[np.ndarray] = []
    hs: list[np.ndarray] = []
    waiting = 0
    for run in np.array_split(np.arange(len(held.texts)), max(1, runs)):
        run = run[np.argsort(held.part[run], kind="stable")]
        groups, part, lens = held.groups[:, run], held.part[run], held.lens[run]
        kind = np.uint8
        rows: dict[int, np.ndarray] = {}
        for size, start, end in zip(sizes.tolist(), starts.tolist(), ends, strict=True):
            low = _lowest(size, lens, ratio)
            able = np.minimum(size, lens) >= low
            if not able.any():
                continue
            spare = np.where(able, size - low + 1, 0)
            if kind is np.uint8 and spare.max() > 255:
                kind = np.int32
                rows.clear()
            top = np.iinfo(kind).max
            spare, total = spare.astype(kind), np.empty(len(run), kind)
            # Nor can more of the characters of ``part`` be missing on either side.
            lo = np.searchsorted(part, train.part[start:end] - int((size - low)[able].max())).tolist()
            hi = np.searchsorted(part, train.part[start:end] + int((lens - low)[able].max()), "right").tolist()
            wanted = keys[:, start:end].T.tolist()
            for t in range(start, end):
                i, j = lo[t - start], hi[t - start]
                if i >= j:
                    continue
                missing = total[: j - i]
                missing.fill(0)
                for key in wanted[t - start][: used[t]]:
                    row = rows.get(key)
                    if row is None:
                        if len(rows) * total.nbytes > KEPT_BYTES:
                            rows.clear()
                        row = rows[key] = np.minimum(np.maximum((key & 0xFFFFFFFF) - groups[key >> 32], 0), top).astype(kind)
                    np.add(missing, row[i:j], missing)
                near = (missing < spare[i:j]).nonzero()[0]
                if len(near):
                    ts.append(np.full(len(near), t))
                    hs.append(run[near + i])
                    waiting += len(near)
                    if waiting >= BATCH:
                        yield np.concatenate(ts), np.concatenate(hs)
                        ts, hs, waiting = [], [], 0
    if waiting:
        yield np.concatenate(ts), np.concatenate(hs)


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sums of the lesser counts of rows i of a and rows j of b."""
    step = max(1, (1 << 18) // a.shape[1])
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(i), step):
        least = np.minimum(a[i[k : k + step]], b[j[k : k + step]])
        if least.dtype != np.uint8:
            out.append(least.sum(1, dtype=np.int64))
            continue
        # Eight counts to a word, added in lanes of 16 bits: at most 128 times two counts each.
        words = least.view(np.uint64)
        lane = np.uint64(0x00FF00FF00FF00FF)
        sums = ((words & lane) + ((words >> np.uint64(8)) & lane)).reshape(len(least), -1, min(128, words.shape[1])).sum(2)
        out.append(sum((sums >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 16, 32, 48)).sum(1).astype(np.int64))
    return np.concatenate(out)


def _possible(train: Side, held: Side, ratio: Fraction):
    """(numbers of training texts, numbers of held texts), in batches: pairs that the counts of characters and of neighbours leave possible.

    Two texts of together s characters that share L of them in order share them in at most s - 2L + 1 runs, so at least
    L - (s - 2L + 1) pairs of neighbours stand in those runs.
    """
    beside = None
    for t, h in _same_groups(train, held, ratio):
        low = _lowest(train.lens[t], held.lens[h], ratio)
        keep = _common(train.symbols, t, held.symbols, h) >= low
        t, h, low = t[keep], h[keep], low[keep]
        if not len(t):
            continue
        if beside is None:
            beside = _counts(held.texts, held.signs, True)
        own, place = np.unique(t, return_inverse=True)
        mine = _counts([train.texts[i] for i in own.tolist()], train.signs, True)
        keep = _common(mine, place, beside, h) >= low - (train.lens[t] + held.lens[h] - 2 * low + 1)
        if keep.any():
            yield t[keep], h[keep]


def _seeded(index: Index, text: str, held: np.ndarray, lens: np.ndarray, ratio: Fraction) -> np.ndarray:
    """Which of the ``held`` texts of the index, of ``lens`` characters, have the seeds of ``text`` that the ratio forces on them.

    As with neighbours, at least L - (seed - 1) * (s - 2L + 1) seeds stand in common runs. That many places of the held text must hold a seed of the training text.
    """
    chars, _ = _as_codes([text])
    x = index.encode(chars)
    seed = seed_length(ratio)
    _, lo, hi = index.search(x, np.arange(seed, len(x)), seed)
    low = _lowest(len(text), lens, ratio)
    need = low - (seed - 1) * (len(text) + lens - 2 * low + 1)
    rows, first, times = np.unique(lo, return_index=True, return_counts=True)
    till = hi[first]
    # The most frequent seeds are not looked up; the places they take are taken off what is needed.
    order = np.argsort(rows - till, kind="stable")
    taken = np.cumsum(times[order])
    skip = int(np.searchsorted(taken, int(need.min()) // 2, "right"))
    lost = int(taken[skip - 1]) if skip else 0
    lists = [index.owner[i:j] for i, j in zip(rows[order[skip:]].tolist(), till[order[skip:]].tolist(), strict=True)]
    k = np.bincount(np.concatenate(lists), minlength=len(index.held_symbols)) if lists else np.zeros(len(index.held_symbols), np.int64)
    return k[held] >= need - lost


def _pairs(index, held: Side, train: Side, ratio: Fraction):
    """Pairs of one block of training texts and one shard; ``index`` gives the shard's index."""
    a, b = ratio.numerator, ratio.denominator
    for ts, hs in _possible(train, held, ratio):
        order = np.argsort(ts, kind="stable")
        ts, hs = ts[order], hs[order]
        own, first = np.unique(ts, return_index=True)
        for t, near in zip(own.tolist(), np.split(hs, first[1:]), strict=True):
            ta = train.texts[t]
            if len(near) > MANY:
                near = near[_seeded(index(), ta, held.at[near], held.lens[near], ratio)]
            for h in near.tolist():
                tb = held.texts[h]
                common = shared_in_order(ta, tb)
                if 2 * common * b >= a * (len(ta) + len(tb)):
                    yield train.names[t], held.names[h], common, len(ta), len(tb), *common_spans(ta, tb)


def _pairs_in(index: Index, names: list[str], texts: list[str], train_names: list[str], train: list[str], ratio: Fraction):
    signs = Signs(texts)
    return _pairs(lambda: index, Side(names, texts, signs), Side(train_names, train, signs), ratio)


def _read_shard(path: str, shard: int, kind: str) -> dict[str, bytes]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    rows = ds.dataset(f"{inside}/shard={shard}/kind={kind}", filesystem=where, format="parquet").to_table(columns=["name", "part", "data"])
    got: dict[str, list[tuple[int, bytes]]] = {}
    for name, part, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
        got.setdefault(name, []).append((part, data))
    return {k: b"".join(d for _, d in sorted(v)) for k, v in got.items()}


def _read_side(path: str, shard: int, signs: Signs) -> Side:
    parts = _read_shard(path, shard, "texts")
    return Side(parts["names"].decode().split("\0"), parts["texts"].decode("utf-8", "surrogatepass").split("\0"), signs)


def _placed(held: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``held`` with its shard, and the least and the greatest length in each shard: by length, texts of one length that are too many by hash."""
    sizes = sorted(tuple(r) for r in held.groupBy(F.length("norm").alias("n")).agg(F.count("*").alias("k")).collect())
    shards: list[tuple[int, int]] = []
    rows, room = [], 0
    for n, k in sizes:
        size = (n + 1) * k
        parts = min(k, -(-size // SHARD_CHARS))
        if parts > 1 or size > room:
            rows.append((n, len(shards), parts))
            shards += [(n, n)] * parts
            room = SHARD_CHARS - size if parts == 1 else 0
        else:
            rows.append((n, len(shards) - 1, 1))
            shards[-1] = (shards[-1][0], n)
            room -= size
    places = held.sparkSession.createDataFrame(rows, "n int, first int, parts int")
    placed = held.withColumn("n", F.length("norm")).join(F.broadcast(places), "n")
    return placed.select("name", "norm", (F.col("first") + F.pmod(F.xxhash64("norm"), F.col("parts"))).cast("int").alias("shard")), shards


def _write_index(placed: DataFrame, path: str) -> None:
    def build(key, table):
        names, texts = table.column("name").to_pylist(), table.column("norm").to_pylist()
        parts = Index(texts).save() | {"names": "\0".join(names).encode(), "texts": "\0".join(texts).encode("utf-8", "surrogatepass")}
        rows = [("index" if k in KEPT else "texts", k, i, v[i * (8 << 20) : (i + 1) * (8 << 20)]) for k, v in parts.items() for i in range(max(1, -(-len(v) // (8 << 20))))]
        cols = list(zip(*rows, strict=True))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "kind": pa.array(cols[0]), "name": pa.array(cols[1]), "part": pa.array(cols[2], pa.int32()), "data": pa.array(cols[3], pa.binary())})

    placed.groupBy("shard").applyInArrow(build, "shard int, kind string, name string, part int, data binary").write.partitionBy("shard", "kind").parquet(path)


def normalised(records: DataFrame, least_chars: int) -> DataFrame:
    """(name, split, source, held, sig, norm) of the records long enough; ``held`` says evaluation side.

    Records with a null name, text or split are left out.
    """
    import hashlib

    def run(batches):
        for batch in batches:
            norm = [letters(t) for t in batch.column(3).to_pylist()]
            keep = pa.array([len(t) >= least_chars for t in norm])
            sig = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if len(t) >= least_chars else None for t in norm])
            held = pa.array([s != "train" for s in batch.column(1).to_pylist()])
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], held, sig, pa.array(norm)], names=["name", "split", "source", "held", "sig", "norm"])
            yield out.filter(keep)

    src = records.select("name", "split", "source", "text").where("name is not null and split is not null and length(text) * 3 >= %d" % least_chars)
    return src.mapInArrow(run, "name string, split string, source string, held boolean, sig string, norm string")


def overlaps(records: DataFrame, ratio: float, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``records`` (name, split, source, text), names unique.

    members: name, split, source, held, rep (the least name of the records of the side with the same characters). links: train_rep,
    held_rep, shared, train_chars, held_chars, spans, longest, for each pair of different texts of the two sides with twice ``shared`` at least
    ``ratio`` of both lengths; equal texts are links as well. Texts with fewer than ``least_chars`` characters are in neither.
    """
    spark = records.sparkSession
    limit = Fraction(str(ratio))
    norm = written(normalised(records, least_chars), "overlap-records")
    reps = norm.groupBy("held", "sig").agg(F.min("name").alias("rep"))
    members = written(norm.select("name", "split", "source", "held", "sig").join(reps, ["held", "sig"]).select("name", "split", "source", "held", "rep"), "overlap-members")
    texts = written(norm.join(members.where("name = rep").select("name"), "name", "left_semi").select("name", "held", "norm"), "overlap-texts")
    held = texts.where("held").select("name", "norm")
    signs = Signs([r[0] for r in held.select(F.substring("norm", 1, 200)).limit(5000).collect()])
    placed, shards = _placed(held)
    path, filled = new_path(spark, "eval-index"), set()
    if shards:
        _write_index(placed, path)
        filled = {r[0] for r in spark.read.parquet(path).select("shard").distinct().collect()}

    def run(batches):
        loaded: OrderedDict[int, Side] = OrderedDict()

        def search(names, block):
            train = Side(names, block, signs)
            sizes = np.unique(train.lens)
            for shard, (least, most) in enumerate(shards):
                nearest = np.clip(sizes, least, most)
                if shard not in filled or not (np.minimum(sizes, nearest) >= _lowest(sizes, nearest, limit)).any():
                    continue
                if shard not in loaded:
                    loaded[shard] = _read_side(path, shard, signs)
                    while len(loaded) > 2:
                        loaded.popitem(last=False)
                index = lru_cache(1)(lambda shard=shard: Index.load(_read_shard(path, shard, "index")))
                out = list(_pairs(index, loaded[shard], train, limit))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = (pa.string(), pa.string(), *[pa.int32()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["train_rep", "held_rep", "shared", "train_chars", "held_chars", "spans", "longest"])

        names, block, chars = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                block.append(text)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from search(names, block)
                    names, block, chars = [], [], 0
        if names and shards:
            yield from search(names, block)

    train = texts.where("not held").select("name", "norm")
    load = train.agg(F.sum(F.length("norm"))).first()[0] or 0
    train = train.repartition(max(workers(spark), -(-load // TASK_CHARS)))
    links = train.mapInArrow(run, "train_rep string, held_rep string, shared int, train_chars int, held_chars int, spans int, longest int")
    return members, written(links, "overlap-links")


def overlapping_pairs(records: DataFrame, ratio: float, least_chars: int) -> DataFrame:
    """(record_a, record_b), a < b in code point order: every pair of records across train and evaluation splits."""
    members, links = overlaps(records, ratio, least_chars)
    a = members.where("not held").select(F.col("rep").alias("train_rep"), F.col("name").alias("a"))
    b = members.where("held").select(F.col("rep").alias("held_rep"), F.col("name").alias("b"))
    both = links.select("train_rep", "held_rep").join(a, "train_rep").join(b, "held_rep")
    return both.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"))


def overlap_counts(records: DataFrame, ratio: float, least_chars: int) -> DataFrame:
    """(split, source, n_records, n_overlapping): of every evaluation split and source, and of train, the records long enough and those with a partner across."""
    members, links = overlaps(records, ratio, least_chars)
    hit = links.select(F.col("train_rep").alias("rep"), F.lit(False).alias("held")).unionByName(links.select(F.col("held_rep").alias("rep"), F.lit(True).alias("held"))).distinct().withColumn("hit", F.lit(1))
    return members.join(hit, ["rep", "held"], "left").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))
