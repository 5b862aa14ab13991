"""Problem 1: near-duplicate records, by set-relation skipping.

A text is the set of its (word, occurrence number) pairs, so common words count with repeats. Equal sets
form classes and only one set of a class is joined. Tokens are ordered by how many sets hold them; each
set posts its prefix to the tokens' index lists. An index list is cut into blocks by position: two blocks
whose positions leave too few tokens for the threshold are skipped whole, and inside a block pair the same
bound, the sizes and a 256-bit parity map of the tokens (its Hamming distance never exceeds the number of
tokens two sets do not share) decide before any tokens are compared. Overlaps are then derived
incrementally: for one set, the overlap with a set that is highly similar to one already compared follows
from the earlier answer and the few tokens in which the two differ.

All bounds are exact, so no pair at or above the threshold is lost. A token that many sets hold has its list
split into cells of bounded size; cells, not lists, are the unit of work.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import workers, written
from .words import words

CELL = 4096
TILE = 512
PARTNERS = 512
KNOWN_TOKENS = 1_000_000
KNOWN_WORDS = 500_000
_LONG, _INT = T.LongType(), T.IntegerType()
POSTING = T.StructType([T.StructField(n, t) for n, t in (("tok", _LONG), ("lo", _INT), ("hi", _INT), ("id", _LONG), ("side", _INT), ("size", _INT), ("pos", _INT), ("b0", _LONG), ("b1", _LONG), ("b2", _LONG), ("b3", _LONG))])


def _tokenised(df: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    def run(batches):
        import xxhash

        codes: dict[str, int] = {}
        for batch in batches:
            if len(codes) > KNOWN_WORDS:
                codes.clear()
            ids, sigs, sizes, toks, maps = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(t)
                if len(w) < least_words:
                    continue
                seen: dict[str, int] = {}
                tokens = []
                for x in w:
                    n = seen.get(x, 0)
                    seen[x] = n + 1
                    name = f"{x} {n}" if n else x
                    if (code := codes.get(name)) is None:
                        code = codes[name] = xxhash.xxh64_intdigest(name)
                    tokens.append(code)
                h = np.array(tokens, np.uint64)
                h.sort()
                m = np.zeros(4, np.uint64)
                np.bitwise_xor.at(m, ((h >> np.uint64(6)) & np.uint64(3)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
                ids.append(i)
                sigs.append(xxhash.xxh128_hexdigest(h.tobytes()))
                sizes.append(len(w))
                toks.append(h.view(np.int64))
                maps.append(m.view(np.int64))
            if ids:
                m = np.stack(maps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sigs), pa.array(sizes, pa.int32()), pa.array(toks, pa.list_(pa.int64())), *[pa.array(m[:, k]) for k in range(4)]], names=["id", "sig", "size", "toks", "b0", "b1", "b2", "b3"]
                )

    src = df.select(F.col(key).cast("long"), text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return src.mapInArrow(run, "id long, sig string, size int, toks array<long>, b0 long, b1 long, b2 long, b3 long")


def _postings(reps: DataFrame, ratio: Fraction) -> DataFrame:
    """(tok, lo, hi, id, side, size, pos, b0..b3): each set's prefix, rarest tokens first, in the cells of the tokens' lists.

    Only how often tokens are held that at least ``total / KNOWN_TOKENS`` sets hold is sent around: these are at most ``KNOWN_TOKENS``,
    whatever the data; rarer tokens come first in hash order. Where that leaves tokens above a cell's size unknown, because there are very many tokens, their
    counts are joined to the postings, so that every list is cut.
    """
    spark = reps.sparkSession
    counts = reps.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    total = reps.agg(F.sum("size").alias("n")).first()["n"] or 0
    cut = max(2, -(-total // KNOWN_TOKENS))
    known = counts.where(F.col("n") >= cut).toArrow()
    tok = known.column("tok").to_numpy()
    order = np.argsort(tok)
    shared = spark.sparkContext.broadcast((tok[order], known.column("n").to_numpy()[order].astype(np.int32)))
    a, b = ratio.numerator, ratio.denominator

    def run(batches):
        keys, held = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = []
            ids, sizes = batch.column("id").to_numpy(), batch.column("size").to_numpy()
            maps = [batch.column(f"b{k}").to_numpy() for k in range(4)]
            lists = batch.column("toks")
            flat, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            n = np.where(keys[at] == flat, held[at], 0) if len(keys) else np.zeros(len(flat), np.int32)
            row = np.repeat(np.arange(len(ids)), np.diff(cuts))
            order = np.lexsort((flat, n, row))
            pos = np.arange(len(flat)) - cuts[row]
            flat, n = flat[order], n[order]
            keep = pos <= sizes[row] - -(-sizes[row].astype(np.int64) * a // b)
            flat, n, row, pos = flat[keep], n[keep], row[keep], pos[keep]
            blocks = np.maximum(1, -(-n // CELL))
            side = (ids[row] * np.int64(0x9E3779B1) >> 12) % blocks
            rep = np.repeat(np.arange(len(flat)), blocks)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            r, s = row[rep], side[rep]
            cols = [flat[rep], np.minimum(s, other).astype(np.int32), np.maximum(s, other).astype(np.int32), ids[r], s.astype(np.int32), sizes[r], pos[rep].astype(np.int32), *[m[r] for m in maps]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=POSTING.names)

    posts = reps.select("id", "size", "toks", "b0", "b1", "b2", "b3").mapInArrow(run, POSTING)
    if cut <= CELL + 1:
        return posts
    long = counts.where((F.col("n") > CELL) & (F.col("n") < cut)).select("tok", F.ceil(F.col("n") / CELL).cast("int").alias("_blocks"))
    posts = posts.join(long, "tok", "left").withColumn("_side", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    posts = posts.withColumn("_other", other)
    cell = {"lo": F.least("_side", "_other"), "hi": F.greatest("_side", "_other"), "side": F.col("_side")}
    return posts.withColumns({c: F.when(F.col("_blocks").isNull(), F.col(c)).otherwise(x) for c, x in cell.items()}).select(*POSTING.names)


def _groups(batches, keys: int):
    """Runs of rows with equal leading columns out of sorted Arrow batches, as numpy columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], cols[:keys], strict=True))
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts:
            if cut > start:
                held.append([c[start:cut] for c in cols])
            if held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, start = [], cut
        held.append([c[start:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _cell_pairs(ids, side, size, pos, maps, num: int, den: int, lo: int, hi: int):
    """Candidate pairs of one cell of one index list."""
    order = np.lexsort((size, pos))
    ids, side, size, pos, maps = ids[order], side[order], size[order].astype(np.int64), pos[order].astype(np.int64), maps[order]
    # min(rest, rest) * den >= num * (size + size), with each side's share on one side of the comparison.
    own = num * size
    left = (size - pos) * den - own
    kind = np.int32 if len(ids) and int(size.max()) * (num + den) < 1 << 31 else np.int64
    own, left = own.astype(kind), left.astype(kind)
    for a in range(0, len(ids), TILE):
        oa, la = own[a : a + TILE], left[a : a + TILE]
        for b in range(0, a + 1, TILE):
            ob, lb = own[b : b + TILE], left[b : b + TILE]
            # Blocks by position: no pair can reach the threshold if even the best rests cannot.
            if la.max() < ob.min() or lb.max() < oa.min():
                continue
            ok = (la[:, None] >= ob) & (lb >= oa[:, None])
            if a == b:
                ok &= np.tri(len(oa), k=-1, dtype=bool)
            i, j = np.nonzero(ok)
            i += a
            j += b
            if lo != hi:
                keep = side[i] != side[j]
                i, j = i[keep], j[keep]
            # A part of the maps' distance is a bound as well, so most pairs are done after two of the four words.
            total = size[i] + size[j]
            most = total - 2 * ((num * total + den - 1) // den)
            h = np.zeros(len(i), np.int64)
            for k in range(maps.shape[1]):
                h += np.bitwise_count(maps[i, k] ^ maps[j, k])
                if k % 2:
                    keep = h <= most
                    i, j, h, most = i[keep], j[keep], h[keep], most[keep]
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            if len(i):
                yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    def run(batches):
        for g in _groups(batches, 3):
            if len(g[0]) < 2:
                continue
            maps = np.stack([c.view(np.uint64) for c in g[7:11]], 1)
            xs, ys = [], []
            for x, y in _cell_pairs(g[3], g[4], g[5], g[6], maps, num, den, int(g[1][0]), int(g[2][0])):
                xs.append(x)
                ys.append(y)
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["x", "y"])

    return postings.mapInArrow(run, "x long, y long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Exact overlaps; a set with many partners is met in blocks of them."""
    degree = pairs.groupBy("x").agg(F.count("*").alias("deg"))
    cells = pairs.join(degree, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.ceil(F.col("deg") / PARTNERS))).select("x", "y", "part")
    left = cells.select(F.col("x").alias("lx"), F.col("part").alias("lpart")).distinct().join(sets.select(F.col("id").alias("lx"), F.col("toks").alias("xt")), "lx")
    right = cells.join(sets.select(F.col("id").alias("y"), F.col("toks").alias("yt")), "y")
    a, b = threshold.numerator, threshold.denominator

    def run(key, lefts, rights):
        x = lefts.column("lx")[0].as_py()
        xt = set(lefts.column("xt")[0].as_py())
        out = []
        leader: set | None = None
        base = 0
        for y, yt in zip(rights.column("y").to_pylist(), rights.column("yt").to_pylist(), strict=True):
            ys = set(yt)
            if leader is not None and len(differ := ys ^ leader) * 2 < len(ys):
                common = base + sum(1 if t in ys else -1 for t in differ if t in xt)
            else:
                common = len(xt & ys)
                leader, base = ys, common
            union = len(xt) + len(ys) - common
            if common * b >= a * union:
                out.append((x, y, common, union))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"x": pa.array(cols[0], pa.int64()), "y": pa.array(cols[1], pa.int64()), "common": pa.array(cols[2], pa.int32()), "all_words": pa.array(cols[3], pa.int32())})

    return left.groupBy("lx", "lpart").cogroup(right.groupBy("x", "part")).applyInArrow(run, "x long, y long, common int, all_words int")


def near_duplicate_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every record, and the linked pairs of class representatives.

    members: id, rep (the smallest key of the records with equal words). links: x, y, common,
    all_words, x < y. ``key`` must be unique. Rows with a null key or text, or fewer than ``least_words`` words (so
    also empty texts), are in neither. Other columns are not read. Equal texts get one class; ties
    cannot arise because classes are exact.
    """
    spark = df.sparkSession
    ratio = Fraction(str(threshold))
    # common >= t * union is the same as common >= t / (1 + t) * (size + size)
    share = ratio / (1 + ratio)
    num, den = share.numerator, share.denominator
    sets = written(_tokenised(df, key, text, max(1, least_words)), "sets")
    members = written(sets.select("id", "sig").join(sets.groupBy("sig").agg(F.min("id").alias("rep")), "sig").select("id", "rep"), "members")
    reps = written(sets.join(members.where("id = rep").select("id"), "id", "left_semi"), "reps")
    posts = _postings(reps, ratio)
    cells = posts.repartition(workers(spark) * 4, "tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi")
    links = _verify(written(_candidates(cells, num, den), "candidates"), reps.select("id", "toks"), ratio)
    return members, written(links, "links")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float, least_words: int) -> DataFrame:
    """All pairs of different records at or above the threshold: (a, b), a < b, copies included."""
    members, links = near_duplicate_classes(df, key, text, threshold, least_words)
    a, b = members.select(F.col("id").alias("a"), F.col("rep").alias("x")), members.select(F.col("id").alias("b"), F.col("rep").alias("y"))
    across = links.select("x", "y").join(a, "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    within = a.join(b.withColumnRenamed("y", "x"), "x").where("a < b").select("a", "b")
    return across.unionByName(within)


def linked_members(df: DataFrame, key: str, text: str, threshold: float, least_words: int) -> DataFrame:
    """One row per record: id, class (rep), copies in the class, number of linked classes."""
    members, links = near_duplicate_classes(df, key, text, threshold, least_words)
    degree = links.select(F.explode(F.array("x", "y")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    return members.join(sizes, "rep").join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
