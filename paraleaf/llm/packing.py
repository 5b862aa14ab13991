"""Problem 6: texts into windows of fixed capacity, by vector best-fit.

Every item has three sizes: tokens, one document, and attention cost (the square of its tokens). A bin has a capacity for
each. Items go in from the largest down; of the bins that can hold an item under every constraint the one with the least weighted
residual norm after placing takes it (``rule="norm"``), or the one whose residual has the largest weighted dot product with
the item (``rule="dot"``). Only texts larger than a window are cut, into full windows and one rest.

Packing is done in groups of about ``GROUP`` texts by hash of the key, each in one task of bounded size; a group leaves at most
its last few bins unfilled, so the loss does not grow with the data. Window numbers are group number times 2**32 plus
the number in the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
TOKENIZERS = "/opt/tokenizers"
GROUP = 8000
MAX_WINDOWS = 1000
WEIGHTS = (1.0, 0.05, 0.05)


def _encoder(folder: str, name: str):
    import base64
    import importlib.util
    import os

    import tiktoken

    found = importlib.util.spec_from_file_location("_tokenizer_pattern", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, folder: str = TOKENIZERS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null or empty text has 0. Rows with a null key are left out."""

    def run(batches):
        enc = _encoder(folder, tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).where("doc_id is not null").mapInArrow(run, "doc_id long, n_tokens int")


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, attention: float, rule: str = "norm") -> np.ndarray:
    """The bin of each item (tokens per item, all at most ``capacity``); items in any order.

    ``attention`` is the capacity in squared tokens, 0 for none of its own; an item above it is a bin by itself.
    """
    cap = np.array([capacity, max_docs, attention if attention > 0 else float(capacity) ** 2])
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    wt = np.array(WEIGHTS)
    left = np.zeros((3, 1024))  # shares of each capacity left in the open bins
    number = np.zeros(1024, np.int64)
    n_open = made = 0
    smallest = float(sizes.min()) / capacity if len(sizes) else 0.0
    cheapest = float(sizes.min()) ** 2 / cap[2] if len(sizes) else 0.0
    for i in order:
        s = float(sizes[i])
        d = np.array([s / cap[0], 1 / cap[1], s * s / cap[2]])
        rest = left[:, :n_open] - d[:, None]
        fits = (rest >= -1e-12).all(0)
        if fits.any():
            value = (wt[:, None] * rest * rest).sum(0) if rule == "norm" else -(wt[:, None] * left[:, :n_open] * d[:, None]).sum(0)
            k = int(np.where(fits, value, np.inf).argmin())
        else:
            if n_open == left.shape[1]:
                left, number = np.hstack([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)])
            k = n_open
            left[:, k], number[k] = 1.0, made
            n_open += 1
            made += 1
        bins[i] = number[k]
        left[:, k] -= d
        if left[0, k] < smallest - 1e-12 or left[1, k] < 1 / cap[1] - 1e-12 or left[2, k] < cheapest - 1e-12:  # full: no longer looked at
            n_open -= 1
            left[:, k], number[k] = left[:, n_open], number[n_open]
    return bins


def fill_windows(counts: DataFrame, windows: DataFrame, max_docs_share: int = 8, attention: float = 1.0, rule: str = "norm") -> DataFrame:
    """(window_id, doc_id, piece_no, first_token, n_tokens, window_no) for every window size and text.

    ``counts`` is (doc_id, n_tokens), ``windows`` (window_id, capacity_tokens), a small fixed table. A bin holds at most capacity /
    ``max_docs_share`` texts and ``attention`` times capacity squared of attention cost (0: no such limit), but always one text that fits.
    More than ``MAX_WINDOWS`` window sizes are an error. Texts without tokens take no room:
    one row with a null window number. Windows with a null or non-positive capacity give nothing. Equal sizes are
    placed in key order.
    """
    sizes = [(r[0], int(r[1])) for r in windows.select("window_id", "capacity_tokens").where("window_id is not null and capacity_tokens > 0").dropDuplicates(["window_id"]).orderBy("window_id").limit(MAX_WINDOWS + 1).collect()]
    if len(sizes) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} window sizes")
    n = counts.count()
    groups = max(1, -(-n // GROUP))
    schema = "window_id long, doc_id long, piece_no int, first_token int, n_tokens int, window_no long"
    grouped = counts.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).withColumn("window", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("id"), F.lit(b).alias("cap")) for a, b in sizes])) if sizes else F.lit(None).cast("struct<id:long,cap:int>"))
    grouped = grouped.where("window is not null").select("grp", F.col("window.id").alias("window_id"), F.col("window.cap").alias("cap"), "doc_id", "n_tokens")

    def pack(key, table):
        cap, group, window = int(key[2].as_py()), int(key[0].as_py()), int(key[1].as_py())
        ids, tok = table.column("doc_id").to_numpy(), table.column("n_tokens").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, tok = ids[order], tok[order]
        full, rest = tok // cap, tok % cap
        has = rest > 0
        bins = np.full(len(ids), -1, np.int64)
        bins[has] = best_fit(rest[has], cap, max(1, cap // max_docs_share), attention * cap * cap, rule)
        made = int(bins.max(initial=-1)) + 1
        pieces = full + np.where(has, 1, 0)
        row = np.repeat(np.arange(len(ids)), np.maximum(pieces, 1))
        piece = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(pieces, 1)) - np.maximum(pieces, 1), np.maximum(pieces, 1))
        whole = piece < full[row]
        number = np.where(whole, made + np.cumsum(whole) - 1, bins[row])
        none = tok[row] == 0
        cols = [np.full(len(row), window), ids[row], piece.astype(np.int32), (piece * cap).astype(np.int32), np.where(whole, cap, rest[row]).astype(np.int32)]
        no = pa.array(number + group * (1 << 32), mask=none)
        return pa.table([*map(pa.array, cols), no], names=["window_id", "doc_id", "piece_no", "first_token", "n_tokens", "window_no"])

    return grouped.groupBy("grp", "window_id", "cap").applyInArrow(pack, schema)


def window_report(filled: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity_tokens, n_windows, n_pieces, filled_share) per window size."""
    per = filled.where("window_no is not null").groupBy("window_id").agg(F.count_distinct("window_no").alias("n_windows"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("tokens"))
    return per.join(windows.select("window_id", "capacity_tokens").dropDuplicates(["window_id"]), "window_id").select("window_id", "capacity_tokens", "n_windows", "n_pieces", F.round(F.col("tokens") / (F.col("n_windows") * F.col("capacity_tokens")), 6).alias("filled_share"))
