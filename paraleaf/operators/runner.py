"""Running a predictor over pages: strict envelopes, a content-addressed cache, failures as visible empty predictions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "cache_key string, page_id string, payload string, status string, failure string, timing_ms double, retries int"


def envelopes(pages: DataFrame, settings: str) -> DataFrame:
    """(cache_key, page_id, path): all a predictor may see, and the hash of everything its answer depends on."""
    key = F.sha2(F.concat_ws("\n", F.lit(settings), "page_id", F.coalesce("image.path", F.lit("")), F.coalesce("image.sha256", F.lit(""))), 256)
    return pages.select(key.alias("cache_key"), "page_id", F.col("image.path").alias("path"))


def predict(pages: DataFrame, predictor: Callable[[dict], dict], settings: str, cache: DataFrame | None = None, retries: int = 1) -> DataFrame:
    """Predictions of all pages; those whose key is in ``cache`` are taken from there. A predictor that keeps failing leaves an empty page with its failure."""
    todo = envelopes(pages, settings)
    if cache is not None:
        known = todo.join(cache, ["cache_key", "page_id"]).select(*[c.split()[0] for c in RESULT.split(", ")])
        todo = todo.join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches):
        for batch in batches:
            out = []
            for key, page, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start, failure, payload, k = time.perf_counter(), None, None, 0
                for k in range(retries + 1):
                    try:
                        payload, failure = json.dumps(predictor({"page_id": page, "image": {"path": path}}), ensure_ascii=False, sort_keys=True), None
                        break
                    except Exception as e:
                        failure = f"{type(e).__name__}: {e}"[:200]
                if payload is None:
                    payload = json.dumps({"page_id": page, "regions": []})
                out.append((key, page, payload, "ok" if failure is None else "failed", failure, (time.perf_counter() - start) * 1000, k))
            if out:
                kinds = (*[pa.string()] * 5, pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    fresh = todo.select("cache_key", "page_id", "path").mapInArrow(run, RESULT)
    return fresh if cache is None else fresh.unionByName(known)
