"""Reading order as a graph over ids."""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def topological(nodes: list[str], edges: list[tuple[str, str]], keys: list | None = None) -> list[str]:
    """Kahn's order; of the nodes that are free the one with the least (key, place) comes next.

    An edge with an unknown node or a cycle raises ValueError.
    """
    place = {n: i for i, n in enumerate(nodes)}
    after: dict[str, set[str]] = {n: set() for n in nodes}
    waits = dict.fromkeys(nodes, 0)
    for a, b in edges:
        if a not in place or b not in place:
            raise ValueError("unknown node")
        if b not in after[a]:
            after[a].add(b)
            waits[b] += 1
    rank = lambda n: ((keys[place[n]] if keys else 0), place[n])
    ready = [(rank(n), n) for n in nodes if not waits[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, n = heapq.heappop(ready)
        out.append(n)
        for b in after[n]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, (rank(b), b))
    if len(out) < len(nodes):
        raise ValueError("cycle")
    return out


def order_or_given(nodes: list[str], edges: list[tuple[str, str]], keys: list) -> list[str]:
    """The order, or by key and place where the graph is no order."""
    try:
        return topological(nodes, edges, keys)
    except ValueError:
        return [n for _, _, n in sorted((k, i, n) for i, (n, k) in enumerate(zip(nodes, keys, strict=True)))]


def precedences(edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """All (a, b) with a path from a to b."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    out = set()
    for a in after:
        queue, seen = deque(after[a]), set()
        while queue:
            b = queue.popleft()
            if b not in seen:
                seen.add(b)
                queue.extend(after.get(b, ()))
        out |= {(a, b) for b in seen}
    return out


def order_metrics(gold: list[tuple[str, str]], pred: list[tuple[str, str]], linear: list[str]) -> tuple[float, float, float, int, int]:
    """(edge precision, recall, F1, precedences kept, precedences comparable)."""
    g, p = set(gold), set(pred)
    right = len(g & p)
    precision, recall = right / max(1, len(p)), right / max(1, len(g))
    at = {n: i for i, n in enumerate(linear)}
    pairs = [(a, b) for a, b in precedences(gold) if a != b and a in at and b in at]
    kept = sum(at[a] < at[b] for a, b in pairs)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0, kept, len(pairs)


@pandas_udf(T.ArrayType(T.StringType()))
def reading_order(nodes: pd.Series, edges: pd.Series, keys: pd.Series) -> pd.Series:
    """The order of a page's nodes; nulls count as empty, malformed edges are passed over."""

    def one(n, e, k):
        n = list(n) if n is not None else []
        pairs = [tuple(x) for x in (e if e is not None else []) if x is not None and len(x) == 2]
        return order_or_given(n, pairs, list(k) if k is not None else [0] * len(n))

    return pd.Series([one(n, e, k) for n, e, k in zip(nodes, edges, keys, strict=True)])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
def precedence_list(edges: pd.Series) -> pd.Series:
    """The precedences of a page's edges; null gives none, malformed edges are passed over."""
    return pd.Series([sorted(precedences([tuple(x) for x in (e if e is not None else []) if x is not None and len(x) == 2])) for e in edges])


@pandas_udf(T.BooleanType())
def has_cycle(edges: pd.Series) -> pd.Series:
    """Whether a page's graph has a cycle; null gives none, malformed edges are passed over."""

    def one(e):
        pairs = [tuple(x) for x in (e if e is not None else []) if x is not None and len(x) == 2]
        nodes = list(dict.fromkeys(n for p in pairs for n in p))
        try:
            topological(nodes, pairs)
        except ValueError:
            return True
        return False

    return pd.Series([one(e) for e in edges])
