"""Registries, profiles and locks: small driver-side configuration with an order-independent fingerprint."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
from dataclasses import dataclass, field


def canonical(value) -> str:
    """JSON with sorted keys and no blanks, so that equal values give equal text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def load_yaml(text: str) -> dict:
    import yaml

    value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("a registry is a mapping")
    return value


@dataclass(frozen=True)
class Limits:
    """Thresholds of matching and of the gate; shares must lie in [0, 1]."""

    line_iou: float = 0.30
    region_iou: float = 0.50
    exact: float = 0.95
    ltr: float = 0.98
    numeric: float = 0.99
    bracket: float = 0.99
    slices: tuple[str, ...] = field(default=("track", "vocalization", "document_type", "layout_type", "script_style", "source_type"))

    def __post_init__(self):
        for k in ("line_iou", "region_iou", "exact", "ltr", "numeric", "bracket"):
            v = getattr(self, k)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
                raise ValueError(f"{k} must be in [0, 1]")


def unpack_lock(parts: list[str], sha256: str) -> list[dict]:
    """A selection lock from its base64 parts: joined, unzipped, checked against its hash."""
    data = gzip.decompress(base64.b64decode("".join(parts)))
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the lock does not have the declared hash")
    return json.loads(data)


def tree_hash(files: dict[str, bytes]) -> str:
    """One hash of a folder: over its sorted paths, sizes and hashes."""
    lines = [f"{p}\0{len(b)}\0{hashlib.sha256(b).hexdigest()}" for p, b in sorted(files.items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
