"""Result bundles: metric tables as files, flattened scalars, and a manifest with the hash of each file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import files as put


def flattened(metrics: dict, prefix: str = "") -> dict[str, object]:
    """Nested metrics as dotted names; lists are left out."""
    out: dict[str, object] = {}
    for k, v in metrics.items():
        if isinstance(v, dict):
            out |= flattened(v, f"{prefix}{k}.")
        elif not isinstance(v, (list, tuple)):
            out[prefix + k] = v
    return out


def long_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): every other numeric column as a row of its own."""
    cols = [c for c, t in df.dtypes if c not in keys and t.split("(")[0] in ("int", "bigint", "double", "float", "decimal")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def html_table(title: str, metrics: dict) -> str:
    """The scalars of a report as one page."""
    from html import escape

    rows = "".join(f"<tr><td>{escape(str(k))}</td><td>{escape(shown(k, v))}</td></tr>" for k, v in sorted(flattened(metrics).items()))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{rows}</table></body></html>'


def shown(name: str, value) -> str:
    """A number as reports show it: rates as percentages, other fractions with four places, counts with thousands marked, a missing one as a dash."""
    if value is None:
        return "–"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if name.endswith(("rate", "cer", "wer", "f1", "precision", "recall", "accuracy")):
        return f"{100 * value:.2f}%"
    return f"{value:,}" if isinstance(value, int) else f"{value:.4f}"


def write_bundle(folder: str, metrics: dict, per_page: DataFrame, errors: DataFrame, title: str = "Report") -> dict:
    """metrics.json, summary.csv, report.html, per_page and errors as JSON lines below ``folder``, and run_manifest.json with hash and size of each file."""
    per_page.write.mode("overwrite").json(f"{folder}/per_page")
    errors.write.mode("overwrite").json(f"{folder}/errors")
    put.write_text(f"{folder}/metrics.json", json.dumps(metrics, ensure_ascii=False, sort_keys=True, indent=2))
    put.write_text(f"{folder}/summary.csv", "metric,value\n" + "".join(f"{k},{v}\n" for k, v in sorted(flattened(metrics).items())))
    put.write_text(f"{folder}/report.html", html_table(title, metrics))
    files = put.hashes(folder, ("run_manifest.json",))
    put.write_text(f"{folder}/run_manifest.json", json.dumps({"files": files}, sort_keys=True, indent=2))
    return files


def compared(folders: list[str]) -> list[dict]:
    """The runs of several bundles, ranked by line and page error; runs that are not conformant come last without a rank. Ties go by name."""
    rows = []
    for f in folders:
        m = json.loads(put.read_text(f"{f}/metrics.json"))
        r = m.get("recognition", {})
        rows.append({"run": f.rstrip("/").rpartition("/")[2], "status": m.get("conformance", {}).get("status"), "line_gcer": r.get("line_gcer"), "page_order_gcer": r.get("page_order_gcer")})
    last = float("inf")
    rows.sort(key=lambda r: (r["status"] != "conformant", *(last if r[k] is None else r[k] for k in ("line_gcer", "page_order_gcer")), r["run"]))
    return [{"rank": i if r["status"] == "conformant" else None, **r} for i, r in enumerate(rows, 1)]


def write_comparison(folder: str, rows: list[dict]) -> None:
    """comparison.json, comparison.csv and comparison.html of compared runs."""
    from html import escape

    names = ["rank", "run", "status", "line_gcer", "page_order_gcer"]
    put.write_text(f"{folder}/comparison.json", json.dumps(rows, ensure_ascii=False, indent=2))
    put.write_text(f"{folder}/comparison.csv", ",".join(names) + "\n" + "".join(",".join("" if r[n] is None else str(r[n]) for n in names) + "\n" for r in rows))
    cells = "".join("<tr>" + "".join(f"<td>{escape(shown(n, r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    put.write_text(f"{folder}/comparison.html", f'<!doctype html><html><head><meta charset="utf-8"></head><body><table><tr>{"".join(f"<th>{n}</th>" for n in names)}</tr>{cells}</table></body></html>')
