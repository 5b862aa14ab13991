"""Archives taken apart with bounds, hashes of whole trees, and what two collections may not share."""

from __future__ import annotations

import hashlib
import os
import stat
import tarfile
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsafeArchive(ValueError):
    """A member that leaves the folder, is no plain file, or is over a bound."""


def _members(path: str):
    """(name, size, plain file or folder, opener) of every member of a TAR or ZIP file."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            for i in z.infolist():
                kind = i.external_attr >> 16
                yield i.filename, i.file_size, i.is_dir(), not stat.S_ISLNK(kind), lambda i=i: z.open(i)
    else:
        with tarfile.open(path) as t:
            for m in t:
                yield m.name, m.size, m.isdir(), m.isdir() or m.isfile(), lambda m=m: t.extractfile(m)


def unpack(path: str, folder: str, most_members: int = 100_000, most_bytes: int = 16 << 30) -> list[str]:
    """The names of the files written below ``folder``, which must not exist yet.

    Absolute names, names that climb out, links, devices, a file given twice and archives over a bound raise `UnsafeArchive`; nothing is left behind then. Sizes are
    counted as they are read, not as the archive states them.
    """
    if os.path.exists(folder):
        raise FileExistsError(folder)
    work, made, total = folder + ".part", [], 0
    try:
        os.makedirs(work)
        for n, (name, size, is_folder, plain, opened) in enumerate(_members(path), 1):
            parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
            if name.startswith(("/", "\\")) or ".." in parts or ":" in name.split("/")[0] or not plain or n > most_members or total + size > most_bytes:
                raise UnsafeArchive(name)
            if is_folder or not parts:
                continue
            target = os.path.join(work, *parts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if os.path.exists(target):
                raise UnsafeArchive(f"{name}: twice")
            with opened() as source, open(target, "wb") as out:
                while block := source.read(1 << 20):
                    total += len(block)
                    if total > most_bytes:
                        raise UnsafeArchive(name)
                    out.write(block)
            made.append("/".join(parts))
        os.rename(work, folder)
    except BaseException:
        import shutil

        shutil.rmtree(work, ignore_errors=True)
        raise
    return sorted(made)


def tree_hash(files: DataFrame) -> str:
    """One hash over (path, content) of ``files``, rows of the binaryFile source, whatever their order: the sum of the files' hashes, taken where they are read."""
    row = F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(b"\0"), F.unhex(F.sha2("content", 256))), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    one = files.select(row.alias("h")).agg(F.concat_ws(",", F.count("*").cast("string"), *parts).alias("s")).first()["s"]
    return hashlib.sha256(one.encode()).hexdigest()


def shared_values(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) of every value that stands in both collections; nulls and blanks do not count. Empty where they are disjoint in all ``fields``."""

    def values(df):
        x = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
        return df.select(x.alias("x")).select("x.*").where("trim(value) <> ''").distinct()

    return values(a).join(values(b), ["field", "value"], "left_semi")


def selection_totals(selection: DataFrame, declared: dict[str, int], targets: dict[str, int]) -> dict[str, bool]:
    """Of each number declared for a selection whether it is what its rows give (``rows`` for their number, else the sum of the column), and of each target whether it is met."""
    names = sorted(set(declared) | set(targets))
    row = selection.agg(*[(F.count("*") if n == "rows" else F.coalesce(F.sum(n), F.lit(0))).alias(n) for n in names]).first()
    return {f"declared:{n}": row[n] == k for n, k in declared.items()} | {f"target:{n}": row[n] >= k for n, k in targets.items()}


def observation_lines(df: DataFrame) -> DataFrame:
    """``df`` (page_id, width, height, rtl, observations of text and a box x, y, w, h in shares of the page from its lower left corner) as lines in pixels, in reading order.

    Observations belong to one row if their centres lie within 0.35 of the median height, 2 pixels at least, of the row's centre; in a row they go from the right where ``rtl``.
    Null boxes are passed over; null observations give none.
    """
    kind = T.ArrayType(T.StructType.fromDDL("line_no int, row_no int, text string, polygon array<array<double>>"))

    def page(width, height, rtl, seen):
        boxes = [(o["text"], o["x"] * width, (1 - o["y"] - o["h"]) * height, o["w"] * width, o["h"] * height) for o in (seen if seen is not None else []) if all(o[k] is not None for k in "xywh")]
        if not boxes:
            return []
        heights = sorted(b[4] for b in boxes)
        near = max(2.0, 0.35 * (heights[len(heights) // 2] + heights[~(len(heights) // 2)]) / 2)
        rows: list[list] = []
        for b in sorted(boxes, key=lambda b: (b[2] + b[4] / 2, b[1])):
            centre = b[2] + b[4] / 2
            last = rows[-1] if rows else []
            if last and abs(reduce(lambda s, x: s + x[2] + x[4] / 2, last, 0.0) / len(last) - centre) <= near:
                last.append(b)
            else:
                rows.append([b])
        out = []
        for k, r in enumerate(rows):
            for t, x, y, w, h in sorted(r, key=lambda b: -b[1] - b[3] if rtl else b[1]):
                out.append((len(out), k, t, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]))
        return out

    @F.pandas_udf(kind)
    def lines(width: pd.Series, height: pd.Series, rtl: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([page(*x) for x in zip(width, height, rtl, seen, strict=True)])

    return df.select("page_id", F.explode(lines(F.col("width").cast("double"), F.col("height").cast("double"), F.coalesce("rtl", F.lit(False)), "observations")).alias("l")).select("page_id", "l.*")
