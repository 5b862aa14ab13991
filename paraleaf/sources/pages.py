"""Page sources: JSON lines, PAGE and ALTO XML, recogniser tables, block HTML, image/text shards and TAR shards.

Files are read with Spark's own readers (``json``, ``binaryFile``, ``parquet``, ``csv``); only the parsing of one
file's content is Python, inside Arrow batches, one page at a time.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import unicodedata
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE = "struct<line_id:string,polygon:array<array<double>>,baseline:array<array<double>>,text:string,base_direction:string,language:string,reading_index:int>"
REGION = f"struct<region_id:string,type:string,polygon:array<array<double>>,base_direction:string,reading_index:int,language:string,lines:array<{LINE}>>"
PAGE = f"page_id string, width int, height int, regions array<{REGION}>, problem string"


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): blank lines are passed over, a line that is no object of the schema goes to the second table."""
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    names = re.findall(r"(?:^|,)\s*(\w+)\s", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema)))
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.where("r is null or r._bad is not null").select("file", "value")
    return parsed.where("r is not null and r._bad is null").select(*[F.col(f"r.{n}").alias(n) for n in names]), bad


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of every key that stands more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def parse_points(text: str | None) -> list[list[float]]:
    """'x,y x,y' or 'x y x y'; mixing the two or an odd count is an error."""
    parts = (text or "").split()
    if not parts:
        return []
    if all("," in p for p in parts):
        pairs = [p.split(",") for p in parts]
        if any(len(p) != 2 for p in pairs):
            raise ValueError("a point needs two numbers")
        return [[float(a), float(b)] for a, b in pairs]
    if any("," in p for p in parts) or len(parts) % 2:
        raise ValueError("mixed or odd coordinates")
    nums = [float(p) for p in parts]
    return [[a, b] for a, b in zip(nums[::2], nums[1::2], strict=True)]


def point_column(c: Column) -> Column:
    """The points of 'x,y x,y' as an array, in builtin functions; anything else is null."""
    ok = c.rlike(r"^\s*-?[0-9.]+,-?[0-9.]+(\s+-?[0-9.]+,-?[0-9.]+)*\s*$")
    return F.when(ok, F.transform(F.split(F.trim(c), r"\s+"), lambda p: F.transform(F.split(p, ","), lambda x: x.cast("double"))))


def _nfc(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def _root(data: bytes) -> ET.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are not read")
    root = ET.fromstring(data)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def _direction(v: str | None) -> str | None:
    return {"right-to-left": "rtl", "left-to-right": "ltr", "rtl": "rtl", "ltr": "ltr"}.get(v or "")


def pagexml(data: bytes) -> dict:
    """A PAGE file as a page: line text from TextEquiv, else its words; order from RegionRefIndexed; language and direction inherited."""
    page = _root(data).find("Page")
    order = {e.get("regionRef"): int(e.get("index", 0)) for e in page.iter("RegionRefIndexed")}

    def text(e):
        u = e.find("TextEquiv/Unicode")
        return _nfc(u.text or "") if u is not None else _nfc(" ".join(text(w) for w in e.findall("Word")))

    def coords(e, tag):
        c = e.find(tag)
        if c is None:
            return []
        return parse_points(c.get("points")) if c.get("points") else [[float(p.get("x")), float(p.get("y"))] for p in c.findall("Point")]

    regions = []
    for i, r in enumerate(page.iter("TextRegion")):
        rd, rl = _direction(r.get("readingDirection") or page.get("readingDirection")), r.get("primaryLanguage") or page.get("primaryLanguage")
        lines = [{"line_id": x.get("id"), "polygon": coords(x, "Coords"), "baseline": coords(x, "Baseline"), "text": text(x), "base_direction": _direction(x.get("readingDirection")) or rd, "language": x.get("primaryLanguage") or rl, "reading_index": k} for k, x in enumerate(r.findall("TextLine"))]
        regions.append({"region_id": r.get("id"), "type": r.get("type"), "polygon": coords(r, "Coords"), "base_direction": rd, "reading_index": order.get(r.get("id"), i if not order else None), "language": rl, "lines": lines})
    return {"page_id": page.get("imageFilename"), "width": int(page.get("imageWidth")), "height": int(page.get("imageHeight")), "regions": regions}


def alto(data: bytes) -> dict:
    """An ALTO file as a page: strings, blanks and hyphens joined; shape polygon, else the rectangle."""
    root = _root(data)
    page = root.find(".//Page")

    def box(e):
        p = e.find("Shape/Polygon")
        if p is not None and p.get("POINTS"):
            return parse_points(p.get("POINTS"))
        if e.get("HPOS") is None or e.get("VPOS") is None:
            return []
        x, y, w, h = (float(e.get(k, 0)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
        return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]

    def baseline(e, b):
        v = e.get("BASELINE")
        if not v:
            return []
        if re.fullmatch(r"\s*-?[0-9.]+\s*", v):
            return [[b[0][0], float(v)], [b[2][0], float(v)]] if len(b) >= 4 else []
        return parse_points(v)

    def text(e):
        out = []
        for x in e:
            if x.tag == "String":
                out.append(x.get("CONTENT") if x.get("CONTENT") is not None else "".join(g.get("CONTENT", "") for g in x.findall("Glyph")))
            elif x.tag == "SP":
                out.append(" ")
            elif x.tag == "HYP":
                out.append(x.get("CONTENT") or "-")
        return _nfc("".join(out))

    regions = []
    for i, b in enumerate(root.iter("TextBlock")):
        lines = [{"line_id": x.get("ID"), "polygon": (p := box(x)), "baseline": baseline(x, p), "text": text(x), "base_direction": None, "language": x.get("LANG") or b.get("LANG"), "reading_index": k} for k, x in enumerate(b.findall("TextLine"))]
        regions.append({"region_id": b.get("ID"), "type": b.get("TYPE") or "paragraph", "polygon": box(b), "base_direction": None, "reading_index": i, "language": b.get("LANG"), "lines": lines})
    name = root.findtext(".//sourceImageInformation/fileName")
    return {"page_id": name, "width": int(float(page.get("WIDTH"))), "height": int(float(page.get("HEIGHT"))), "regions": regions}


def xml_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pages of all PAGE (kind "page") or ALTO (kind "alto") files below ``path``; a file that cannot be read gives one row with its problem."""
    parse = {"page": pagexml, "alto": alto}[kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    page = parse(data)
                    page["page_id"] = page["page_id"] or p.rsplit("/", 1)[-1]
                    out.append(json.dumps(page | {"problem": None}, ensure_ascii=False))
                except Exception as e:
                    out.append(json.dumps({"page_id": p.rsplit("/", 1)[-1], "regions": [], "problem": f"{type(e).__name__}: {e}"[:200]}))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["j"])

    return files.mapInArrow(run, "j string").select(F.from_json("j", PAGE).alias("p")).select("p.*")


def paired_parity(page: DataFrame, alto_pages: DataFrame) -> DataFrame:
    """(page_id, line_id, problem): lines of a page in one format without a twin in the other, or with other text but for blanks."""

    def flat(d, n):
        d = d.select("page_id", F.explode("regions").alias("r")).select("page_id", F.explode("r.lines").alias("l"))
        return d.select("page_id", "l.line_id", F.regexp_replace("l.text", r"\s+", "").alias(n), F.lit(1).alias(n + "_in"))

    j = flat(page, "a").join(flat(alto_pages, "b"), ["page_id", "line_id"], "full")
    problem = F.when(F.col("b_in").isNull(), "missing_in_alto").when(F.col("a_in").isNull(), "missing_in_page").when(~F.col("a").eqNullSafe(F.col("b")), "text_differs")
    return j.withColumn("problem", problem).where("problem is not null").select("page_id", "line_id", "problem")


TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def recogniser_tsv(df: DataFrame, of: list[str] | None = None) -> DataFrame:
    """Lines of a recogniser's word table (columns of ``TSV``, and those of ``of`` that tell files apart): words joined in order, mean confidence, outer box."""
    keys = [*(of or []), "page_num", "block_num", "par_num", "line_num"]
    w = df.where("level = 5 and text is not null and trim(text) <> ''").withColumn("w", F.struct("left", "top", "text")).withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.coalesce("word_num", "left"), "left")))
    g = w.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("text"), F.round(F.avg("conf"), 6).alias("conf"), F.min("left").alias("x1"), F.min("top").alias("y1"), F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"))
    return g


class _Blocks(HTMLParser):
    """Labelled blocks with a 0-1000 box, text, and tables with spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.now: dict | None = None
        self.cell: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div" and "data-label" in a:
            nums = re.findall(r"-?[0-9.]+", a.get("data-bbox", ""))
            box = [min(1000.0, max(0.0, float(x))) for x in nums] if len(nums) == 4 else None
            self.now = {"label": a["data-label"], "box": box, "text": "", "rows": []}
            self.blocks.append(self.now)
        if self.now is None:
            return
        if tag == "br":
            self.now["text"] += "\n"
        elif tag == "tr":
            self.now["rows"].append([])
        elif tag in ("td", "th"):
            if not self.now["rows"]:
                self.now["rows"].append([])
            span = lambda k: min(1000, max(1, int(a[k]))) if str(a.get(k) or "").isdigit() else 1
            self.cell = {"text": "", "rows": span("rowspan"), "cols": span("colspan")}
            self.now["rows"][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data
        elif self.now is not None:
            self.now["text"] += data


def placed_cells(rows: list[list[dict]], most: int = 1000) -> list[tuple[int, int, int, int, str]]:
    """(row_start, row_end, col_start, col_end, text) of table cells, each at the first free slot of its row."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows[:most]):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            if c >= most or len(out) >= 10 * most:
                raise ValueError("table too large")
            r2, c2 = min(r + cell["rows"], len(rows)), min(c + cell["cols"], most)
            taken.update((i, j) for i in range(r, r2) for j in range(c, c2))
            out.append((r, r2, c, c2, _nfc(" ".join(cell["text"].split()))))
            c = c2
    return out


def html_blocks(text: str) -> list[dict]:
    """The blocks of one page; text without any block is one plain block."""
    p = _Blocks()
    p.feed(text or "")
    blocks = p.blocks or [{"label": "text", "box": None, "text": re.sub(r"<[^>]*>", "", text or ""), "rows": []}]
    return [{"label": b["label"], "box": b["box"], "text": _nfc(b["text"].strip()), "cells": placed_cells(b["rows"])} for b in blocks]


def image_text(df: DataFrame) -> DataFrame:
    """Image/text shards: a document key (source_doc, else writer, else item), the image's hash and whether it is the one declared."""
    sha = F.sha2(F.col("image.bytes"), 256)
    return df.withColumn("document_key", F.coalesce("source_doc", "writer", "sample_id")).withColumn("actual_sha256", sha).withColumn("hash_ok", F.coalesce(F.lower("image_sha256") == sha, F.lit(False)) | F.col("image_sha256").isNull())


def tar_samples(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """(shard, key, text, image_bytes, problem) of TAR shards that pair <key>.json with an image; links, outside paths and members too large are problems.

    Shards are read as streams where the tasks run: a sample is given out when its pair is complete, so only members still waiting for theirs are
    held, whatever the size of the shard. A JSON text that its ``text_sha256`` does not fit is a problem as well.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path")  # names only; contents are not read here
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())

    def samples(p: str):
        from pyarrow import fs

        where, inside = fs.FileSystem.from_uri(p)
        waiting: dict[str, dict] = {}
        with where.open_input_stream(inside) as raw, tarfile.open(fileobj=raw, mode="r|") as t:
            for m in t:
                key, _, suffix = m.name.partition(".") if not m.name.startswith(".") else (m.name, "", "")
                s = waiting.setdefault(key, {"problem": None})
                if not m.isfile() or m.name.startswith("/") or ".." in m.name.split("/") or m.size > most_bytes:
                    s["problem"] = "unsafe_member"
                elif suffix == "json":
                    try:
                        j = json.loads(t.extractfile(m).read())
                        s["text"] = j.get("text")
                        if j.get("text_sha256") not in (None, hashlib.sha256((s["text"] or "").encode()).hexdigest()):
                            s["problem"] = "text_hash"
                    except (ValueError, AttributeError):
                        s["problem"] = "bad_json"
                else:
                    s["image"] = t.extractfile(m).read()
                if "image" in s and ("text" in s or s["problem"]):
                    yield key, waiting.pop(key)
        yield from waiting.items()

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for k, s in samples(p):
                    row = (p.rsplit("/", 1)[-1], k, s.get("text"), s.get("image"), s["problem"] or (None if "text" in s and "image" in s else "unpaired"))
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=["shard", "key", "text", "image_bytes", "problem"])

    return files.mapInArrow(run, "shard string, key string, text string, image_bytes binary, problem string")


def installed_gold(df: DataFrame, forced: dict[str, Column]) -> DataFrame:
    """Pages built elsewhere: their metadata map kept, the provenance keys overwritten by the registry's."""
    over = F.map_from_arrays(F.array(*[F.lit(k) for k in forced]), F.array(*forced.values()))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*forced))
    return df.withColumn("metadata", F.map_concat(kept, over))
