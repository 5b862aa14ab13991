"""Deeply nested page records turned into flat tables that keep parent and child ids.

``structural_tables`` parses delivered JSON payloads. A bottom-up tree automaton gives every node a
state from its kind, its keys and its children's states (`delta`); the state of a page, region, line or
point set decides which typed subtype it is, and the rows of all subtypes share the supertype's keys
(raw_id, page_no, page_id, region_id, line_id and the number in the parent) and the link to the parent. ``write_structural_tables`` parses every
payload once and lays the rows out by level and subtype; ``subtype_table`` reads one subtype with only the columns its shape has.
``page_tables`` does the same for typed nested columns with Catalyst generators only.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, TEXT, NULL, FLAG = "number", "text", "null", "flag"
PAIR, XY, PAIRS, XYS, COORDS, NONE = "pair", "xy", "points:pairs", "points:xy", "points:text", "points:none"
LINE, LINES, REGION, REGIONS, PAGE, PAGES, ENVELOPE, ARRAY, OBJECT = "line", "lines", "region", "regions", "page", "pages", "envelope", "array", "object"

LEVELS = {
    "page": "raw_id long, page_no int, page_id string, subtype string, model_name string, schema_version string, timing_ms double",
    "region": "raw_id long, page_no int, page_id string, region_id string, parent_region_id string, depth int, region_type string, reading_index int, subtype string",
    "line": "raw_id long, page_no int, page_id string, region_id string, line_id string, text string, reading_index int, n_words int, subtype string",
    "point": "raw_id long, page_id string, region_id string, line_id string, point_no int, x double, y double, subtype string",
    "region_point": "raw_id long, page_id string, region_id string, point_no int, x double, y double, subtype string",
    "word": "raw_id long, page_id string, region_id string, line_id string, word_no int, text string, conf double, subtype string",
    "tag": "raw_id long, page_id string, region_id string, line_id string, tag_no int, tag string, subtype string",
    "field": "raw_id long, page_no int, page_id string, field_no int, field_id string, label_text string, value_text string, subtype string",
}
#: Columns that only shapes of this mark have.
MARKED = {"page": {"timing_ms": "timed", "model_name": "model"}, "region": {"parent_region_id": "inner", "reading_index": "indexed"}, "line": {"n_words": "words", "reading_index": "indexed"}, "word": {"conf": "scored"}, "field": {"label_text": "labelled"}}


def delta(kind: str, keys: frozenset[str] | None, children: dict | set) -> str:
    """The automaton's transition: the state of a node from its kind, keys and its children's states."""
    if kind == "array":
        if children and children <= {NUMBER}:
            return PAIR
        for inside, state in ((PAIR, PAIRS), (XY, XYS), (LINE, LINES), (REGION, REGIONS), (PAGE, PAGES)):
            if children == {inside}:
                return state
        return ARRAY
    if {"x", "y"} <= keys and "text" not in keys:
        return XY
    if "page_id" in keys:
        return PAGE
    if "region_id" in keys or children.get("lines") in (LINES, LINE) or children.get("regions") in (REGIONS, REGION):
        return REGION if "result" not in keys and "pages" not in keys and "page" not in keys else ENVELOPE
    if "line_id" in keys or ("text" in keys and ("polygon" in keys or "id" in keys)):
        return LINE
    if keys & {"result", "pages", "page"}:
        return ENVELOPE
    return OBJECT


def _kind(v) -> str:
    return TEXT if isinstance(v, str) else FLAG if isinstance(v, bool) else NUMBER if isinstance(v, (int, float)) else NULL


def states(root) -> dict[int, str]:
    """The state of every array and object below ``root`` by identity; a stack of our own, so depth has no limit."""
    got: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        v, ready = stack.pop()
        if not isinstance(v, (list, dict)):
            continue
        inside = v if isinstance(v, list) else v.values()
        if not ready:
            stack.append((v, True))
            stack.extend((x, False) for x in inside if isinstance(x, (list, dict)))
        elif isinstance(v, list):
            got[id(v)] = delta("array", None, {got.get(id(x)) or _kind(x) for x in v})
        else:
            got[id(v)] = delta("object", frozenset(v), {k: got.get(id(x)) or _kind(x) for k, x in v.items()})
    return got


def decoded(payload: str | None):
    """The JSON value of a payload, also where it is wrapped in JSON strings; None where none is complete."""
    v = payload
    while isinstance(v, str):
        try:
            v = json.loads(v.removeprefix("\ufeff"))
        except (ValueError, RecursionError):
            return None
    return v


def _many(v) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _num(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _whole(v):
    return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 2**31 else None


def _name(v):
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def points(v, state: str | None) -> tuple[str, list[tuple[float | None, float | None]]]:
    """The subtype and the points of a polygon in any of its encodings."""
    if isinstance(v, str):
        flat = [c for c in v.replace(",", " ").split() if c]
        try:
            nums = [float(c) for c in flat]
        except ValueError:
            return NONE, []
        return (COORDS, list(zip(nums[::2], nums[1::2]))) if len(nums) >= 2 else (NONE, [])
    if not isinstance(v, list) or not v:
        return NONE, []
    if state == PAIR:  # one flat run of coordinates
        return "points:flat", [(_num(a), _num(b)) for a, b in zip(v[::2], v[1::2])]
    out = []
    for p in v:
        if isinstance(p, dict):
            out.append((_num(p.get("x")), _num(p.get("y"))))
        elif isinstance(p, list):
            out.append((_num(p[0]) if p else None, _num(p[1]) if len(p) > 1 else None))
        elif isinstance(p, str):
            out.append((points(p, None)[1] or [(None, None)])[0])
        else:
            out.append((None, None))
    return (state if state in (PAIRS, XYS) else "points:mixed"), out


def _pages(root, state: dict[int, str]):
    """The pages of a payload in the order given, whatever wraps them."""
    stack = [root]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            if state[id(v)] == PAGE:
                yield v
            else:
                stack.extend(x for x in reversed(list(v.values())) if isinstance(x, (list, dict)))


def _shape(name: str, *marks: str | bool) -> str:
    """The name of a subtype: its level and the marks of its shape."""
    return f"{name}[{'+'.join(m for m in marks if m)}]"


def level_rows(raw_id: int, payload: str | None, levels: set[str]):
    """(level, row) of every row of ``levels`` in one payload, routed by the automaton's states."""
    root = decoded(payload)
    if not isinstance(root, (list, dict)):
        return
    state = states(root)
    for page_no, page in enumerate(_pages(root, state), 1):
        pid = _name(page.get("page_id"))
        if "page" in levels:
            model, timing = page.get("model"), _num(page.get("timing_ms"))
            model = _name(model.get("name")) if isinstance(model, dict) else None
            yield "page", (raw_id, page_no, pid, _shape("page", *(bool(_many(page.get(k))) and k for k in ("form_fields", "regions", "warnings")), model is not None and "model", timing is not None and "timed"), model, _name(page.get("schema_version")), timing)
        if "field" in levels:
            for k, f in enumerate((x for x in _many(page.get("form_fields")) if isinstance(x, dict)), 1):
                label = _name(f.get("label_text"))
                yield "field", (raw_id, page_no, pid, k, _name(f.get("field_id")), label, _name(f.get("value_text")), _shape("field", label is not None and "labelled"))
        stack = [(r, None, 1) for r in reversed(_many(page.get("regions"))) if isinstance(r, dict)]
        while stack:
            region, parent, depth = stack.pop()
            rid = _name(region.get("region_id", region.get("id")))
            stack.extend((r, rid, depth + 1) for r in reversed(_many(region.get("regions"))) if isinstance(r, dict))
            lines = [x for x in _many(region.get("lines")) if isinstance(x, dict)]
            if "region" in levels or "region_point" in levels:
                poly, pts = points(region.get("polygon"), state.get(id(region.get("polygon"))))
                index = _whole(region.get("reading_index"))
                if "region" in levels:
                    marks = (poly, bool(lines) and "lines", bool(_many(region.get("regions"))) and "regions", parent is not None and "inner", index is not None and "indexed")
                    yield "region", (raw_id, page_no, pid, rid, parent, depth, _name(region.get("type")), index, _shape("region", *marks))
                if "region_point" in levels:
                    for k, (x, y) in enumerate(pts, 1):
                        yield "region_point", (raw_id, pid, rid, k, x, y, poly)
            for line in lines if levels & _BELOW_LINES else ():
                yield from _line_rows(raw_id, page_no, pid, rid, line, state, levels)


_BELOW_LINES = {"line", "point", "word", "tag"}


def _line_rows(raw_id, page_no, pid, rid, line, state, levels):
    lid = _name(line.get("line_id", line.get("id")))
    words, tags = _many(line.get("words")), _many(line.get("tags"))
    if "line" in levels or "point" in levels:
        poly, pts = points(line.get("polygon"), state.get(id(line.get("polygon"))))
        if "line" in levels:
            index = _whole(line.get("reading_index"))
            yield "line", (raw_id, page_no, pid, rid, lid, _name(line.get("text")), index, len(words), _shape("line", poly, bool(words) and "words", bool(tags) and "tags", index is not None and "indexed"))
        if "point" in levels:
            for k, (x, y) in enumerate(pts, 1):
                yield "point", (raw_id, pid, rid, lid, k, x, y, poly)
            if not pts:
                yield "point", (raw_id, pid, rid, lid, 0, None, None, poly)
    if "word" in levels:
        for k, w in enumerate(words, 1):
            text, conf = (_name(w.get("text")), _num(w.get("conf"))) if isinstance(w, dict) else (_name(w), None)
            yield "word", (raw_id, pid, rid, lid, k, text, conf, _shape("word", conf is not None and "scored"))
    if "tag" in levels:
        for k, t in enumerate(tags, 1):
            yield "tag", (raw_id, pid, rid, lid, k, _name(t), _shape("tag"))


def rows_of(raw_id: int, payload: str | None, level: str):
    """The rows of one level of one payload."""
    return (row for _, row in level_rows(raw_id, payload, {level}))


def _delivered(raw: DataFrame, raw_id: str, payload: str) -> DataFrame:
    from ..plans.shared import once

    cols = [raw_id, payload] + (["received_at"] if "received_at" in raw.columns else [])
    return once(raw.select(*cols), raw_id).select(F.col(raw_id).cast("long").alias("raw_id"), F.col(payload).alias("payload"))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _parsed(src: DataFrame, schema: T.StructType, rows) -> DataFrame:
    """The rows that ``rows`` gives for each (raw_id, payload), in Arrow batches of bounded size."""
    kinds = [_ARROW[f.dataType.simpleString()] for f in schema.fields]
    names = schema.names

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.extend(rows(i, p))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    return src.mapInArrow(run, schema)


def structural_tables(raw: DataFrame, level: str, raw_id: str = "raw_id", payload: str = "payload") -> DataFrame:
    """One level's flat table (page, field, region, region_point, line, point, word or tag) of delivered payloads.

    A repeated ``raw_id`` counts once; a null one gives nothing. Payloads that hold no complete JSON,
    JSON null, numbers or plain text give no rows; a payload that is JSON inside a JSON string is
    opened. A line without points gives one point row with ``point_no`` 0 and null coordinates; regions without points, lines without words or
    tags and pages without fields give none. Missing optional fields are null. Other columns of ``raw`` are not read. Rows are parsed where they are
    read, one Arrow batch at a time; only the few keys delivered twice are looked at across rows.
    """
    return _parsed(_delivered(raw, raw_id, payload), T.StructType.fromDDL(LEVELS[level]), lambda i, p: rows_of(i, p, level))


def _union_schema() -> T.StructType:
    fields: dict[str, T.StructField] = {}
    for ddl in LEVELS.values():
        for f in T.StructType.fromDDL(ddl).fields:
            fields.setdefault(f.name, f)
    return T.StructType([T.StructField("level", T.StringType()), *fields.values()])


def write_structural_tables(raw: DataFrame, folder: str, raw_id: str = "raw_id", payload: str = "payload") -> dict[str, str]:
    """Parses every payload once and writes all levels below ``folder``, one subfolder per level and typed subtype; gives the levels' paths."""
    schema = _union_schema()
    spots = {level: [schema.names.index(f.name) for f in T.StructType.fromDDL(ddl).fields] for level, ddl in LEVELS.items()}
    width = len(schema.names)

    def rows(i, p):
        for level, row in level_rows(i, p, set(LEVELS)):
            wide = [None] * width
            wide[0] = level
            for k, v in zip(spots[level], row, strict=True):
                wide[k] = v
            yield tuple(wide)

    _parsed(_delivered(raw, raw_id, payload), schema, rows).write.partitionBy("level", "subtype").mode("overwrite").parquet(folder)
    return {level: f"{folder}/level={level}" for level in LEVELS}


def subtype_table(spark, folder: str, level: str, subtype: str | None = None) -> DataFrame:
    """A level of the tables that `write_structural_tables` wrote, or one subtype of it with only the columns that its shape has."""
    schema = T.StructType.fromDDL(LEVELS[level])
    df = spark.read.schema(_union_schema()).parquet(folder).where(F.col("level") == level)
    if subtype is None:
        return df.select(*schema.names)
    marks = set(subtype.partition("[")[2].rstrip("]").split("+"))
    lacking = {c for c, m in MARKED.get(level, {}).items() if m not in marks}
    return df.where(F.col("subtype") == subtype).select(*[c for c in schema.names if c not in lacking])


def page_tables(pages: DataFrame, level: str, key: Column | str = "pred_id") -> DataFrame:
    """The same levels from typed nested columns, with generators only (no Python).

    Null or empty arrays give no child rows, except that a line without points gives one point row
    with ``point_no`` 0. Orders count from 1 in the order given.
    """
    key = F.col(key) if isinstance(key, str) else key
    base = pages.select(key.alias("page_key"), "page_id", "regions") if level != "page" else pages
    if level == "page":
        return base.select(key.alias("page_key"), "page_id", F.coalesce(F.size("regions"), F.lit(0)).cast("int").alias("n_regions"))
    r = base.select("page_key", "page_id", F.posexplode("regions").alias("p", "r"))
    rid = (F.col("p") + 1).cast("int").alias("region_no")
    if level == "region":
        return r.select("page_key", "page_id", rid, F.col("r.region_id").alias("region_id"), F.col("r.type").alias("region_type"), F.col("r.reading_index").alias("reading_index"), F.greatest(F.coalesce(F.size("r.lines"), F.lit(0)), F.lit(0)).cast("int").alias("n_lines"))
    ln = r.select("page_key", "page_id", F.col("r.region_id").alias("region_id"), F.posexplode("r.lines").alias("q", "l"))
    lno = (F.col("q") + 1).cast("int").alias("line_no")
    if level == "line":
        return ln.select("page_key", "page_id", "region_id", lno, F.col("l.line_id").alias("line_id"), F.col("l.text").alias("text"), F.col("l.reading_index").alias("reading_index"))
    pt = ln.select("page_key", "page_id", "region_id", F.col("l.line_id").alias("line_id"), F.posexplode_outer("l.polygon").alias("k", "xy"))
    return pt.select("page_key", "page_id", "region_id", "line_id", F.coalesce(F.col("k") + 1, F.lit(0)).cast("int").alias("point_no"), F.try_element_at("xy", F.lit(1)).alias("x"), F.try_element_at("xy", F.lit(2)).alias("y"))
