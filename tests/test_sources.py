import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from paraleaf.operators.report import flattened, write_bundle
from paraleaf.sources import pages as S
from paraleaf.sources import registry as R

PAGE = """<?xml version="1.0"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="a.png" imageWidth="100" imageHeight="200" readingDirection="right-to-left">
<ReadingOrder><OrderedGroup><RegionRefIndexed index="1" regionRef="r1"/><RegionRefIndexed index="0" regionRef="r2"/></OrderedGroup></ReadingOrder>
<TextRegion id="r1" type="paragraph"><Coords points="0,0 10,0 10,10"/><TextLine id="l1"><Coords points="0,0 5,0 5,5"/><Baseline points="0,4 5,4"/><TextEquiv><Unicode>שלום</Unicode></TextEquiv></TextLine>
<TextLine id="l2"><Coords points="0,0 5,0 5,5"/><Word><TextEquiv><Unicode>a</Unicode></TextEquiv></Word><Word><TextEquiv><Unicode>b</Unicode></TextEquiv></Word></TextLine></TextRegion>
<TextRegion id="r2"><Coords points="0,0 10,0 10,10"/></TextRegion></Page></PcGts>"""
ALTO = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><sourceImageInformation><fileName>a.png</fileName></sourceImageInformation></Description><Layout><Page WIDTH="100" HEIGHT="200"><PrintSpace>
<TextBlock ID="b1" HPOS="0" VPOS="0" WIDTH="50" HEIGHT="20"><TextLine ID="l1" HPOS="0" VPOS="0" WIDTH="50" HEIGHT="10" BASELINE="9"><String CONTENT="שלום"/></TextLine><TextLine ID="l2"><String CONTENT="a"/><SP/><String CONTENT="c"/><HYP/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""


def test_page_and_alto(spark, tmp_path):
    p = S.pagexml(PAGE.encode())
    assert [r["reading_index"] for r in p["regions"]] == [1, 0] and [x["text"] for x in p["regions"][0]["lines"]] == ["שלום", "a b"]
    assert p["regions"][0]["lines"][0]["base_direction"] == "rtl"
    a = S.alto(ALTO.encode())
    assert [x["text"] for x in a["regions"][0]["lines"]] == ["שלום", "a c-"] and a["regions"][0]["lines"][0]["baseline"] == [[0.0, 9.0], [50.0, 9.0]]
    for d, t in (("p", PAGE), ("a", ALTO), ("p", None)):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / ("x.xml" if t else "bad.xml")).write_text(t or "<broken")
    pages, altos = S.xml_pages(spark, str(tmp_path / "p"), "page"), S.xml_pages(spark, str(tmp_path / "a"), "alto")
    assert sorted(r["problem"] is None for r in pages.collect()) == [False, True]
    assert [(r["line_id"], r["problem"]) for r in S.paired_parity(pages, altos).collect()] == [("l2", "text_differs")]
    from pyspark.sql import functions as F

    both = lambda d: d.unionByName(d.withColumn("page_id", F.concat("page_id", F.lit("-2"))))
    two = S.paired_parity(both(pages.where("page_id is not null")), both(altos.withColumn("page_id", F.lit(pages.where("page_id is not null").first()["page_id"])))).collect()
    assert sorted(r["line_id"] for r in two) == ["l2", "l2"] and len({r["page_id"] for r in two}) == 2
    with pytest.raises(ValueError):
        S.pagexml(b'<!DOCTYPE x [<!ENTITY a "b">]><PcGts/>')


def test_points(spark):
    assert S.parse_points("1,2 3,4") == S.parse_points("1 2 3 4") == [[1, 2], [3, 4]] and S.parse_points("") == []
    for bad in ("1,2 3", "1 2 3", "1,2,3 4,5,6"):
        with pytest.raises(ValueError):
            S.parse_points(bad)
    df = spark.createDataFrame([("1,2 3,4",), ("1 2",), (None,)], "t string")
    assert [r[0] for r in df.select(S.point_column(F.col("t"))).collect()] == [[[1.0, 2.0], [3.0, 4.0]], None, None]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"page_id": "p", "n": 1}\n\n[1]\n{"page_id": "p", "n": 2}\n{broken\n')
    good, bad = S.jsonl(spark, str(tmp_path), "page_id string, n int")
    assert good.count() == 2 and bad.count() == 2
    assert [(r["page_id"], r["n"]) for r in S.unique_key(good, "page_id").collect()] == [("p", 2)]


def test_tsv(spark):
    rows = [(5, 1, 1, 1, 1, 2, 50, 10, 20, 10, 80.0, "world"), (5, 1, 1, 1, 1, 1, 10, 12, 30, 10, 90.0, "hello"), (4, 1, 1, 1, 1, 0, 0, 0, 0, 0, -1.0, None), (5, 1, 1, 1, 2, 1, 0, 0, 5, 5, 50.0, " ")]
    got = S.recogniser_tsv(spark.createDataFrame(rows, S.TSV)).collect()
    assert [(r["text"], r["conf"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [("hello world", 85.0, 10, 10, 70, 22)]


def test_html():
    b = S.html_blocks('<div data-label="table" data-bbox="0 0 2000 10"><table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table></div><div data-label="text">x<br>y</div>')
    assert b[0]["box"] == [0, 0, 1000, 10] and b[0]["cells"] == [(0, 2, 0, 1, "a"), (0, 1, 1, 2, "b"), (1, 2, 1, 2, "c")] and b[1]["text"] == "x\ny"
    assert S.html_blocks("<p>plain</p>")[0]["text"] == "plain" and S.html_blocks("")[0]["text"] == ""


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, data in (("k1.json", json.dumps({"text": "א"}).encode()), ("k1.png", b"img"), ("k2.json", b"{"), ("../k3.png", b"x")):
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    got = [(r["text"], r["problem"]) for r in S.tar_samples(spark, str(tmp_path)).collect()]
    assert sorted((t or "", p or "") for t, p in got) == [("", "bad_json"), ("", "unsafe_member"), ("א", "")]


def test_images_and_gold(spark):
    df = spark.createDataFrame([((bytearray(b"x"), None), "s1", None, None, "00"), ((bytearray(b"x"), None), "s2", "w", "d", None)], "image struct<bytes:binary,path:string>, sample_id string, writer string, source_doc string, image_sha256 string")
    assert [(r["document_key"], r["hash_ok"]) for r in S.image_text(df).collect()] == [("s1", False), ("d", True)]
    g = spark.createDataFrame([({"a": "1", "license": "x"},), (None,)], "metadata map<string,string>")
    assert [r[0] for r in S.installed_gold(g, {"license": F.lit("y")}).collect()] == [{"a": "1", "license": "y"}, {"license": "y"}]


def test_registry():
    assert R.fingerprint({"a": 1, "b": 2}) == R.fingerprint({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        R.Limits(line_iou=1.5)
    import base64
    import gzip
    import hashlib

    data = b'[{"page": 1}]'
    packed = base64.b64encode(gzip.compress(data)).decode()
    assert R.unpack_lock([packed[:5], packed[5:]], hashlib.sha256(data).hexdigest()) == [{"page": 1}]
    with pytest.raises(ValueError):
        R.unpack_lock([packed], "0")


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([("p", 0.5)], "page_id string, cer double")
    files = write_bundle(str(tmp_path), {"a": {"b": 1}}, df, df.limit(0))
    assert "metrics.json" in files and flattened({"a": {"b": 1, "c": []}}) == {"a.b": 1}
