import io
import tarfile
import zipfile

import pytest

from paraleaf.sources import archives as A


def tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, data in members:
            m = tarfile.TarInfo(name)
            if data is None:
                m.type, m.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(m)
            else:
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
    return str(path)


def test_unpack(tmp_path):
    good = tar(tmp_path / "g.tgz", [("a/b.txt", b"x"), ("./c.txt", b"")])
    assert A.unpack(good, str(tmp_path / "g")) == ["a/b.txt", "c.txt"] and (tmp_path / "g/a/b.txt").read_bytes() == b"x"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/e", "y")
    assert A.unpack(str(tmp_path / "z.zip"), str(tmp_path / "z")) == ["d/e"]
    for k, bad in enumerate([[("../x", b"")], [("/x", b"")], [("l", None)], [("a", b"1"), ("a", b"2")]]):
        with pytest.raises(A.UnsafeArchive):
            A.unpack(tar(tmp_path / f"{k}.tgz", bad), str(tmp_path / f"b{k}"))
        assert not (tmp_path / f"b{k}").exists() and not (tmp_path / f"b{k}.part").exists()
    with pytest.raises(A.UnsafeArchive):
        A.unpack(good, str(tmp_path / "m"), most_members=1)
    with pytest.raises(A.UnsafeArchive):
        A.unpack(good, str(tmp_path / "s"), most_bytes=0)
    with pytest.raises(FileExistsError):
        A.unpack(good, str(tmp_path / "g"))


def test_tree_hash_and_shared_values(spark):
    rows = [("a", bytearray(b"1")), ("b", bytearray(b"2"))]
    h = lambda r: A.tree_hash(spark.createDataFrame(r, "path string, content binary"))
    assert h(rows) == h(rows[::-1]) != h([("a", bytearray(b"2")), ("b", bytearray(b"1"))]) and h(rows) != h([*rows, rows[0]])
    a = spark.createDataFrame([("1", "f"), ("2", " "), (None, "g")], "item string, font string")
    b = spark.createDataFrame([("1", "x"), ("1", " "), (None, "g")], "item string, font string")
    assert sorted(map(tuple, A.shared_values(a, b, ["item", "font"]).collect())) == [("font", "g"), ("item", "1")]
    assert A.shared_values(a, b.limit(0), ["item"]).count() == 0
    s = spark.createDataFrame([(3,), (4,)], "pages int")
    assert A.selection_totals(s, {"rows": 2, "pages": 8}, {"pages": 7}) == {"declared:rows": True, "declared:pages": False, "target:pages": True}


def test_observations(spark):
    seen = [("left", 0.1, 0.80, 0.2, 0.05), ("right", 0.6, 0.81, 0.2, 0.05), ("below", 0.1, 0.5, 0.2, 0.05), ("lost", None, 0.5, 0.2, 0.05)]
    schema = "page_id string, width int, height int, rtl boolean, observations array<struct<text:string,x:double,y:double,w:double,h:double>>"
    df = spark.createDataFrame([("p", 100, 200, True, seen), ("q", 100, 200, None, seen), ("e", 1, 1, True, None)], schema)
    got = {}
    for r in A.observation_lines(df).orderBy("page_id", "line_no").collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["row_no"]))
    assert got == {"p": [("right", 0), ("left", 0), ("below", 1)], "q": [("left", 0), ("right", 0), ("below", 1)]}
    assert A.observation_lines(df).where("text = 'below'").first()["polygon"][0] == pytest.approx([10.0, 90.0])
