"""Files in ranges, and files for each row."""

import os

import pytest
from pyspark.sql import functions as F

from evidentia.plans.reports import file_events
from evidentia.sources import folder
from evidentia.sources.files import extract, read_files, write_files


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    top = tmp_path_factory.mktemp("mixed")
    (top / "a.txt").write_text("plain words")
    (top / "deep").mkdir()
    (top / "deep/empty.txt").write_bytes(b"")
    with open(top / "huge.csv", "wb") as f:  # sparse
        f.truncate(3 << 30)
    (top / "b.pdf").write_bytes(b"%PDF-1.7" + b"x" * (8 << 20))
    (top / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0" + "WordDocument".encode("utf-16-le") + b"\1" * (8 << 20))
    (top / "noise.bin").write_bytes(bytes(range(32)) * (1 << 18))
    (top / "p.png").write_bytes(b"\x89PNG" + b"\0" * 100)
    return top


def test_a_huge_file_is_one_report(spark, top):
    files = read_files(spark, str(top))
    parts = {os.path.basename(r.name): r for r in extract(files).collect()}
    assert parts["huge.csv"].type == "too large" and "bytes" in parts["huge.csv"].error and parts["a.txt"].text == "plain words"
    assert parts["b.pdf"].type == "pdf" and parts["old.doc"].type == "doc" and parts["noise.bin"].type == "unknown" and parts["p.png"].kind == "image"
    assert parts["empty.txt"].type == "text" and len(parts) == 7
    assert {r.category for r in file_events(extract(files), F.lit("t")).collect()} == {"too_large", "unsupported_format"}


def test_the_content_of_refused_files_is_not_read(spark, top):
    read_files(spark, str(top))
    rows = {os.path.basename(r.name): r for r in spark.read.format(folder.Folder.name()).option("path", str(top)).load().collect()}
    for name in ("huge.csv", "b.pdf", "old.doc", "noise.bin"):
        assert rows[name].content is None and rows[name].n_read < 1.1 * (1 << 20)
    assert rows["a.txt"].n_read == 11
    every = {os.path.basename(r.name): r for r in read_files(spark, str(top), every_type=True).where("length < 100000000").collect()}
    assert len(every["b.pdf"].content) == (8 << 20) + 8


def test_conditions_are_answered_from_the_listing(spark, top):
    few = read_files(spark, str(top)).where(F.col("name").endswith(".txt") & (F.col("length") > 0))
    assert [os.path.basename(r.name) for r in few.collect()] == ["a.txt"]
    reader = folder.FolderReader({"path": str(top)})
    left = list(reader.pushFilters([folder.GreaterThan(("length",), 20), folder.EqualTo(("content",), b"")]))
    assert len(left) == 1 and sorted(os.path.basename(p) for x in reader.partitions() for p, _ in x.files) == ["b.pdf", "huge.csv", "noise.bin", "old.doc", "p.png"]


def test_partitions_are_planned_by_bytes(tmp_path):
    for k in range(10):
        with open(tmp_path / f"f{k}", "wb") as f:
            f.truncate(10 << 20)
    bins = folder.FolderReader({"path": str(tmp_path)}).partitions()
    assert [len(b.files) for b in bins] == [3, 3, 3, 1]
    assert [b.files for b in folder.FolderReader({"path": str(tmp_path / "none")}).partitions()] == [[]]


def test_another_store_is_read_by_spark(spark, top, monkeypatch):
    from evidentia.sources import files

    monkeypatch.setattr(files, "plain_path", lambda path: None)
    parts = {os.path.basename(r.name): r for r in extract(files.read_files(spark, str(top))).collect()}
    assert parts["huge.csv"].type == "too large" and parts["b.pdf"].type == "pdf" and parts["a.txt"].text == "plain words"


def test_files_for_rows(spark, tmp_path):
    rows = [(f"d{k % 3}/page {k}.html", f"<p>é {k}</p>") for k in range(50)]
    write_files(spark.createDataFrame(rows, "name string, content string").repartition(7), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.html")} == dict(rows)
    assert [p for p in os.listdir(tmp_path / "out") if p.startswith(".")] == []
    write_files(spark.createDataFrame([("d0/page 0.html", bytearray(b"new"))], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out/d0/page 0.html").read_bytes() == b"new"


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("content"))
    for rows, why in ((bad, "stop"), (spark.createDataFrame([("../x", "a")], "name string, content string"), "leaves"),
                      (spark.createDataFrame([("x", "a"), ("./x", "b")], "name string, content string"), "same name")):
        with pytest.raises(Exception, match=why):
            write_files(rows, str(tmp_path / "out"))
        found = [os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names]
        assert found == []
