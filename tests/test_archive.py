"""Commits of an archive: replaced, deleted, failed, in conflict, compacted."""

import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.plans import archive as A

NOW = datetime.datetime(2026, 1, 1)


def rows(spark, *found):
    return spark.createDataFrame([(c, v, NOW, s, b) for c, v, s, b in found], A.VERSIONS)


def blob(spark, *found):
    return spark.createDataFrame([(c, b, bytearray(x)) for c, b, x in found], A.BLOBS)


def states(spark, path, upto=None):
    return {(r.case_id, r.version): r.state for r in A.versions(spark, path, upto).collect()}


def test_replace_delete_and_save_anew(spark, tmp_path):
    path = str(tmp_path / "a")
    assert A.save_version(rows(spark, ("c-1", "001", "first", ["b"]), ("c-2", "001", "other", [])), blob(spark, ("c-1", "b", b"x")), path) == 1
    assert A.save_version(rows(spark, ("c-1", "001", "replaced", ["b"])), blob(spark, ("c-1", "b", b"y")), path) == 2
    assert states(spark, path) == {("c-1", "001"): "replaced", ("c-2", "001"): "other"} and states(spark, path, 1)["c-1", "001"] == "first"
    kept = A.with_blobs(A.current(A.versions(spark, path)), A.stored_blobs(spark, path)).collect()
    assert [(r.case_id, bytes(r.content)) for r in kept] == [("c-1", b"y")]
    assert A.delete_cases(spark.createDataFrame([("c-1",), ("c-9",)], "case_id string"), path) == 3
    assert states(spark, path) == {("c-2", "001"): "other"} and A.stored_blobs(spark, path).count() == 0
    A.save_version(rows(spark, ("c-1", "002", "anew", [])), blob(spark), path)
    assert states(spark, path) == {("c-1", "002"): "anew", ("c-2", "001"): "other"} and len(states(spark, path, 2)) == 2


def test_a_crash_between_the_writes_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    A.save_version(rows(spark, ("c-1", "001", "old", [])), blob(spark), path)
    with monkeypatch.context() as m:
        m.setattr(A._Log, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            A.save_version(rows(spark, ("c-1", "002", "lost", [])), blob(spark, ("c-1", "b", b"z")), path)
    with pytest.raises(Exception):
        A.save_version(rows(spark, ("c-1", "003", "bad", [])).withColumn("state", F.raise_error(F.lit("crash")).cast("string")), blob(spark), path)
    (tmp_path / "a/log/000000000002.json").write_text('{"kind": "sa')  # another writer's entry, not yet whole
    assert states(spark, path) == {("c-1", "001"): "old"} and A.stored_blobs(spark, path).count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "a")
    base = A.save_version(rows(spark, ("c-1", "001", "base", [])), blob(spark), path)
    A.save_version(rows(spark, ("c-1", "002", "mine", [])), blob(spark), path, base)
    with pytest.raises(A.Conflict):
        A.save_version(rows(spark, ("c-1", "002", "yours", [])), blob(spark), path, base)
    assert states(spark, path)["c-1", "002"] == "mine" and A.last_commit(spark, path) == 2
    with pytest.raises(ValueError):
        A.save_version(rows(spark, ("../x", "001", "", [])), blob(spark), path)


def test_compaction_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    for k in range(4):
        A.save_version(rows(spark, (f"c-{k % 2}", f"00{k}", f"s{k}", ["b"])), blob(spark, (f"c-{k % 2}", "b", bytes([k]))), path)
    A.delete_cases(spark.createDataFrame([("c-0",)], "case_id string"), path)
    before, blobs = states(spark, path), {(r.case_id, bytes(r.content)) for r in A.stored_blobs(spark, path).collect()}
    assert A.compact(spark, path) == 6 and A._Log(spark, path).entries().count() == 1
    assert states(spark, path) == before == {("c-1", "001"): "s1", ("c-1", "003"): "s3"}
    assert {(r.case_id, bytes(r.content)) for r in A.stored_blobs(spark, path).collect()} == blobs == {("c-1", b"\3")}
    A.save_version(rows(spark, ("c-0", "009", "back", [])), blob(spark), path)
    assert len(states(spark, path)) == 3 and [(r.case_id, r.versions, r.rank) for r in A.listing(A.versions(spark, path)).orderBy("rank").collect()] == [("c-0", 1, 1), ("c-1", 2, 2)]
