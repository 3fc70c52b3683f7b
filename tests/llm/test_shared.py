"""Folders, filesystems and identities of rows."""

from pathlib import Path

import pytest

from paperloom.llm import shared
from paperloom.llm.tokens import PieceEncoder


@pytest.mark.parametrize("uri, arrow", [
    ("s3a://bucket/a/b", "s3://bucket/a/b"), ("s3n://b/x", "s3://b/x"), ("gs://b/x", "gs://b/x"), ("hdfs://name:8020/x", "hdfs://name:8020/x"),
    ("viewfs://store/x", "viewfs://store/x"), ("abfss://c@acc.dfs.core.windows.net/x", "abfss://c@acc.dfs.core.windows.net/x"),
    ("wasbs://c@acc.blob.core.windows.net/x", "abfss://c@acc.dfs.core.windows.net/x"),
])
def test_schemes(uri, arrow):
    assert shared.arrow_uri(uri) == arrow


def test_local_paths_and_unknown_schemes(tmp_path):
    for uri in (f"file://{tmp_path}/x", f"file:{tmp_path}/x", f"{tmp_path}/x"):
        filesystem, path = shared.open_filesystem(uri)
        assert filesystem.type_name == "local" and path == f"{tmp_path}/x"
    with pytest.raises(ValueError):
        shared.arrow_uri("ftp://host/x")


class Session:
    """What shared_dir reads of a session that names no folder."""

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = self
        self.get = lambda *_: None
        self.set = lambda *_: None


def test_a_cluster_must_name_its_folder():
    assert shared.shared_dir(Session("local[2]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,900]"):
        with pytest.raises(ValueError):
            shared.shared_dir(Session(master))


def test_rows_are_numbered_and_tables_released(spark, monkeypatch):
    monkeypatch.setattr(shared, "_written", [])
    docs = spark.range(50).selectExpr("id", "'mine' as _file", "1 as `_AT`").repartition(3)
    rows, file, at = shared.numbered(docs)
    assert (file, at) == ("_file_", "_at_") and rows.select(file, at).distinct().count() == 50
    again, _, _ = shared.numbered(shared.materialise(docs, "t"))
    assert again.drop(file, at).columns == docs.columns
    folders = [p.removeprefix("file://") for p in shared._written]
    assert all(Path(f).exists() for f in folders) and shared.release(spark) == len(folders)
    assert not any(Path(f).exists() for f in folders)


def test_pieces_without_ids_in_a_full_cache():
    encoder = PieceEncoder.__new__(PieceEncoder)
    encoder.cache, encoder.room, encoder.folds, encoder.pattern = {"x": b""}, 0, False, __import__("re").compile("[a-z]")
    encoder._whole = lambda texts: [t.encode() for t in texts]
    assert encoder.encode_many(["xy"]) == [b"y"]


def test_rows_at_places(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as _word", "'t' as _bits0").repartition(3).write.parquet(str(tmp_path / "t"))
    rows, file, at = shared.numbered(spark.read.parquet(str(tmp_path / "t")))
    wanted = rows.where("id % 5 < 3 and id < 990").selectExpr(file, at, "cast(id % 5 + 1 as int) as n")
    want = sorted((i, i % 7, "t", i % 5 + 1) for i in range(990) if i % 5 < 3)
    for most in (1 << 20, 0):
        found = shared.at_places(rows, wanted, file, at, "n", planes=2, most_words=most)
        assert sorted(map(tuple, found.drop(file, at).collect())) == want
        plain = shared.at_places(rows, wanted, file, at, most_words=most)
        assert plain.columns == rows.columns and plain.count() == len(want)
    assert shared.at_places(rows, wanted.limit(0), file, at).count() == 0


def test_a_large_heap_of_the_driver_is_collected_between_jobs(spark, monkeypatch):
    """Garbage of many tasks let the heap grow to its bound, however little of it was live."""
    jvm, told = spark.sparkContext._jvm, []
    plain = shared.tidy
    monkeypatch.setattr(shared, "tidy", lambda s: told.append(s) or plain(s))
    assert shared.materialise(spark.range(3), "tidied").count() == 3 and told == [spark]
    collected = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = collected()
    assert not plain(spark, 1.0) and plain(spark, 0.0) and collected() > before
