"""Where intermediate tables may lie."""

import pytest

from hirelake.session import is_local, scratch_path


class FakeSession:
    """Only the settings of a session."""

    def __init__(self, **conf):
        self.values = {k.replace("__", "."): v for k, v in conf.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder():
    with pytest.raises(ValueError):
        scratch_path(FakeSession(spark__master="spark://host:7077"), "table")
    with pytest.raises(ValueError):
        scratch_path(FakeSession(spark__master="local-cluster[2,1,1024]"), "table")


def test_scratch_lies_under_the_shared_folder():
    path = scratch_path(FakeSession(spark__master="yarn", spark__checkpoint__dir="hdfs://nn/shared/"), "table")
    assert path.startswith("hdfs://nn/shared/table-")


def test_local_masters():
    assert is_local("local") and is_local("local[8]") and not is_local("local-cluster[3,2,1024]") and not is_local("yarn")


def test_sources_hold(spark, tmp_path):
    from hirelake.sources import files

    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    (one / "b.jsonl").write_text('{"id": "x:1", "title": "first"}\n\n{"id": "x:1", "title": "again"}\n{"id": "x:2", "title": "two"}\n')
    (one / "a.jsonl").write_text('{"id": "x:1", "title": "other file"}\n')
    (two / "c.jsonl").write_text('{"id": "x:1", "title": "zero"}\n{"id": "x:3", "title": "three"}\n')
    read = {(r["source"], r["id"], r["title"]) for r in files.read_postings(spark, str(one)).collect()}
    assert read == {("b", "x:1", "first"), ("b", "x:2", "two"), ("a", "x:1", "other file")}
    titles = lambda paths: {r["id"]: r["title"] for r in files.union_fragments(spark, [str(p) for p in paths]).collect()}
    assert titles([two, one]) == {"x:1": "zero", "x:2": "two", "x:3": "three"}
    assert titles([one / "b.jsonl", two]) == {"x:1": "first", "x:2": "two", "x:3": "three"}
    (two / "d.jsonl").write_text('{"id": "x:9"}\n{"id": "x:8"\n')
    with pytest.raises(Exception, match="d.jsonl"):
        files.read_postings(spark, str(two)).collect()


def test_snapshots_switch_whole(spark, tmp_path):
    from hirelake.sources import files

    path = str(tmp_path / "table")
    files.write_snapshot(spark.range(3), path)
    before = files.read_snapshot(spark, path)
    files.write_snapshot(spark.range(5), path)
    assert before.count() == 3 and files.read_snapshot(spark, path).count() == 5  # readers of the old version keep it
    with pytest.raises(Exception):
        files.write_snapshot(spark.range(2).selectExpr("raise_error('x') AS id"), path)
    assert files.read_snapshot(spark, path).count() == 5
    files.drop_versions(spark, path)
    assert files.read_snapshot(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path / "none"))


def test_of_two_writers_from_one_version_the_second_is_told(spark, tmp_path):
    from hirelake.sources import files

    path = str(tmp_path / "table")
    base = files.write_snapshot(spark.range(3), path)
    theirs = files.write_snapshot(spark.range(4), path, expected=base)
    with pytest.raises(files.SnapshotConflict):
        files.write_snapshot(spark.range(9), path, expected=base)
    assert files.current_version(spark, path) == theirs and files.read_snapshot(spark, path).count() == 4

    # The other writer switches while this one still writes its rows: the same number is taken.
    taken = files._publish

    def late(*args):
        files._publish = taken
        files.write_snapshot(spark.range(5), path, expected=theirs)
        return taken(*args)

    files._publish = late
    try:
        with pytest.raises(files.SnapshotConflict):
            files.write_snapshot(spark.range(9), path, expected=theirs)
    finally:
        files._publish = taken
    assert files.read_snapshot(spark, path).count() == 5
    files.write_snapshot(spark.range(6), path)
    assert files.read_snapshot(spark, path).count() == 6


def test_a_writer_that_dies_before_its_pointer_is_whole_leaves_the_table(spark, tmp_path):
    from hirelake.sources import files

    path = str(tmp_path / "table")
    files.write_snapshot(spark.range(3), path)
    spark.range(7).write.parquet(f"{path}/v-dead")
    out = files._fs(spark, path).create(files._path(spark, f"{path}/.v-dead"), False)  # created, never closed: an empty file
    assert files.read_snapshot(spark, path).count() == 3
    out.close()
    files.write_snapshot(spark.range(4), path)
    assert files.read_snapshot(spark, path).count() == 4
    files.drop_versions(spark, path)
    assert files.read_snapshot(spark, path).count() == 4
