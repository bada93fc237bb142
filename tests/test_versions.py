"""Replacing tables: whatever step fails, the old or the new content is there."""

import os

import pytest

from casegrid import schema as S
from casegrid.plans import catalog, sinks, versions


class Failed(Exception):
    pass


def _fail_at(monkeypatch, module, n):
    """Let the n-th step fail; returns the list of steps that were reached."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise Failed(name)

    monkeypatch.setattr(module, "step", step)
    return seen


def test_versions_survive_a_failure_at_any_step(spark, tmpdir_path, monkeypatch):
    table = lambda n: spark.range(n)
    reached = set()
    for n in range(1, 10):
        root = f"{tmpdir_path}/t{n}"
        with monkeypatch.context() as m:
            for size in (1, 2, 3):
                versions.publish(table(size), root)
            seen = _fail_at(m, versions, n)
            try:
                versions.publish(versions.read(spark, root).union(table(10)), root)     # reads what it replaces
                whole = True
            except Failed:
                whole = False
            reached |= set(seen)
        found = versions.read(spark, root).count()
        assert found == (13 if whole or seen[-1] not in ("write", "commit") else 3)
        left = versions.recover(spark, root)
        assert (len(left) > 0) <= (not whole)
        versions.publish(table(7), root)
        assert versions.read(spark, root).count() == 7 and versions.recover(spark, root) == []
        assert len(os.listdir(f"{root}/data")) == versions.KEEP
        if whole:
            break
    assert whole and {"write", "commit", "check", "clean", "drop commits", "drop data"} <= reached


def test_half_written_version_is_not_read(spark, tmpdir_path):
    versions.publish(spark.range(4), tmpdir_path)
    os.makedirs(f"{tmpdir_path}/data/0000000002-dead")
    assert versions.read(spark, tmpdir_path).count() == 4
    assert versions.recover(spark, tmpdir_path) == ["0000000002-dead"]


def test_reader_keeps_its_version(spark, tmpdir_path):
    versions.publish(spark.range(4), tmpdir_path)
    before = versions.read(spark, tmpdir_path)
    versions.publish(spark.range(9), tmpdir_path)
    assert before.count() == 4 and versions.read(spark, tmpdir_path).count() == 9


def test_two_writers_of_one_number(spark, tmpdir_path, monkeypatch):
    versions.publish(spark.range(1), tmpdir_path)

    def other(name):
        if name == "check":
            open(f"{tmpdir_path}/commits/0000000002-zzzz", "w").close()
            versions.publish.__globals__["step"] = lambda _: None

    monkeypatch.setattr(versions, "step", other)
    with pytest.raises(RuntimeError, match="another writer"):
        versions.publish(spark.range(2), tmpdir_path)


def test_replaced_catalog_table(spark, tmpdir_path):
    name = "versioned_" + os.path.basename(tmpdir_path).replace("-", "_")
    assert catalog.replace_table(spark.range(3), name, tmpdir_path).count() == 3
    grown = catalog.replace_table(spark.table(name).union(spark.range(5)), name, tmpdir_path)      # from itself
    assert grown.count() == 8 and spark.table(name).count() == 8
    other = spark.createDataFrame([(1, "x"), (2, "y")], "a long, p string")
    assert catalog.replace_table(other, name, tmpdir_path, ["p"]).where("p = 'y'").collect() == [(2, "y")]
    assert catalog.replace_table(other.limit(1), name, tmpdir_path, ["p"]).count() == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, tmpdir_path + "/none")


def test_csv_replacement_recovers_from_a_failure_at_any_step(spark, tmpdir_path, monkeypatch):
    path = tmpdir_path + "/report"
    one = spark.createDataFrame([("A", "X", 1, 1.0)], S.PRODUCT_STATE_SCHEMA)
    two = spark.createDataFrame([("A", "X", 1, 1.0), ("B", "Y", 2, 2.0)], S.PRODUCT_STATE_SCHEMA)
    count = lambda: sinks.read_report_csv(spark, path, S.PRODUCT_STATE_SCHEMA).count()
    for n, after in ((1, 1), (2, 1), (3, 2), (4, 2)):
        sinks.overwrite_in_place(one, path)
        with monkeypatch.context() as m:
            seen = _fail_at(m, sinks, n)
            with pytest.raises(Failed):
                sinks.overwrite_in_place(two, path)
        assert seen[-1] == ["write", "move aside", "move in", "delete"][n - 1]
        assert sinks.recover_in_place(spark, path) == (n > 1)
        assert count() == after and os.listdir(tmpdir_path) == ["report"]
        assert not sinks.recover_in_place(spark, path)
