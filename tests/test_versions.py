"""Versioned table: a plain dictionary as its model, crashes, two writers, buckets that grow."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators.versions import ConflictError, VersionedTable

SCHEMA = "name string, n int, version long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def state(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rank", [None, "version"])
def test_many_writes_equal_a_dictionary(spark, tmp_path, rank):
    rng = random.Random(6)
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name", rank=rank, bucket_rows=25, fold_after=3)
    model, versions = {}, {}
    for turn in range(6):
        batch, gone = [], []
        for name in rng.sample([f"f{i}" for i in range(30)], 7):
            if rank is None and rng.random() < 0.2:
                gone.append(name)
                model.pop(name, None)
                continue
            version = rng.randint(1, 9)
            own = [(name, i, version) for i in range(1 if rank else rng.randint(1, 6))]
            batch += own
            if not rank or version >= versions.get(name, 0):
                model[name], versions[name] = own, version
        table.write(rows(spark, batch), spark.createDataFrame([(g,) for g in gone], "name string") if gone else None)
        if turn % 4 == 2:
            table.fold()
        assert state(table.read()) == sorted(r for own in model.values() for r in own)
        if turn % 3 == 0:
            some = spark.createDataFrame([("f1",), ("f2",), ("nope",)], "name string")
            assert state(table.lookup(some)) == sorted(r for k in ("f1", "f2") for r in model.get(k, []))
    assert len(table.manifest().deltas) < 3


def test_buckets_stay_below_their_size_and_others_stay_where_they_are(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name", bucket_rows=40)
    table.write(rows(spark, [(f"f{i}", j, 1) for i in range(150) for j in range(3)] + [("giant", j, 1) for j in range(90)]))
    m = table.fold()
    assert sum(n for *_, n in m.buckets) == 540 and len(m.buckets) > 12
    sizes = {(d, b): n for d, b, _, n in m.buckets}
    assert sorted(sizes.values())[-2] <= 40 and max(sizes.values()) < 90 + 40  # one file cannot be split
    # one file again: its bucket alone is written anew
    table.write(rows(spark, [("f7", 0, 2)]))
    after = table.fold()
    old, new = {tuple(b[:3]) for b in m.buckets}, {tuple(b[:3]) for b in after.buckets}
    assert len(old - new) == 1 and len(new - old) == 1
    assert state(table.read().filter("name = 'f7'")) == [("f7", 0, 2)] and table.read().count() == 538
    # versions read before stay readable
    assert table.read(m).count() == 540


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name", fold_after=99)
    table.write(rows(spark, [("a", 1, 1), ("b", 1, 1)]), epoch=0)
    before = table.manifest()

    def crash(self, new):
        raise KeyboardInterrupt

    for step in (lambda: table.write(rows(spark, [("a", 2, 2)]), epoch=1), table.fold):
        with monkeypatch.context() as m:
            m.setattr(VersionedTable, "_switch", crash)
            with pytest.raises(KeyboardInterrupt):
                step()
        assert table.manifest() == before and state(table.read()) == [("a", 1, 1), ("b", 1, 1)]
    # a manifest whose write was cut short is no version
    torn = tmp_path / "t" / "manifest" / f"{before.version + 1:012d}" / "_temporary" / "0" / "_temporary" / "attempt_0"
    torn.mkdir(parents=True)
    (torn / "part-00000.txt").write_text("{")
    assert table.manifest() == before
    table.write(rows(spark, [("a", 2, 2)]), epoch=1)  # the restarted epoch
    assert state(table.read()) == [("a", 2, 2), ("b", 1, 1)] and table.manifest().epoch == 1


def test_the_later_of_two_writers_gets_an_error(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name") for _ in range(2))
    one.write(rows(spark, [("a", 1, 1)]))
    seen = two.manifest()
    one.write(rows(spark, [("b", 1, 1)]))
    with monkeypatch.context() as m:  # reads the version before the other writer's
        real, calls = two.manifest, []
        m.setattr(two, "manifest", lambda: seen if not calls.append(1) and len(calls) == 1 else real())
        with pytest.raises(ConflictError):
            two.write(rows(spark, [("c", 1, 1)]))
    assert state(one.read()) == [("a", 1, 1), ("b", 1, 1)]


def test_reading_one_file_reads_its_bucket(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name", bucket_rows=10)
    table.write(rows(spark, [(f"f{i}", 0, 1) for i in range(200)]))
    m = table.fold()
    got = table.lookup(spark.createDataFrame([("f3",)], "name string"))
    assert state(got) == [("f3", 0, 1)] and len(got.inputFiles()) < len(m.buckets) / 4


def test_empty_tables_and_batches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "name")
    assert table.read().count() == 0 and table.fold().version == 0
    table.write(rows(spark, []))
    table.fold()
    assert table.read().count() == 0
    table.write(rows(spark, [("a", 1, 1), (None, 2, 1)]))
    table.fold()
    table.write(rows(spark, [("a", 2, 1)]))
    assert state(table.read()) == [("a", 2, 1)]
    assert table.lookup(spark.createDataFrame([("a",)], "name string")).agg(F.count("*")).first()[0] == 1
