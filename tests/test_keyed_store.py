import glob
import os

import pytest
from pyspark.sql import functions as F

from siterank.sources import keyed_store as ks

SCHEMA = "key string, n long, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def numbered(spark, begin, end, note):
    return spark.range(begin, end).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("n"), F.lit(note).alias("note"))


def rows(store):
    return sorted((tuple(r) for r in store.read().collect()), key=str)


def files(path, kind="data"):
    return {f for f in glob.glob(f"{path}/{kind}/*/*/*.parquet")}


def test_merge_replaces_keys_and_leaves_other_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    store = ks.KeyedStore(spark, path).create(SCHEMA, ["key"], buckets=16)
    assert rows(store) == []
    store.merge(numbered(spark, 0, 400, "old"), "n")
    before = files(path)
    # a key twice, a new one, a key that is null, a null value
    fresh = frame(spark, [("k3", 7, "second"), ("k3", 5, "first"), ("new", 1, None), (None, 2, "no key")])
    store.merge(fresh, "n")
    want = {f"k{i}": (i, "old") for i in range(400)} | {"k3": (5, "first"), "new": (1, None), None: (2, "no key")}
    assert {r.key: (r.n, r.note) for r in store.read().collect()} == want and store.read().count() == len(want)
    assert store.last["read"] <= 3 and before <= files(path)
    named = {f"segment__={s}/bucket__={b}" for b, s in ks._named(store.manifest())}
    kept = {f for f in before if "/".join(f.split("/")[-3:-1]) in named}
    assert len(kept) >= 13  # untouched buckets keep their files under their names
    store.merge(frame(spark, [(None, 9, "again")]), "n")
    assert [(r.n, r.note) for r in store.read().where("key is null").collect()] == [(9, "again")]
    assert store.read(1).count() == 400 and store.read(1).where("note <> 'old'").count() == 0


def test_a_crash_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store = ks.KeyedStore(spark, path).create(SCHEMA, ["key"], buckets=4)
    store.append(numbered(spark, 0, 50, "old"), "n")
    before, old = rows(store), files(path)

    def dies(self, manifest):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ks.KeyedStore, "_switch", dies)
        with pytest.raises(RuntimeError, match="killed"):
            store.merge(numbered(spark, 0, 60, "new"), "n")
    assert files(path) > old and rows(ks.KeyedStore(spark, path)) == before
    # what it has left goes, and the change can be made again
    assert store.vacuum() > 0 and files(path) == old and rows(store) == before
    store.merge(numbered(spark, 0, 60, "new"), "n")
    assert {r.note for r in store.read().collect()} == {"new"} and store.read().count() == 60
    store.vacuum(keep=1)
    assert store.versions() == [2] and store.read().count() == 60 and not files(path) & old


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    store = ks.KeyedStore(spark, str(tmp_path / "t")).create(SCHEMA, ["key"], buckets=4)
    stale = store.manifest()
    store.merge(numbered(spark, 0, 5, "a"), "n")
    with pytest.raises(ks.Conflict):
        store._switch({**stale, "version": 1})
    assert store.read().count() == 5 and not [f for f in os.listdir(f"{store.path}/manifests") if f.startswith("tmp")]
    with pytest.raises(ValueError, match="bucket__"):
        ks.KeyedStore(spark, str(tmp_path / "u")).create("bucket__ int", ["bucket__"])


def test_append_reads_only_segments_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    store = ks.KeyedStore(spark, path).create(SCHEMA, ["key"], buckets=8)
    store.append(numbered(spark, 0, 5000, "a"), "n", "w", 0)
    store.append(numbered(spark, 5000, 5200, "b"), "n", "w", 1)
    assert store.last == {"segments": 8, "read": store.last["read"]} and store.read().count() == 5200
    # 12 keys that are not stored: an expected 0.1 filters say otherwise
    store.append(numbered(spark, 9000, 9012, "c"), "n", "w", 2)
    assert store.last["segments"] == 16 and store.last["read"] <= 2
    # one stored key, twice, and one new one
    store.append(frame(spark, [("k7", 0, "x"), ("k7", 1, "y"), ("fresh", 2, "z"), ("fresh", 1, "first")]), "n", "w", 3)
    assert 1 <= store.last["read"] <= 3
    got = {r.key: r.note for r in store.read().collect()}
    assert len(got) == 5213 == store.read().count() and got["k7"] == "a" and got["fresh"] == "first"
    # a replay changes nothing, nor does an empty batch
    version = store.manifest()["version"]
    assert store.append(numbered(spark, 20000, 20010, "late"), "n", "w", 3) == version
    assert store.append(frame(spark, []), "n") == version and store.read().count() == 5213


def test_full_buckets_are_written_as_one(spark, tmp_path):
    store = ks.KeyedStore(spark, str(tmp_path / "t")).create(SCHEMA, ["key"], buckets=1)
    for i in range(ks.MOST_SEGMENTS + 1):
        store.append(numbered(spark, i * 10, i * 10 + 15, str(i)), "n")
    assert len(ks._named(store.manifest())) == 1
    got = {r.n: r.note for r in store.read().collect()}
    assert got == {n: str(max(0, (n - 5) // 10)) for n in range(ks.MOST_SEGMENTS * 10 + 15)}


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_keys_of_several_columns_and_types(spark, tmp_path, keys):
    store = ks.KeyedStore(spark, str(tmp_path / "t")).create("a double, b date, v array<string>", keys, buckets=2)
    first = spark.sql("select 1.5D as a, date'2020-01-01' as b, array('x') as v, 1 as o, 'more' as extra union all select 1.5D, date'2020-01-02', null, 2, '' union all select null, null, array(), 3, ''")
    store.append(first, "o")
    assert store.read().count() == (2 if keys == ["a"] else 3)
    store.append(first, "o")
    store.merge(first.where("o = 2"), "o")
    got = {(r.a, str(r.b)): r.v for r in store.read().collect()}
    assert got[1.5, "2020-01-02"] is None and len(got) == (2 if keys == ["a"] else 3)
