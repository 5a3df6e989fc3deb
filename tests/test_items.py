import time

import pytest

from siterank.streaming import items as it

SCHEMA = "scan_id string, pages int, ordinal long"


def work(row):
    """Items of no page fail; those of one page are partial."""
    pages = 6 // row.pages
    return {"share": pages, **({"status": "partial"} if row.pages == 1 else {})}


def manifest(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base, days=30.0, output="out", **kw):
    it.process_items(spark, f"{base}/in", SCHEMA, work, "share int", f"{base}/{output}", f"{base}/ck-{output}", "scan_id", "ordinal", days=days, files_per_batch=1, **kw)
    rows = it.outcomes(spark, f"{base}/{output}", "scan_id").collect()
    return sorted(((r.scan_id, r.attempts, r.status, r.error, r.share) for r in rows), key=str)


def batches(spark, base, output="out"):
    return spark.read.parquet(f"{base}/{output}").count()


def test_failed_items_are_tried_again_and_fresh_ones_are_not(spark, tmp_path):
    base = str(tmp_path)
    manifest(spark, f"{base}/in", [("a", 2, 0), ("b", 0, 1), ("c", 1, 2), ("a", 3, 3), (None, 2, 4), ("d", 0, None), ("d", 6, 9)])
    none = "ZeroDivisionError: integer division or modulo by zero"
    first = run(spark, base)
    assert first == sorted([("a", 1, "complete", None, 3), ("b", 1, "error", none, None), ("c", 1, "partial", None, 6), ("d", 1, "complete", None, 1),
                            (None, 1, "error", "item without id", None)], key=str)
    # nothing new: nothing is done
    assert run(spark, base) == first and batches(spark, base) == 5
    manifest(spark, f"{base}/in", [("a", 1, 0), ("b", 3, 1), ("c", 0, 2)])
    again = run(spark, base)
    assert ("a", 1, "complete", None, 3) in again and ("b", 2, "complete", None, 2) in again and ("c", 1, "partial", None, 6) in again
    assert batches(spark, base) == 6
    # the setting of the caller's session is as before
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_old_outcomes_expire(spark, tmp_path):
    base, second = str(tmp_path), 1 / 86_400
    manifest(spark, f"{base}/in", [("a", 2, 0)])
    assert run(spark, base, days=second) == [("a", 1, "complete", None, 3)]
    time.sleep(1.5)
    manifest(spark, f"{base}/in", [("a", 3, 0)])
    assert run(spark, base, days=second) == [("a", 1, "complete", None, 2)]
    assert batches(spark, base) == 2


def test_a_killed_run_goes_on_to_the_same_table(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    for i in range(3):
        manifest(spark, f"{base}/in", [(f"s{j}", (i + j) % 3, j) for j in range(i, 6)])
    whole = run(spark, base, output="whole")
    real, left = it.F.coalesce, [2]

    def dies(*c):  # inside the commit of the second batch, before its folder is written
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("killed")
        return real(*c)

    monkeypatch.setattr(it.F, "coalesce", dies)
    with pytest.raises(Exception, match="killed"):
        run(spark, base, output="broken")
    monkeypatch.undo()
    assert batches(spark, base, "broken") < batches(spark, base, "whole")
    assert run(spark, base, output="broken") == whole
    per_batch = [sorted(map(str, spark.read.parquet(f"{base}/{o}").select("scan_id", "attempts", "status", "batch").collect())) for o in ("whole", "broken")]
    assert per_batch[0] == per_batch[1]
    assert spark.read.parquet(f"{base}/whole/*/failed=true").count() > 0


def test_calls_to_the_state_store_do_not_grow_with_the_items():
    """A slot of many items costs as many calls as one of a few; of repeats the first by order counts."""
    from pyspark.sql import Row, types as T

    class Clock:
        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return 7

    class State:
        def __init__(self):
            self.entries, self.calls = [], 0

        def getListState(self, name, schema, ttl):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return iter(self.entries)

        def appendList(self, more):  # noqa: N802
            self.calls += 1
            self.entries += more

    calls = []
    for n in (3, 3_000):
        state, names = State(), ["scan_id", "pages", "ordinal"]
        p = it.Attempts(work, T.StructField("scan_id", T.StringType()), "ordinal", names, ["share"], 1000, it.ACCEPTED)
        p.init(state)
        rows = [Row(scan_id=f"i{j % n}", pages=j % 3, ordinal=j, slot__=0) for j in range(2 * n)]
        got = list(p.handleInputRows((0,), iter(rows), Clock()))
        assert [(r.scan_id, r.attempts, r.status) for r in got[:3]] == [("i0", 1, "error"), ("i1", 1, "partial"), ("i2", 1, "complete")] and len(got) == n
        again = list(p.handleInputRows((0,), iter(rows[:n]), Clock()))
        assert {(r.attempts, r.status) for r in again} == {(2, "error")} and len(again) == n // 3
        calls.append(state.calls)
    assert calls == [4, 4]
