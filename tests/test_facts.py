import pytest

from siterank.sources.keyed_store import KeyedStore
from siterank.streaming import resume

SCHEMA = "topic string, value string, source string, well_id string, ordinal long"


def facts(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)


def run(spark, base, store, **kw):
    resume.append_facts(spark, f"{base}/in", SCHEMA, f"{base}/{store}", f"{base}/ck-{store}", files_per_batch=1, **kw)
    return sorted((r.topic, r.value, r.ordinal) for r in resume.fact_store(spark, f"{base}/{store}").read().collect())


def test_each_fact_once_over_batches_and_a_replay(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    facts(spark, f"{base}/in", [("a", " x ", "s", None, 0), ("a", "x", "s", "w1", 1), ("b", "x", "s", None, 2), ("b", "  ", "s", None, 3), ("b", None, "s", None, 4)])
    facts(spark, f"{base}/in", [("a", "x", "s", None, 5), ("c", "y", "s", None, 6)])
    want = [("a", "x", 0), ("b", "x", 2), ("c", "y", 6)]
    assert run(spark, base, "whole") == want

    real, calls = KeyedStore.append, []

    def dies_after_the_switch(self, *a):
        version = real(self, *a)
        calls.append(version)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return version

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "append", dies_after_the_switch)
        with pytest.raises(Exception, match="killed"):
            run(spark, base, "broken")
    version = resume.fact_store(spark, f"{base}/broken").manifest()["version"]
    # the second batch is in the store but not in the checkpoint: it comes again and is known
    assert run(spark, base, "broken") == want
    assert resume.fact_store(spark, f"{base}/broken").manifest()["version"] == version
    facts(spark, f"{base}/in", [("c", "y ", "t", None, 7), ("d", "z", "t", None, 8)])
    assert run(spark, base, "broken") == [*want, ("d", "z", 8)]


def test_values_are_stripped_without_a_pattern_over_the_text(spark):
    """White space of any kind goes at both ends only; a line separator is not white space and hides none before it."""
    import hashlib

    given = [" \t\n\x0b\f\rx  y\r\n \f", "x", "", " \n\t", None, " x ", "x \u2028", "a\n\n b\n"]
    df = resume.as_facts(spark.createDataFrame([("t", v, "s", None, i) for i, v in enumerate(given)], SCHEMA))
    want = {i: v.strip(" \t\n\x0b\f\r") for i, v in enumerate(given) if v is not None and v.strip(" \t\n\x0b\f\r")}
    assert {r.ordinal: r.value for r in df.collect()} == want and want[6] == "x \u2028"
    assert {r.ordinal: r.key for r in df.collect()} == {i: hashlib.sha1(f"t:{v}".encode()).hexdigest()[:12] for i, v in want.items()}
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
