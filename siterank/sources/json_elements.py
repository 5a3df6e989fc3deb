"""Elements of large JSON files, read in splits: arrays of records, keyed objects and feature collections.

Files are read through Spark's text reader with ``}`` as line end, so any store and any split size will do.  A split doesn't
know whether it begins inside a string or how deep.  A first pass sums up each split for both cases; the sums of a file's
splits, a row each, are carried forward; a second pass cuts each split into elements from its now known beginning.  Elements
that cross splits come out in pieces and are put together by their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.session import cut_lineage

_ESCAPED = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
SUMMARY = "file string, start long, in_string boolean, ends_in_string boolean, depth int, closes map<int,long>, first string"


def _outside(text: str, in_string: bool) -> tuple[str, bool]:
    """What of a fragment lies outside strings, and whether it ends inside one."""
    if "\\" in text:
        text = _ESCAPED.sub("", text)
    parts = text.split('"')
    return "".join(parts[in_string::2]), (len(parts) % 2 == 0) != in_string


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of fragments of one split, in order."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        lo = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[lo] or starts[i] != starts[lo]:
                yield (files[lo], starts[lo]), values[lo:i]
                lo = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}

    def out(key, states) -> pa.RecordBatch:
        rows = [{"file": key[0], "start": key[1], "in_string": bool(s), "ends_in_string": x[0], "depth": x[1], "closes": list(x[2].items()), "first": x[3]} for s, x in enumerate(states)]
        schema = pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("in_string", pa.bool_()), ("ends_in_string", pa.bool_()), ("depth", pa.int32()),
            ("closes", pa.map_(pa.int32(), pa.int64())), ("first", pa.string()),
        ])
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for key, texts in _fragments(batches):
        if key not in held:
            if held:
                yield out(*held.popitem())
            held[key] = [[False, 0, Counter(), None], [True, 0, Counter(), None]]
        for state in held[key]:
            inside, depth, closes, first = state
            for text in texts:
                outer, inside = _outside(text, inside)
                depth += outer.count("{") + outer.count("[") - outer.count("]")
                if first is None:
                    first = outer.strip()[:1] or None
                if not inside:
                    depth -= 1  # the } at which the fragment ends
                    closes[depth] += 1
            state[:] = inside, depth, closes, first
    if held:
        yield out(*held.popitem())


def _carry(level: int):
    def forward(rows: pd.DataFrame) -> pd.DataFrame:
        """Where each split of a file begins: inside a string or not, how deep, and after how many elements."""
        inside, depth, number, out = False, 0, 0, []
        known = {(r.start, r.in_string): r for r in rows.itertuples()}
        first = None
        for start in sorted({s for s, _ in known}):
            r = known[start, inside]
            first = first or r.first
            out.append((r.file, start, inside, depth, number, first))
            number += dict(r.closes).get(level - depth, 0)
            depth, inside = depth + r.depth, r.ends_in_string
        return pd.DataFrame(out, columns=["file", "start", "inside", "depth", "number", "root"])

    return forward


PIECES = "file string, number long, start long, depth int, whole boolean, value string"


def _pieces(level: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def flush(rows: list) -> pa.RecordBatch:
            names = ["file", "number", "start", "depth", "whole", "value"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

        def rest(key, s) -> list:
            return [(*key[:1], s["number"], key[1], s["from"], False, "".join(s["held"]))] if s["held"] else []

        for batch in batches:
            given = batch.to_pydict()
            rows = []
            for file, start, value, inside, depth, number in zip(*(given[c] for c in ("file", "start", "value", "inside", "depth", "number"))):
                key = (file, start)
                if key not in state:
                    for k, s in state.items():
                        rows += rest(k, s)
                    state = {key: {"inside": inside, "depth": depth, "number": number, "from": depth, "held": [], "first": True}}
                s = state[key]
                outer, s["inside"] = _outside(value, s["inside"])
                s["depth"] += outer.count("{") + outer.count("[") - outer.count("]")
                s["held"].append(value + "}")
                if not s["inside"]:
                    s["depth"] -= 1
                    if s["depth"] == level:
                        # the first element of a split may have begun before it
                        rows.append((file, s["number"], start, s["from"], not s["first"], "".join(s["held"])))
                        s.update(number=s["number"] + 1, held=[], first=False)
                        s["from"] = level
            if rows:
                yield flush(rows)
        rows = [r for k, s in state.items() for r in rest(k, s)]
        if rows:
            yield flush(rows)

    return cut


def _elements(level: int, keyed: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leave out what stands before the object; drop objects that belong to another container."""
        for batch in batches:
            files, numbers, depths, values = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "number", "depth", "value"))
            rows = []
            for file, number, depth, text in zip(files, numbers, depths, values):
                key = None
                for m in _TOKEN.finditer(text):
                    c = m[0]
                    if c[0] == '"':
                        key = c
                    elif c == "{" and depth == level:
                        before = text[: m.start()].rstrip()[-1:]
                        # at the end of a file a remainder without an object is no element
                        if (before == ":") == keyed and text.endswith("}"):
                            rows.append((file, number, key if keyed else None, text[m.start() :]))
                        break
                    else:
                        depth += 1 if c in "{[" else -1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())],
                names=["file", "number", "key", "value"],
            )

    return strip


def read_elements(spark: SparkSession, path: str, level: int = 1, keyed: bool = False, root: str | None = None) -> DataFrame:
    """``file, number, key, value``: the objects ``level`` containers deep, as text, numbered by their order in the file.

    Level 1: elements of an array, or with ``keyed`` the values of an object under their ``key``.  Level 2: elements of the
    arrays under the root, as in a feature collection.  ``root``: a file that begins with another sign is refused.  Other
    values than objects are passed over.  Files that Spark can't split (compressed ones) are read whole by one task each.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    sums = text.mapInArrow(_summaries, SUMMARY)
    # two rows for each split; the driver holds a list of all splits anyway
    begins = cut_lineage(sums.groupBy("file").applyInPandas(_carry(level), "file string, start long, inside boolean, depth int, number long, root string"))
    if root and (other := begins.where(F.col("root") != root).select("file").first()):
        raise ValueError(f"{other.file} doesn't begin with {root}")
    pieces = text.join(F.broadcast(begins.drop("root")), ["file", "start"]).select("file", "start", "value", "inside", "depth", "number").mapInArrow(_pieces(level), PIECES)
    cut = pieces.where("not whole").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "depth", "value"))).alias("x"))
    cut = cut.select("file", "number", F.col("x")[0]["depth"].alias("depth"), F.array_join("x.value", "").alias("value"))
    whole = pieces.where("whole").select("file", "number", "depth", "value")
    return whole.unionByName(cut).mapInArrow(_elements(level, keyed), "file string, number long, key string, value string")
