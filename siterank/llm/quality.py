"""Quality classifier from weak labels.

Heuristic labellers vote on every text (good, bad or abstain).  Expectation-maximisation over the counts of vote
patterns of all documents estimates how often each labeller votes for either class; the patterns' posteriors then label a
bounded sample on which a linear scorer over hashed shapes and words is trained, and the scorer decides on every document.
No given label is used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siterank.llm.common import ragged, released, small_batches, stage, table, texts_of
from siterank.llm.hashed_linear import Rows, fit, sigmoid

WIDTH = 1 << 16
#: Documents that the scorer is trained on, the same number at most of each vote pattern, by the hash of their id.
SAMPLE = 8_000
#: Votes; 0 abstains.
ABSTAIN, GOOD, BAD = 0, 1, -1


PLAIN = re.compile(r"[^\W\d_]['\w-]*[,.;:!?]?")
ODD = re.compile(r".*[^\w\s]{2}|[^\w\s]+")
ENDS = re.compile(r".*\w[,.;:!?]")
#: A share of a text's words or lines is a feature for each of these levels that it reaches.
LEVELS = (0.01, 0.03, 0.1, 0.2, 0.4, 0.7)


def look(word: str) -> tuple:
    """Shape, chars, signs, capitals, digits, and whether a word is plain, odd or ends a clause.

    Shape: runs of capitals, small letters and digits as A, a and 0; other signs as they are, at most two alike.
    """
    tail = word[-1] if word[-1] in ",.;:!?" else ""
    core = word[: -1] if tail else word
    if core.isalpha() and core.isascii() and (core.islower() or core[1:].islower()):
        up = not core.islower()
        return ("Aa" if up else "a") + tail, len(word), len(tail), int(up), 0, True, False, bool(tail)
    out: list[str] = []
    for c in word:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if out[-1:] != [k] or (k not in "0Aa" and out[-2:] != [k, k]):
            out.append(k)
    return (
        "".join(out), len(word), sum(not c.isalnum() for c in word), sum(c.isupper() for c in word), sum(c.isdigit() for c in word),
        bool(PLAIN.fullmatch(word)), bool(ODD.fullmatch(word)), bool(ENDS.fullmatch(word)),
    )


class Reader:
    """Measures texts; keeps a bounded table of the words it has looked at."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, tuple] = {}
        self.limit = limit

    def measure(self, text: str) -> tuple[dict[str, float], dict[str, float]]:
        """Shares that the labellers judge, and shares of the word shapes."""
        words = text.split()
        n, shapes, known = len(words), {}, self.known
        held = Counter(words)
        if len(known) > self.limit:
            known = self.known = {}
        chars = signs = upper = digits = plain = odd = ends = 0
        for w, c in held.items():
            k = known.get(w)
            if k is None:
                k = known[w] = look(w)
            kind, m, s, u, d, p, o, e = k
            shapes[kind] = shapes.get(kind, 0) + c
            chars, signs, upper, digits = chars + c * m, signs + c * s, upper + c * u, digits + c * d
            plain, odd, ends = plain + c * p, odd + c * o, ends + c * e
        lines, some, long = text.split("\n"), max(n, 1), max(len(text), 1)
        seen = {
            "n": n, "signs": signs / long, "upper": upper / long, "digits": digits / long, "plain": plain / some, "odd": odd / some, "ends": ends / some,
            "length": chars / some, "same": sum(map(eq, words, words[1:])) / some, "distinct": len(held) / some, "lines": 1 - len(set(lines)) / len(lines),
        }
        return seen, {k: v / some for k, v in shapes.items()}

    def votes(self, text: str) -> tuple[int, ...]:
        """1 (good), -1 (bad) or 0 (abstains) of every labeller."""
        return votes(self.measure(text)[0])

    def features(self, text: str) -> list[int]:
        """Hashed features: each level that the share of a word shape or another measure reaches."""
        seen, shapes = self.measure(text)
        shares = shapes | {f"={k}": seen[k] for k in ("same", "distinct", "lines", "ends")}
        return sorted({zlib.crc32(f"{k} {x}".encode()) % WIDTH for k, v in shares.items() for x in LEVELS if v >= x})


LABELLERS = ("signs", "upper", "digits", "same", "odd", "length", "distinct", "prose", "ends")


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """Votes of the labellers for a text's measures; most know one fault and abstain otherwise."""

    def vote(bad: bool, good: bool = False) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    n, flowing = m["n"], m["same"] < 0.05 and m["distinct"] > 0.15
    return (
        vote(m["signs"] > 0.12), vote(m["upper"] > 0.3 and n >= 4), vote(m["digits"] > 0.3), vote(m["same"] > 0.15 and n >= 8),
        vote(m["odd"] > 0.15 and n >= 8), vote(m["length"] > 15 and n >= 8), vote(m["distinct"] < 0.1 and n >= 50),
        vote(m["plain"] < 0.7, m["plain"] > 0.85 and flowing and m["upper"] < 0.1), vote(m["ends"] < 0.01 and n >= 40, 0.03 < m["ends"] < 0.5 and flowing),
    )


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Probability that each vote pattern is good, by expectation-maximisation with independent labellers.

    ``patterns``: votes of each pattern in a row.  Labellers know different faults, so the first guess, which fixes which class
    is good, is that a text with any bad vote is bad.
    """
    good = np.where((patterns == BAD).any(1), 0.1, 0.9)
    hot = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], 2).astype(float)
    for _ in range(rounds):
        mass = np.stack([(1 - good) * counts, good * counts])
        prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        # most labellers know one fault only, so that an abstention is modelled as a third vote
        given = np.einsum("cp,plv->clv", mass, hot) + 0.5
        given /= given.sum(2, keepdims=True)
        joint = np.log(prior)[:, None] + np.einsum("plv,clv->cp", hot, np.log(given))
        new = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -40, 40)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good




def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in small_batches(batches):
        given = np.array([reader.votes(t) for t in batch.column(1).to_pylist()], np.int8).reshape(-1, len(LABELLERS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(given[:, i]) for i in range(len(LABELLERS)))], names=["doc_id", *LABELLERS])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in small_batches(batches):
        rows = [reader.features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), ragged(np.array([x for r in rows for x in r], np.int32), [len(r) for r in rows])], names=["good", "ids"])


def _scorer(w: np.ndarray, b: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in small_batches(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            z = np.array([w[reader.features(t)].sum() for t in batch.column(at).to_pylist()]) + b
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(sigmoid(z), pa.float64())], names=[*(n for n in batch.schema.names if n != "__text"), "__score"])

    return score


def train(plain: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer learned from all votes on ``doc_id, text``."""
    names = LABELLERS
    voted = stage(plain.mapInArrow(released(_vote), "doc_id long, " + ", ".join(f"{k} byte" for k in names)), "votes")
    counted = voted.groupBy(*names).count().collect()  # at most 3 ** labellers rows
    if not counted:
        return np.zeros(WIDTH), 0.0
    patterns, counts = np.array([[r[n] for n in names] for r in counted]), np.array([r["count"] for r in counted], float)
    good = fit_votes(patterns, counts)
    spark = plain.sparkSession
    marks = spark.createDataFrame([(*map(int, p), float(g)) for p, g in zip(patterns, good)], ", ".join(f"{n} byte" for n in names) + ", good double")
    # sure posteriors only, as many of either class at most
    sure = voted.join(F.broadcast(marks), list(names)).filter("good < 0.1 or good > 0.9").select("doc_id", "good")
    chosen = None
    for side in ("good < 0.5", "good > 0.5"):
        part = sure.filter(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = plain.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").select("good", "text").mapInArrow(released(_featurise), "good double, ids array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(WIDTH), 0.0
    y, lists = got.column(0).to_numpy(), pa.concat_arrays(got.column(1).chunks)
    if y.min() > 0.5 or y.max() < 0.5:
        return np.zeros(WIDTH), 4.0 if y.min() > 0.5 else -4.0
    share = (y > 0.5).mean()
    return fit(Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy()), y, np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)), WIDTH, l2=1e-3)


def score_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", score_col: str = "quality_score", sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of ``docs`` and the probability that the text is good.

    Null texts are scored as empty ones, for which no feature speaks; repeated rows and null ids are scored like others.  With
    no or one class among sure votes all rows get one score.  ``score_col`` replaces a column of that name.
    """
    w, b = train(texts_of(docs, id_col, text_col), sample)
    given = docs.drop(score_col).withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kinds = ", ".join(f"`{c}` {t}" for c, t in given.drop("__text").dtypes)
    return given.mapInArrow(released(_scorer(w, b)), f"{kinds}, __score double").withColumnRenamed("__score", score_col)


#: Documents with a lower score are rejected: only what is bad almost surely goes.
KEEP_FROM = 0.05


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_FROM).alias("kept"))
