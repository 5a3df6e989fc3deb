"""Small tables with the awkward cases that every operator meets."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `block` int, `cluster` long, `n` int, `score` double"

LETTERS = str.maketrans("0123456789", "aeioubdlnr")


def words(n: int, salt: int = 0) -> str:
    """Invented prose of ``n`` words in sentences of nine; another ``salt`` gives other words."""
    r = random.Random(salt)
    return " ".join(str(r.randrange(10**5, 10**6)).translate(LETTERS) + ("." if i % 9 == 8 else "") for i in range(n))


LONG = words(9000, 5)


def rows() -> list[tuple]:
    near = words(200, 1)
    edited = near.split()
    edited[100] = "changed"
    texts = {
        0: words(60), 1: words(60), 2: None, 3: "", 4: "  \t\n ", 5: near, 6: " ".join(edited), 7: LONG, 8: "One", 9: "one", 10: words(60).replace(" ", "\n", 3), 11: "a  b\n\nc ", 12: words(300, 2) + ". " + near,
    }
    out = [(i, t, "en", "s", len(t or ""), "k", 1, 2, 3, 0.5) for i, t in texts.items()]
    return [*out, out[5], (None, "no id here", None, None, None, None, None, None, None, None)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
