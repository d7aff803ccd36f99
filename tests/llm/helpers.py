"""Small document tables with the awkward rows that every operator has to bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared lines, nulls, blanks, repeated rows and a very long text."""
    rng = random.Random(seed)
    shared = "This line of forty characters or more is shared by many."
    out = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5)))
        if i % 4 == 0:
            text = f"{text}\n  {shared.upper() if i % 8 else shared} \n{sentence(rng, 6)}"
        out.append((i, text, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(text)))
    base = sentence(rng, 120).split()
    for k in range(6):
        near = list(base)
        near[10 * k] = "changed"
        out.append((1000 + k, " ".join(near), "en", "a", 0))
    out += [(2000 + k, out[5][1], "en", "hot", 0) for k in range(20)]
    out += [
        (3000, None, "en", "a", None), (3001, "", None, None, 0), (3002, " \n\t ", "en", "b", 4), (None, "no id here", "en", "b", 9),
        (3003, "Ünï ÇODE wörds joined 日本語 😀 'll it's don''t <|endoftext|> x", "fr", "", 3), (3004, "one", "en", "a", 3),
        (3005, "#### *** $$ %% && || <<>> ####", "en", "a", 3), (3006, sentence(rng, 30_000), "en", "long", 0),
        (3007, "x" * 5000, "en", "a", 0), (3007, "x" * 5000, "en", "a", 0), (3008, "same words " * 40, "en", "a", 0),
    ]
    return out


def docs(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
