"""A table of awkward documents, the same for every operator."""

import random

import pytest

from quillframe.llm.common import Scratch

SCHEMA = "size long, doc_id long, text string, lang string, source string, n_chars long, `key` string, start double, band string, U string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


def awkward():
    rng = random.Random(3)
    base = prose(rng, 300)
    passage = prose(rng, 90)
    texts = [None, "", " \n\t ", "one", "Two  words", base, base, base.upper(), base.replace("a", "A", 1), base + " tail", passage, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", f"{passage}\n{passage}"]
    texts += [base.replace(" ", " ", 2), "é" * 700, "éè" * 500, "x" * 5000, prose(rng, 30_000), "line one here\nline one here\n\nline one here", "### *** $$$ " * 60, "<|endoftext|> a\x00b", "漢字かな交じり文 " * 30]
    near = base.split()
    for i in range(12):
        near = [*near]
        near[rng.randrange(len(near))] = f"w{i}"
        texts.append(" ".join(near))
    rows = [(7, i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), len(t or ""), "k", 0.5, "b", "u") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (7, None, base, None, None, None, None, None, None, None), (7, None, "no id here", "en", "a", 3, "k", 1.0, "b", "u"), (7, 3, "another text of the same id", "en", "b", 1, "k", 1.0, "b", "u")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
