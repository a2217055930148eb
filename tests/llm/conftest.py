import random

import pytest

from tests.llm.brute import DOCS

SYLLABLES = "the an er on re th in ed nd ha to or it is es hi ng of st en".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated and null ids, non-ASCII text."""
    rng = random.Random(11)
    passage, base = sentence(rng, 60), sentence(rng, 120)
    near = base.split()
    rows = [(1, base), (2, base), (3, base.upper()), (None, base), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One  two"), (9, "x"), (10, "\n".join([passage] * 3)), (11, "a" * 300), (12, "é" * 200), (13, "é" * 90 + "b"), (14, sentence(rng, 5000))]
    for k in range(20, 50):
        w = near[:]
        w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    for k in range(50, 80):
        rows.append((k, f"{sentence(rng, rng.randint(0, 30))} {passage} {sentence(rng, rng.randint(0, 30))}"))
    rows += [(90, passage), (90, passage), (90, base + " other"), (None, None), (None, passage + " x"), (91, passage[: len(passage) // 2] + passage), (92, "SYMBOL### " * 30 + "!!! $$$"), (93, sentence(rng, 40) + " end")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, "s", len(t or "")) for k, (i, t) in enumerate(odd_rows)], DOCS)
    clashing = ("id", "tag", "row", "n", "k", "node", "component", "size", "slot", "stratum", "level", "kept", "n_words", "held_out", "rank", "score", "h", "c")
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clashing])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, 1 if k < 85 else 0, 0) for k in range(1, 93)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
