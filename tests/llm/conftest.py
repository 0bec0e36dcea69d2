import random

import pytest

#: Names that operators use for themselves, in any case.
CLASHING = ["x", "FP", "found", "piece", "id", "base", "runs", "spans", "media", "shard", "size", "host", "path", "n", "good", "Curve", "sequence_id", "_x", "_n", "_found", "h"]

ODD = [
    (1, "Plain words of a short text, and some more of them."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "x"),
    (5, "x"),
    (None, "a row without an id"),
    (None, None),
    (6, "Plain words of a short text, and some more of them."),
    (7, "ünï çødé 日本語 👍 \u0000   end"),
    (8, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Released under the MIT License."),
    (9, "long " * 60_000),
    (10, "y" * 200_000),
]


def frame(spark, rows):
    """documents with extra columns whose names clash."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(i, t, "en" if k % 3 else None, "src0" if k % 2 else None, None if t is None else len(t), *["?"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture
def rng():
    return random.Random(7)
