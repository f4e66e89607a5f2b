import random

import pytest
from pyspark.sql import functions as F

# Names that operators use inside; as columns of the caller they must not disturb.
CLASHING = ("size", "rank", "label", "score", "key", "id", "vector", "k", "h", "words", "row", "hits", "length", "group",
            "piece", "offset", "n_tokens", "n_bytes", "offending", "capture", "digest", "copies", "bucket", "_h", "at")


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeioubcdst") for _ in range(draw.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def tricky():
    """(doc_id, text, source): nulls, blanks, short and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    words = prose(2, 120).split()
    near = words[:60] + ["changed"] + words[61:]
    return [
        (0, None, "b"), (1, "", "b"), (2, " \n\t ", None), (3, "one", "a"), (4, "a b c d", "a"), (5, long, "a"),
        (6, long + " end", "c"), (7, "one", "a"), (7, "one", "a"), (8, " ".join(words), "c"),
        (9, " ".join(near), None), (10, "A B C D", ""), (11, "e" * 100_000, "d"), (12, "x\x1cy <|endoftext|> Straße ÀÉ 日本 🙂", "d"),
        (13, "All rights\nreserved. all RIGHTS reserved CC-BY 4.0 cc by", "d"), (14, "GNU General Public License", None),
        (15, None, None), (16, " ".join(reversed(words)), "e"), (17, " \x0b\x85 one", "e"),
    ]


@pytest.fixture(scope="session")
def tricky_docs(spark, tricky):
    return with_clashes(spark.createDataFrame(tricky, "doc_id long, text string, source string")).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
