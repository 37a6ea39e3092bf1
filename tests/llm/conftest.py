"""Small tables with every awkward row: nulls, empty, blank and very long texts, repeats, clashing extra columns."""

import pytest

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))


def prose(seed: int, n: int = 120) -> str:
    words = ["river", "stone", "under", "light", "morning", "walked", "house", "quiet", "the", "and", "a", "of", "carried", "window", "letters", "slowly"]
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(words[x % len(words)] + (f"{x % 89}" if x % 5 == 0 else "") + ("." if i % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with odd rows; the extra columns have names that operators use inside or return."""
    rows = [
        (1, prose(1), "en", "s1"), (2, prose(2), "en", "s1"), (3, prose(3), "de", "s2"), (4, prose(1), "en", None), (5, prose(2) + " tail", "en", "s2"),
        (6, "", "en", "s1"), (7, None, None, "s2"), (8, " \n\t ", "en", None), (9, LONG, "en", "s1"), (10, "word", "en", "s3"), (11, "two words", "en", "s3"),
        (12, "\n\n" + prose(4) + "\n\n", "en", "s1"), (None, prose(5), "en", "s1"), (13, prose(6), "en", "s1"), (13, prose(6), "en", "s1"), (14, "ünï 𝔘nicode   x y 字", "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("score", "fp", "node", "kept", "size", "shard", "bucket", "key", "u", "__r", "ids", "component_id", "n_words")})


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (5, 1, 0), (9, 0, 0), (None, 1, 1), (12, None, None), (13, 1, 0), (13, 0, 1), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
