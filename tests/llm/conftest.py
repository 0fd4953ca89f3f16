import random

import pytest

WORDS = "the of and oak river stone küche señor maß 数据 light wind over under again password alpha beta".split()


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """Checkpoints of these tests go to a folder of their own."""
    from tabwise.session import checkpoint_dir

    return checkpoint_dir(spark)


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(n=60, seed=3):
    """Invented documents with nulls, empty, very long and repeated texts, and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = sentence(rng, rng.randint(1, 60))
        rows.append([i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None]), len(text)])
    long = sentence(rng, 20_000)
    rows += [[n, None, "en", "s1", None], [n + 1, "", "en", "s1", 0], [n + 2, " \n\t ", None, "s4", 4],
             [n + 3, long, "en", "s2", len(long)], [None, "no id here", "en", "s1", 10], list(rows[3]), list(rows[3]),
             [n + 4, rows[5][1], "de", "s9", 1]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, shared):
    return spark.createDataFrame(documents(), DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark, shared):
    return spark.createDataFrame([], DOC_SCHEMA)


def clashing(df):
    """The same rows with extra columns whose names operators might want for themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in (
        "size", "rank", "shard", "__key", "__size", "__part", "hit", "items", "window", "a.b", "__c0", "start", "key")})
