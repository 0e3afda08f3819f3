import os
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, TOP)
# Python workers import the package from here
os.environ["PYTHONPATH"] = os.pathsep.join([TOP, os.environ.get("PYTHONPATH", "")])

EPISODES = "episode_index long, instruction string, source_dataset string"


@pytest.fixture(scope="session")
def spark():
    from gaitworks.session import local_session

    s = local_session("4", shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null ids and sources, ties, a repeated row, a long text, and columns with clashing names."""
    rows = [
        (0, "pick the red cup", "a"), (1, None, "a"), (2, "", None), (3, "pick the red cup", None), (3, "pick the red cup", None),
        (None, "place it", "b"), (4, "pick \t the\nred  cup", "b"), (5, "Ünïcode 東京 　  wörds   x\n\n y  ", "a"), (6, " ".join(f"w{i % 701}" for i in range(30_000)), "b"),
        (7, "   \n ", "b"), (8, "one", "c"), (9, "Pick the red cup", "a"), (9, "other text", "c"),
    ]
    df = spark.createDataFrame(rows, EPISODES)
    extra = ["n", "key", "sig", "row_no", "salt", "digest", "ids", "size", "k", "at", "score", "base", "slots", "part", "target", "block", "hub", "index"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EPISODES)
