import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gaitworks.session import local_session

    s = local_session("4", shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def many_parts(spark):
    """Small tables keep their partitions, so that ranges are cut inside groups."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def tiny_blocks(many_parts, monkeypatch):
    """Blocks of 4 rows, and as many ranges as there are shuffle partitions."""
    from gaitworks.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", 4)


@pytest.fixture(scope="session")
def skewed(spark):
    """One episode holds most rows."""
    import random

    rnd = random.Random(7)
    rows = []
    for ep, n in [(1, 61), (2, 3), (3, 9), (4, 1)]:
        for i in range(n):
            rows.append((ep, i, rnd.choice([None, None, float(rnd.randint(0, 9))]), float(rnd.randint(0, 5)), [float(i), float(rnd.randint(0, 9))]))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "episode_index long, frame_index long, maybe double, x double, v array<double>")
