"""How many files the steps of connected components leave, however many shuffle partitions there are."""

import glob

import pytest

from aislelens.llm import components


@pytest.fixture
def written(spark, monkeypatch):
    """(columns, files) of each table that a step writes, with 40 shuffle partitions that Spark doesn't merge."""
    found = []

    def counted(df):
        out = real(df)
        found.append((out.columns, len(glob.glob(out._folder.removeprefix("file://") + "/part-*"))))
        return out

    real = components.frozen
    monkeypatch.setattr(components, "frozen", counted)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield found
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_steps_of_components_leave_few_files(spark, written):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 400)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {k: 1 for k in range(1, 401)} | {1000: 1000, 1001: 1000}
    assert len(written) > 3 and all(n <= spark.sparkContext.defaultParallelism for _, n in written[1:])
