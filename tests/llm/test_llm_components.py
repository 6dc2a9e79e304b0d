"""Connected components: rounds and files follow the edges."""

import pytest

from gustwatch.llm import components


@pytest.fixture
def written(monkeypatch):
    """Files of each table that a call writes."""
    files = []
    write = components.Scratch.write

    def counted(self, df):
        out = write(self, df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components.Scratch, "write", counted)
    return files


def test_stars_need_no_round(spark, written):
    edges = spark.createDataFrame([(0, 1), (2, 0), (0, 3), (7, 8), (4, 4), (None, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7}
    assert len(written) == 1


def test_rounds_do_not_write_a_file_per_shuffle_partition(spark, written):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
        assert {r["component"] for r in components.components(chain).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 2 and max(written[1:]) <= spark.sparkContext.defaultParallelism
