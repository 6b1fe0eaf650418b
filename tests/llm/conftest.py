import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from edge import EXTRA, SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns({c: F.lit("other") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, edge, tmp_path_factory):
    """A folder of tables with the odd documents, and labels and vectors as odd."""
    d = tmp_path_factory.mktemp("edge")
    edge.write.parquet(f"{d}/documents.parquet")
    labels = [(1, 1, 0), (4, 1, None), (4, 1, 0), (5, None, 0), (6, 1, 0), (None, 0, 0), (15, 0, 0), (8, 0, 0), (11, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)
