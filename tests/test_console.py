from pyspark.sql import functions as F

from changeflow.model import as_changes
from changeflow.plans import job
from changeflow.plans.config import Plugin


def test_console_prints_every_row(spark, capsys):
    rows = as_changes(spark.range(2500).withColumn("x", F.lit("v")).repartition(3))
    job.sink(spark, Plugin("Console", {}))(rows, 0)
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("[console] ")]
    assert len(lines) == len(set(lines)) == 2500
