import pytest
from pyspark.sql import functions as F

from spanframe import session


def test_stored_tables_keep_schema_and_prune(spark):
    df = spark.range(10).select("id", F.concat(F.lit("x"), "id").alias("text"), F.array("id").alias("a"))
    kept = session.stored(df)
    assert kept.dtypes == df.dtypes and sorted(map(tuple, kept.select("id", "text").collect())) == sorted(map(tuple, df.select("id", "text").collect()))
    assert "text" not in kept.select("id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert session.stored(df.limit(0)).count() == 0


class _Cluster:
    """What the folder's choice looks at, of a session on a cluster."""

    def __init__(self, folder, master="spark://host:7077"):
        self.sparkContext, self.master, self.folder = self, master, folder

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return self

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" and self.folder else default

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(_Cluster(None))
    named = _Cluster("hdfs://x/shared/")
    assert session.shared_folder(named) == "hdfs://x/shared" and named.chosen == "hdfs://x/shared/"
    for master in ("local", "local[4]", "local[*]"):
        assert session.shared_folder(_Cluster(None, master))
    # a cluster simulated on one machine is a cluster
    with pytest.raises(RuntimeError):
        session.shared_folder(_Cluster(None, "local-cluster[3,2,1024]"))
