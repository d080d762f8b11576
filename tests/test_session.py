import os

import pytest

import __spark_entry__ as entry
from leafmill import session


def test_numbered_over_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(7)
    assert [(r.v, r.i) for r in session.numbered(df, ["v"], "i").orderBy("v").collect()] == [(i, i) for i in range(1000)]
    assert session.numbered(df.where("false"), ["v"], "i").count() == 0


def test_cut_and_sweep(spark):
    df = session.cut(spark.range(3))
    at = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(at)
    session.sweep(spark)
    assert not os.path.exists(at)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isDefined():
                                return False

                        return O

                return S

    class Spark:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark)


def test_every_query_and_its_sql_are_registered():
    q, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= q.keys() and len(q) > 100


def test_the_flagship_query(spark):
    assert entry.entry(spark).columns == ["ProcessGroupName", "Task Name", "DelayedCount", "OnTimeCount"]
