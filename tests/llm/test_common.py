"""Folders for intermediate tables."""

import pytest

from sparkloom.llm import common


class Session:
    def __init__(self, **conf):
        self.conf = conf


def test_folders_must_be_shared_on_a_cluster():
    assert common.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/"})) == "hdfs://x"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(**{"spark.master": master}))


def test_only_few_rows_are_broadcast(spark):
    plan = lambda most: spark.range(100).join(common.small(spark.range(10), most), "id", "left_anti")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(9)
