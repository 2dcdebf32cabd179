"""Scratch tables."""

import os
from types import SimpleNamespace

import pytest

from pagewright import scratch


def test_tables_go_with_their_block(spark):
    outside, path = scratch.written(spark.range(3), "outside")
    with scratch.scratch(spark):
        inside, gone = scratch.written(spark.range(5), "inside")
        assert inside.count() == 5 and gone.startswith(scratch.shared_dir(spark))
    local = lambda p: p.removeprefix("file://")
    assert not os.path.exists(local(gone)) and os.path.exists(local(path)) and outside.count() == 3
    scratch.delete(spark, gone)


@pytest.mark.parametrize(("master", "raises"), [("local[8]", False), ("local", False), ("local-cluster[3,2,1000]", True), ("spark://x:7077", True), ("yarn", True)])
def test_a_cluster_must_name_its_shared_folder(master, raises):
    conf = {}
    named = SimpleNamespace(get=lambda key, default=None: conf.get(key, default), set=conf.__setitem__)
    session = SimpleNamespace(conf=named, sparkContext=SimpleNamespace(master=master))
    if raises:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(session)
    else:
        assert scratch.shared_dir(session) == conf["spark.checkpoint.dir"]
    conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert scratch.shared_dir(session) == "hdfs://shared"


def test_shuffle_files_go_with_the_write(spark):
    """The setting holds for the write only."""
    was = spark.conf.get(scratch.CLEANUP)
    kept = scratch.stored(spark.range(1000).repartition(7, "id"), "dealt")
    assert spark.conf.get(scratch.CLEANUP) == was and kept.count() == 1000 and kept.count() == 1000


def test_a_grown_heap_is_given_back(spark, monkeypatch):
    """pipeline: what queries left in the driver is collected when a table is written, if the heap has grown."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def collections() -> int:
        before = sum(b.getCollectionCount() for b in beans if "Old" in b.getName())
        scratch.stored(spark.range(3), "some")
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName()) - before

    monkeypatch.setattr(scratch, "HEAP_GROWN", 0.0)
    assert collections() > 0
    monkeypatch.setattr(scratch, "HEAP_GROWN", 1.0)
    assert collections() == 0
