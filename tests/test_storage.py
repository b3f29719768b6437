"""The shared folder comes from the session; only local mode may do without."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runweave.storage import CHECKPOINT_CONF, CLEANUP_CONF, cut_lineage, discard, files_for, release, shared_path


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


def session(**conf):
    return SimpleNamespace(conf=Conf({k.replace("_", "."): v for k, v in conf.items()}))


def test_named_folder_is_used():
    spark = session(spark_master="yarn", spark_checkpoint_dir="hdfs://nn/shared/")
    assert shared_path(spark, "runs").startswith("hdfs://nn/shared/runs-")
    assert shared_path(spark, "runs") != shared_path(spark, "runs")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(RuntimeError, match=CHECKPOINT_CONF):
        shared_path(session(spark_master="spark://host:7077"), "runs")


def test_local_mode_makes_one_folder(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    spark = session(spark_master="local[2]")
    a, b = shared_path(spark, "a"), shared_path(spark, "b")
    assert a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] == spark.conf[CHECKPOINT_CONF]


def test_cut_rows_are_fixed(spark):
    cut = cut_lineage(spark.range(100).select(F.rand().alias("x")), "random")
    assert cut.collect() == cut.collect()


def test_released_tables_are_gone(spark, monkeypatch):
    monkeypatch.setattr("runweave.storage._handed_out", {})
    cut = cut_lineage(spark.range(10), "kept")
    path = cut.inputFiles()[0]
    assert cut.count() == 10 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_tables_of_other_sessions_stay(spark, monkeypatch):
    monkeypatch.setattr("runweave.storage._handed_out", {})
    other = spark.newSession()
    mine, theirs = cut_lineage(spark.range(10), "mine"), cut_lineage(other.range(7), "theirs")
    assert mine.count() == 10 and release(spark) == 1
    assert theirs.count() == 7 and release(other) == 1


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = [found.apply(i).name() for i in range(found.size())]
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_gone(spark):
    before, set_before = shuffle_files(spark), spark.conf.get(CLEANUP_CONF, None)
    cut = cut_lineage(spark.range(1_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP_CONF, None) == set_before
    assert cut.agg(F.sum("count")).first()[0] == 1_000


def test_discarded_tables_are_gone_and_others_stay(spark, monkeypatch):
    monkeypatch.setattr("runweave.storage._handed_out", {})
    gone, stays = cut_lineage(spark.range(10), "gone"), cut_lineage(spark.range(7), "stays")
    path = gone.inputFiles()[0]
    discard(spark, gone, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert stays.count() == 7 and release(spark) == 1


def test_files_for_rows():
    assert [files_for(n, 10) for n in (0, 1, 10, 11, 100)] == [1, 1, 1, 2, 10]
