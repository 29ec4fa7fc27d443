from __future__ import annotations

import time

from pyspark.sql import functions as F

from tessera import session as S


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        names = (blocks.apply(i).name() for i in range(blocks.size()))
        return {n for n in names if n.startswith("shuffle_")}

    setting, before = spark.conf.get(S._CLEANUP), files()
    stored = S.materialize(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count())
    assert spark.conf.get(S._CLEANUP) == setting
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert stored.count() == 70


def test_intermediate_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.checkpoint.dir", None)
    S.materialize(spark.range(5).toDF("id"))
    assert spark.conf.get("spark.checkpoint.dir", None) == before
    monkeypatch.setattr(S, "shared_folder", lambda _: f"file://{tmp_path}")
    stored = S.materialize(spark.range(5).toDF("id"))
    assert stored.count() == 5 and str(tmp_path) in stored.inputFiles()[0]
    own = tmp_path / "tessera" / spark.sparkContext.applicationId
    assert any(own.iterdir())
    S.drop_intermediate(spark)
    assert not own.exists()
