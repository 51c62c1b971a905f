"""Tables in the shared folder."""

import os

from pyspark.sql import functions as F
from quarrystone.llm import _shared
from quarrystone.sources.shared import own_folder


def test_written_scratch_and_forgotten(spark):
    df = _shared.written(spark.range(5), "test")
    assert df.count() == 5 and df.columns == ["id"]
    folder = own_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with _shared.scratch(spark):
        kept = _shared.keep(spark, "kept")
        inner = _shared.written(df, "inner")
        inner.write.parquet(kept)
        assert len(set(os.listdir(folder)) - before) == 2
    assert {os.path.basename(kept)} == set(os.listdir(folder)) - before and spark.read.parquet(kept).count() == 5
    _shared.forget(spark)
    assert not os.path.exists(folder)
    assert _shared.written(spark.range(3), "again").count() == 3


def test_broadcasts_are_measured(spark, monkeypatch):
    plan = lambda: spark.range(1000).join(_shared.checked_broadcast(spark.range(10), F.lit(100)), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 999)
    assert "strategy=broadcast" not in plan()


def test_scopes_of_two_threads_are_apart(spark):
    import threading

    inside, go_on = threading.Event(), threading.Event()
    kept = []

    def other():
        kept.append(_shared.written(spark.range(3), "other"))
        inside.set()
        go_on.wait(60)

    t = threading.Thread(target=other)
    with _shared.scratch(spark):
        t.start()
        inside.wait(60)
        mine = _shared.written(spark.range(2), "mine").inputFiles()
    go_on.set()
    t.join()
    assert kept[0].count() == 3 and not os.path.exists(mine[0].removeprefix("file://"))
