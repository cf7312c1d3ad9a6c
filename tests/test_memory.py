"""Giving memory back changes no rows; arrays of the shared folder."""

import numpy as np
import pytest

from quillspark.plans.graph import connected_components
from quillspark.plans.memory import frugal


def test_frugal_passes_all_batches(spark):
    def run(batches):
        yield from batches

    rows = spark.range(1000).mapInArrow(frugal(run), "id bigint").collect()
    assert sorted(r.id for r in rows) == list(range(1000))
    assert spark.range(0).mapInArrow(frugal(run), "id bigint").count() == 0


def test_components_after_release(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (4, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)]


def test_arrays_near_and_far(spark, tmp_path, monkeypatch):
    from quillspark.plans import shared
    from quillspark.plans.sharedfiles import ROWS, ArrayStore, array_of, array_row

    def stored(folder):
        monkeypatch.setattr(shared, "shared_dir", lambda _: folder)
        store = ArrayStore(spark, "arrays")

        def put(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from store.put("squares", k, np.arange(k * 1000, dtype=np.uint64) ** 2)
                    yield array_row("facts", k, np.array([k, -k]))

        rows = shared.written(spark.range(4).repartition(2).mapInArrow(put, ROWS))
        store.publish(rows, "squares")

        def read(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(store.get("squares", k).sum()) for k in batch.column(0).to_pylist()], pa.int64())], ["total"])

        assert {r.part: array_of(r.block).tolist() for r in rows.where("name = 'facts'").collect()} == {k: [k, -k] for k in range(4)}
        assert sorted(r.total for r in spark.range(4).mapInArrow(read, "total bigint").collect()) == sorted(int((np.arange(k * 1000) ** 2).sum()) for k in range(4))
        return store

    assert stored(str(tmp_path / "near")).near and stored(f"file://{tmp_path}/near").near
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./shared", f"file://{tmp_path}")
    assert not stored("viewfs://other/shared").near


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quillspark.plans.shared import shared_dir

    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
