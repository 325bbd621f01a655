"""NumPy files by byte ranges, and sweeps that are stopped and run again."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiosift.operators.terms import Term
from ratiosift.plans import simulate, sweep
from ratiosift.sources import numpy_files, scratch, tables


def _read(spark, path, **options):
    numpy_files.register(spark)
    return spark.read.format("numpy").options(**options).load(f"file://{path}")


def _values(df):
    return np.array([r.row for r in df.orderBy("at").collect()])


@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2", "|b1", "|u1"])
@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("shape", [(1000, 7), (1000,), (90, 3, 4)])
def test_ranges_of_a_file(spark, tmp_path, kind, order, shape):
    x = np.asarray(np.random.default_rng(0).normal(0, 50, shape).astype(kind), order=order)
    np.save(tmp_path / "x.npy", x)
    df = _read(spark, tmp_path / "x.npy", split=500)
    assert df.rdd.getNumPartitions() > 1 and df.agg(F.countDistinct("at")).first()[0] == len(x)
    np.testing.assert_array_equal(_values(df), x.reshape(len(x), -1).astype(float))


def test_a_task_holds_a_batch_not_the_file(spark, tmp_path, monkeypatch):
    """A file of 200 MB in ranges of 20 MB; a task reads it 4 MB at a time, whatever the range."""
    x = np.lib.format.open_memmap(tmp_path / "big.npy", "w+", "<f8", (500_000, 50))
    x[:, 0] = np.arange(500_000)
    x.flush()
    df = _read(spark, tmp_path / "big.npy", split=20 << 20)
    assert df.rdd.getNumPartitions() == 10
    row = df.agg(F.sum(F.col("row")[0]), F.count("*"), F.max("at")).first()
    assert tuple(row) == (500_000 * 499_999 / 2, 500_000, 499_999)
    sizes = [n.nbytes for _, n in numpy_files._rows(f"file://{tmp_path}/big.npy", numpy_files.NumpyReader(f"file://{tmp_path}/big.npy", None, 1 << 40).partitions()[0])]
    assert max(sizes) <= numpy_files.BATCH and sum(sizes) == 200_000_000


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_of_an_archive(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    x, y, extra = rng.normal(size=(300, 3)), rng.normal(size=300), np.asfortranarray(rng.normal(size=(40, 3)))
    save(tmp_path / "a.npz", X=x, y=y, X_unlabeled=extra, names=np.array(["a", "b"]))
    df = _read(spark, tmp_path / "a.npz", names="X,X_unlabeled", split=1000)
    assert (df.where("part = 'X'").rdd.getNumPartitions() > 5) == (save is np.savez)
    np.testing.assert_array_equal(_values(df.where("part = 'X'")), x)
    np.testing.assert_array_equal(_values(df.where("part = 'X_unlabeled'")), extra)
    got = tables.read_npz(spark, str(tmp_path / "a.npz"))
    assert got.counts() == {"n_labeled": 300, "n_unlabeled": 40, "n_features": 3}
    rows = got.data.where("y is not null").orderBy("row_id").select("x0", "x1", "x2", "y").toPandas().to_numpy()
    np.testing.assert_array_equal(rows, np.column_stack((x, y)))


def test_what_is_no_numbers_is_refused(spark, tmp_path):
    np.save(tmp_path / "s.npy", np.array(["a"]))
    np.save(tmp_path / "n.npy", np.array(3.0))
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    for name in ("s", "n"):
        with pytest.raises(Exception, match="no rows of numbers"):
            _read(spark, tmp_path / f"{name}.npy").count()
    assert _read(spark, tmp_path / "e.npy").count() == 0


def _trials(spark):
    rows = simulate.uniform_features(spark.range(480).withColumnRenamed("id", "row_id"), "row_id", 2, 1)
    rows = simulate.planted(rows, "row_id", 2, [Term((0,), (1,))], [1.0], 0.1, 1)
    return rows.withColumn("config_id", (F.col("row_id") % 6).cast("int")).withColumn("trial", (F.floor(F.col("row_id") / 6) % 2).cast("int"))


def test_a_sweep_that_is_stopped_goes_on(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "trials"), _trials(spark)
    go = lambda: sweep.run_into(path, rows, ["config_id", "trial"], ["x0", "x1"], "y", [Term((0,), (1,))], ["poly_omp", "poly_lasso"], batches=3, degree=1)
    written, write = [], tables.write_records

    def stops(df, where, by="config_id"):
        if len(written) == 2:
            raise RuntimeError("stopped")
        written.append(where)
        write(df, where, by)

    monkeypatch.setattr(tables, "write_records", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        go()
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "trials").rglob("*.parquet")}
    assert {p.parent.name for p in first} == {f"config_id={k}" for k in (0, 1, 3, 4)}
    monkeypatch.setattr(tables, "write_records", write)
    out = go()
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())  # nothing was fitted again
    found = out.groupBy("config_id", "trial", "method").count().collect()
    assert len(found) == 6 * 2 * 2 and all(r["count"] == 1 for r in found)
    again = out.where("config_id = 2")
    tables.write_records(spark.createDataFrame(again.collect(), again.schema), path)  # a repeated write
    assert spark.read.parquet(path).count() == 24
    plan = again._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(config_id" in plan


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_results_with_open_maps(spark, tmp_path):
    """Nested numbers, lists, nulls and texts come back as they were; rows may differ in what they have."""
    empty = {f.name: None for f in tables.OPEN_RESULT.fields}
    given = [
        {"a": 1, "b": [1, None, {"c": 2.5}], "t": 'say "x" \\ \u00fc\n', "deep": {"m": {"k": [[], {}]}}},
        {"a": None, "big": 12345678901234567890123, "small": 1e-300, "yes": True},
        None,
        {},
        {"a": "text where others have a number"},
    ]
    texts = [(str(k), None if g is None else json.dumps(g)) for k, g in enumerate(given)]
    plain = [f for f in tables.OPEN_RESULT.fields if f.name not in ("method", "params", "extra")]
    df = spark.createDataFrame(texts, "method string, j string").select("method", *(F.lit(empty[f.name]).cast(f.dataType).alias(f.name) for f in plain), F.parse_json("j").alias("params"), F.lit(None).cast("variant").alias("extra"))
    tables.write_json(df, str(tmp_path / "r"))
    back = tables.read_open_json(spark, str(tmp_path / "r"))
    assert back.schema["extra"].dataType == df.schema["extra"].dataType
    got = back.orderBy("method").select(F.to_json("params").alias("p"), "extra").collect()
    assert [None if r.p is None else json.loads(r.p) for r in got] == given and all(r.extra is None for r in got)


def test_columns_become_entries(spark):
    df = spark.createDataFrame([(1, 0.5, [1, None], None), (2, math.nan, None, "z"), (3, None, None, None)], "id int, alpha double, l array<int>, note string")
    out = tables.with_open(df, params=["alpha", "l"], extra=["note"])
    got = out.orderBy("id").select("id", F.to_json("params").alias("p"), F.to_json("extra").alias("e")).collect()
    assert [tuple(r) for r in got] == [(1, '{"alpha":0.5,"l":[1,null]}', None), (2, None, '{"note":"z"}'), (3, None, None)]
    assert tables.with_open(df.limit(0), params=["alpha"]).count() == 0
    with pytest.raises(ValueError, match="note"):
        tables.with_open(df, note=["alpha"])
