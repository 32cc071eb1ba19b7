"""The relational surface, sources, streaming and the command line."""

import pytest
from pyspark.sql import functions as F

from liftspark.__main__ import main
from liftspark.functions import scalar as s
from liftspark.operators.table import Table
from liftspark.ops import with_columns
from liftspark.sources import io
from liftspark.streaming.stream import through


@pytest.fixture
def table(spark):
    return Table(io.from_pydict(spark, {"k": [1, 2, 2, 3], "v": [1.0, None, 3.0, float("nan")], "g": ["a", "b", "b", None]}, "k int, v double, g string"))


def rows(t):
    return sorted((tuple(r) for r in t.collect()), key=repr)


def test_one_table(table):
    assert len(table) == table.count_rows() == 4
    assert rows(table.drop_nan()) == [(1, 1.0, "a"), (2, 3.0, "b"), (2, None, "b")]
    assert len(table.drop_null()) == 2 and len(table.drop_null("g")) == 3
    assert table.exclude("v").df.columns == ["k", "g"]
    assert rows(table.select("k").distinct()) == [(1,), (2,), (3,)]
    assert rows(table.count("g")) == [(3,)] and rows(table.max("k")) == [(3,)] and rows(table.sum("k")) == [(8,)]
    assert rows(table.select("k").stddev("k")) == [(0.5**0.5,)]
    assert rows(table.select("g").agg_concat("g")) == [("abb",)]
    assert [r["g"] for r in table.sort("g", desc=True).collect()] == ["b", "b", "a", None]
    assert rows(table.describe()) == [("g", "string"), ("k", "int"), ("v", "double")]
    assert {r["column"]: r["count_nulls"] for r in table.summarize().collect()} == {"k": 0, "v": 1, "g": 1}
    assert len(table.into_batches(2).into_partitions(3).repartition(2, "k")) == 4
    assert rows(table.melt(["g"], ["k"]).select("value")) == [(1,), (2,), (2,), (3,)]


def test_explode_keeps_empty_lists(spark):
    t = Table(spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, x array<int>"))
    assert rows(t.explode("x")) == [(1, 1), (1, 2), (2, None), (3, None)]


def test_two_tables(table, spark):
    other = Table(spark.createDataFrame([(2, "x"), (9, "y")], "k int, w string"))
    counts = {how: len(table.join(other, "k", how)) for how in ("inner", "left", "right", "outer", "semi", "anti")}
    assert counts == {"inner": 2, "left": 4, "right": 3, "outer": 5, "semi": 2, "anti": 2}
    assert len(table.join(other, how="cross")) == 8
    a, b = table.select("k"), other.select("k")
    assert [len(getattr(a, n)(b)) for n in ("concat", "union", "intersect", "intersect_all", "except_distinct", "except_all")] == [6, 4, 1, 1, 2, 3]
    assert table.union_by_name(other).df.columns == ["k", "v", "g", "w"]


def test_results(table):
    assert table.select("k").to_pydict() == {"k": [1, 2, 2, 3]}
    assert table.select("k").to_pylist()[0] == {"k": 1}
    assert [r["k"] for r in table.select("k").iter_rows()] == [1, 2, 2, 3]
    assert sum(b.num_rows for b in table.to_arrow_iter()) == 4
    assert list(table.to_pandas()["k"]) == [1, 2, 2, 3]
    assert table.pipe(lambda t, n: t.limit(n), 2).count_rows() == 2


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_sinks(table, spark, tmp_path, kind):
    path = str(tmp_path / kind)
    getattr(table.select("k", "g"), f"write_{kind}")(path)
    assert spark.read.format(kind).schema("k int, g string").load(path).count() == 4


def test_files_without_rows_keep_the_schema(spark, tmp_path):
    df = spark.createDataFrame([(1.0,)], "measurement double")
    df.write.parquet(str(tmp_path / "a"))
    df.where("false").write.parquet(str(tmp_path / "b"))
    both = io.read_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert [r["y"] for r in with_columns(both, {"y": s.affine(F.col("measurement"))}).collect()] == [5.0]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    df.write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), df.schema, lambda d: with_columns(d, {"y": s.affine(F.col("x"))}), str(tmp_path / "out"), str(tmp_path / "ck"))
    through(*args)
    through(*args)  # nothing new
    assert sorted(r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3.0, 5.0, 7.0, 9.0, 11.0]


def test_command_line(capsys):
    assert main(["explain", "liftspark.functions.scalar:affine"]) == 0
    assert '"captured": true' in capsys.readouterr().out
    assert main(["explain", "liftspark.functions.scalar:rounded"]) == 1


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
