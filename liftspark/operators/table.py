"""The relational surface as methods of one class over a DataFrame.

Choices where engines differ: ``stddev`` is that of the population (ddof 0);
``explode`` keeps rows whose list is null or empty; ``drop_nan`` keeps nulls;
sorting puts nulls last; ``union`` drops repeated rows, ``concat`` and
``union_all`` don't. A deferred function call may stand wherever a column
may; it stays as it was lowered under joins, unions and groupings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import ops
from ..sources import io


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Table:
    def __init__(self, df: DataFrame):
        self.df = df

    def _on(self, df: DataFrame) -> Table:
        return Table(ops._next(self.df, df, []))

    def _resolved(self, expressions) -> list[Column]:
        decided: list = []
        out = [ops.resolve(self.df, e, decided) for e in expressions]
        if decided:
            ops._next(self.df, self.df, decided)
        return out

    # lowered operations

    def where(self, predicate) -> Table:
        return Table(ops.where(self.df, predicate))

    filter = where

    def select(self, *columns, **projections) -> Table:
        return Table(ops.select(self.df, *columns, **projections))

    def with_columns(self, columns: dict) -> Table:
        return Table(ops.with_columns(self.df, columns))

    def with_column(self, name: str, expression) -> Table:
        return self.with_columns({name: expression})

    # one table

    def __getitem__(self, key):
        return self.df[key] if isinstance(key, (str, int)) else self._on(self.df.select(*key))

    def agg(self, *aggregates) -> Table:
        return self._on(self.df.agg(*self._resolved(aggregates)))

    def agg_list(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.collect_list(c).alias(c) for c in columns]))

    def agg_set(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.collect_set(c).alias(c) for c in columns]))

    def agg_concat(self, *columns: str) -> Table:
        """Lists are joined to one list, strings to one string."""
        kinds = dict(self.df.dtypes)
        return self._on(self.df.agg(*[(F.array_join(F.collect_list(c), "") if kinds[c] == "string" else F.flatten(F.collect_list(c))).alias(c) for c in columns]))

    def any_value(self, *columns: str, ignore_nulls: bool = False) -> Table:
        return self._on(self.df.agg(*[F.any_value(c, F.lit(ignore_nulls)).alias(c) for c in columns]))

    def count(self, *columns: str) -> Table:
        return self._on(self.df.agg(*([F.count(c).alias(c) for c in columns] or [F.count(F.lit(1)).alias("count")])))

    def max(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.max(c).alias(c) for c in columns]))

    def min(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.min(c).alias(c) for c in columns]))

    def mean(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.avg(c).alias(c) for c in columns]))

    def sum(self, *columns: str) -> Table:
        return self._on(self.df.agg(*[F.sum(c).alias(c) for c in columns]))

    def stddev(self, *columns: str, ddof: int = 0) -> Table:
        f = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
        return self._on(self.df.agg(*[f(c).alias(c) for c in columns]))

    def describe(self) -> Table:
        """Name and type of each column."""
        return self._on(self.df.sparkSession.createDataFrame(self.df.dtypes, "column string, type string"))

    def summarize(self) -> Table:
        """A row per column: type, least, greatest, rows, nulls, approximate number of distinct values. One pass."""
        rows = []
        for name, kind in self.df.dtypes:
            c = F.col(f"`{name}`")
            text = c.cast("string") if kind.startswith(("array", "map", "struct")) else c
            rows.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.min(text).cast("string").alias("min"), F.max(text).cast("string").alias("max"), F.count(F.lit(1)).alias("count"), F.count(F.when(c.isNull(), 1)).alias("count_nulls"), F.approx_count_distinct(text).alias("approx_count_distinct")))
        return self._on(self.df.agg(F.array(*rows).alias("r")).select(F.inline("r")))

    def distinct(self, *columns: str) -> Table:
        return self._on(self.df.dropDuplicates(list(columns)) if columns else self.df.distinct())

    drop_duplicates = unique = distinct

    def drop_nan(self, *columns: str) -> Table:
        names = columns or [n for n, t in self.df.dtypes if t in ("float", "double")]
        df = self.df
        for n in names:
            df = df.where(~F.isnan(n) | F.col(n).isNull())
        return self._on(df)

    def drop_null(self, *columns: str) -> Table:
        return self._on(self.df.na.drop(subset=list(columns) or None))

    def exclude(self, *columns: str) -> Table:
        return self._on(self.df.drop(*columns))

    def explode(self, *columns: str) -> Table:
        """Lists of equal length side by side become rows."""
        if len(columns) == 1:
            return self._on(self.df.withColumn(columns[0], F.explode_outer(columns[0])))
        z = self.df.withColumn("__z", F.explode_outer(F.arrays_zip(*columns)))
        return self._on(z.select(*[F.col(f"__z.{c}").alias(c) if c in columns else F.col(c) for c in self.df.columns]))

    def into_batches(self, size: int) -> Table:
        """No change of rows: batches of Python functions are bounded by the session's setting, which this sets."""
        self.df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        return self

    def into_partitions(self, n: int, shuffle: bool = True) -> Table:
        """n partitions of even size; without a shuffle at most as many as there are."""
        return self._on(self.df.repartition(n) if shuffle else self.df.coalesce(n))

    def repartition(self, n: int | None, *columns) -> Table:
        return self._on(self.df.repartition(*([n] if n else []), *columns))

    def limit(self, n: int) -> Table:
        return self._on(self.df.limit(n))

    def offset(self, n: int) -> Table:
        return self._on(self.df.offset(n))

    def sample(self, fraction: float, with_replacement: bool = False, seed: int | None = None) -> Table:
        return self._on(self.df.sample(with_replacement, fraction, seed))

    def sort(self, *columns, desc: bool | list[bool] = False, nulls_first: bool = False) -> Table:
        flags = desc if isinstance(desc, list) else [desc] * len(columns)
        order = [getattr(_col(c), f"{'desc' if d else 'asc'}_nulls_{'first' if nulls_first else 'last'}")() for c, d in zip(columns, flags, strict=True)]
        return self._on(self.df.orderBy(*order))

    def unpivot(self, ids: list[str], values: list[str], variable_name: str = "variable", value_name: str = "value") -> Table:
        return self._on(self.df.unpivot(ids, values, variable_name, value_name))

    melt = unpivot

    def pivot(self, group_by: list[str], pivot: str, value: str, aggregate: str, names: list) -> Table:
        """One column per name; with the names given no extra pass looks for them."""
        return self._on(self.df.groupBy(*group_by).pivot(pivot, names).agg(getattr(F, aggregate)(value)))

    def with_column_renamed(self, old: str, new: str) -> Table:
        return self._on(self.df.withColumnRenamed(old, new))

    def with_columns_renamed(self, names: dict[str, str]) -> Table:
        return self._on(self.df.withColumnsRenamed(names))

    def groupby(self, *columns) -> Grouped:
        return Grouped(self, self._resolved(columns))

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    transform = pipe

    # two tables

    def join(self, other: Table, on=None, how: str = "inner", left_on=None, right_on=None) -> Table:
        """inner, left, right, outer, semi, anti, cross; the physical join is the optimizer's choice."""
        if how == "cross":
            return self._on(self.df.crossJoin(other.df))
        if left_on is not None:
            lefts, rights = ([x] if isinstance(x, str) else x for x in (left_on, right_on))
            condition = None
            for a, b in zip(lefts, rights, strict=True):
                c = self.df[a] == other.df[b]
                condition = c if condition is None else condition & c
            on = condition
        return self._on(self.df.join(other.df, on, {"semi": "left_semi", "anti": "left_anti", "outer": "full_outer"}.get(how, how)))

    def concat(self, other: Table) -> Table:
        return self._on(self.df.unionAll(other.df))

    union_all = concat

    def union(self, other: Table) -> Table:
        return self._on(self.df.union(other.df).distinct())

    def union_all_by_name(self, other: Table) -> Table:
        return self._on(self.df.unionByName(other.df, allowMissingColumns=True))

    def union_by_name(self, other: Table) -> Table:
        return self._on(self.df.unionByName(other.df, allowMissingColumns=True).distinct())

    def intersect(self, other: Table) -> Table:
        return self._on(self.df.intersect(other.df))

    def intersect_all(self, other: Table) -> Table:
        return self._on(self.df.intersectAll(other.df))

    def except_distinct(self, other: Table) -> Table:
        return self._on(self.df.subtract(other.df))

    def except_all(self, other: Table) -> Table:
        return self._on(self.df.exceptAll(other.df))

    # results

    def __len__(self) -> int:
        return self.df.count()

    count_rows = __len__

    def collect(self) -> list[Row]:
        return self.df.collect()

    def show(self, n: int = 8) -> None:
        self.df.show(n)

    def to_pydict(self) -> dict[str, list]:
        return self.to_arrow().to_pydict()

    def to_pylist(self) -> list[dict]:
        return self.to_arrow().to_pylist()

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def iter_rows(self) -> Iterator[dict]:
        for r in self.df.toLocalIterator(prefetchPartitions=True):
            yield r.asDict()

    __iter__ = iter_rows

    def to_arrow_iter(self) -> Iterator[pa.RecordBatch]:
        """Batches, one partition after the other; the caller holds one at a time."""
        schema = self.df.limit(0).toArrow().schema
        packed = self.df.mapInArrow(_packed, "batch binary")
        for r in packed.toLocalIterator():
            yield from pa.ipc.open_stream(r["batch"]).read_all().cast(schema).to_batches()

    def iter_partitions(self) -> Iterator[pa.Table]:
        for b in self.to_arrow_iter():
            yield pa.Table.from_batches([b])

    def write_parquet(self, path: str, **options) -> None:
        io.write(self.df, path, "parquet", **options)

    def write_csv(self, path: str, **options) -> None:
        io.write(self.df, path, "csv", **options)

    def write_json(self, path: str, **options) -> None:
        io.write(self.df, path, "json", **options)

    def write_orc(self, path: str, **options) -> None:
        io.write(self.df, path, "orc", **options)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


class Grouped:
    def __init__(self, table: Table, keys: list[Column]):
        self.table, self.keys = table, keys

    def agg(self, *aggregates) -> Table:
        return self.table._on(self.table.df.groupBy(*self.keys).agg(*self.table._resolved(aggregates)))
