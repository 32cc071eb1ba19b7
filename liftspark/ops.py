"""where, select and with_columns over expressions that hold deferred calls."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .udf import Decision, Expression, UdfCall

_decisions: weakref.WeakKeyDictionary[DataFrame, list[Decision]] = weakref.WeakKeyDictionary()


def decisions(df: DataFrame) -> list[Decision]:
    """Decisions taken for a frame by the operations below, and for those it came from."""
    return list(_decisions.get(df, []))


def resolve(df: DataFrame, expression, decided: list[Decision]) -> Column:
    """A column of df; types of arguments come from df's own schema."""
    if isinstance(expression, str):
        return F.col(expression)
    if not isinstance(expression, Expression):
        return expression

    def field(column: Column) -> T.StructField:
        return df.select(column).schema[0]

    return expression.resolve(df.schema, field, decided)


def _next(df: DataFrame, out: DataFrame, decided: list[Decision]) -> DataFrame:
    _decisions[out] = [*_decisions.get(df, []), *decided]
    return out


def where(df: DataFrame, predicate) -> DataFrame:
    decided: list[Decision] = []
    return _next(df, df.where(resolve(df, predicate, decided)), decided)


def _named(column: Column, expression) -> Column:
    """A bare call is named after its function."""
    return column.alias(expression.function.__name__) if isinstance(expression, UdfCall) else column


def select(df: DataFrame, *columns, **projections) -> DataFrame:
    decided: list[Decision] = []
    out = [_named(resolve(df, c, decided), c) for c in columns]
    out += [resolve(df, c, decided).alias(k) for k, c in projections.items()]
    selected = df.select(*out)
    for c in (*columns, *projections.values()):
        if isinstance(c, UdfCall) and c.function.options.unnest:
            name = next((k for k, v in projections.items() if v is c), c.function.__name__)
            selected = selected.select(*[x for x in selected.columns if x != name], f"{name}.*")
    return _next(df, selected, decided)


def with_columns(df: DataFrame, columns: dict) -> DataFrame:
    decided: list[Decision] = []
    return _next(df, df.withColumns({k: resolve(df, v, decided) for k, v in columns.items()}), decided)


def with_column(df: DataFrame, name: str, expression) -> DataFrame:
    return with_columns(df, {name: expression})
