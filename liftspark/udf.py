"""The function wrapper: called with columns it gives a deferred call, with values it just runs."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from . import batch, ir
from .capture import Captured, Rejected, capture
from .config import EngineConfig, current
from .lower import Lowering, argument, as_declared
from .types import layout, name_of, to_spark


@dataclass(frozen=True)
class Decision:
    """How one call runs, and why."""

    function: str
    tier: int
    reason: str
    mode: str
    layout: str
    digest: str | None = None


@dataclass(frozen=True)
class Options:
    """As given; those without meaning in Spark (gpus, concurrency, process) are kept and have no effect."""

    return_dtype: object = None
    on_error: str = "raise"
    batch_size: int | None = None
    gpus: int = 0
    is_async: bool = False
    is_batch: bool = False
    is_generator: bool = False
    max_concurrency: int | None = None
    max_retries: int = 0
    unnest: bool = False
    use_process: bool | None = None
    mode: str | None = None
    nulls: str = "call"  # call: None reaches the function; propagate: null in, null out
    deterministic: bool | None = None
    extra: dict = field(default_factory=dict)


class Function:
    """A scalar function with options."""

    def __init__(self, fn: Callable, options: Options):
        self.fn, self.options = fn, options
        self.__name__ = type(fn).__name__  # of partials and other callables
        functools.update_wrapper(self, fn, updated=())

    def __get__(self, instance, owner=None):
        return self if instance is None else Function(self.fn.__get__(instance, owner), self.options)

    def __call__(self, *args, **kwargs):
        if any(isinstance(a, (Column, UdfCall, Expression)) for a in args):
            return UdfCall(self, args, kwargs)
        return self.fn(*args, **kwargs)

    @property
    def dtype(self) -> T.DataType:
        if self.options.return_dtype is None:
            raise TypeError(f"{self.__name__}: return_dtype is missing")
        return to_spark(self.options.return_dtype)


class Expression:
    """Arithmetic over deferred calls, resolved when the frame's schema is known."""

    def __init__(self, build: Callable, parts: tuple):
        self._build, self._parts = build, parts

    def resolve(self, schema: T.StructType, resolve_column: Callable, decided: list) -> Column:
        return self._build(*(p.resolve(schema, resolve_column, decided) if isinstance(p, Expression) else p for p in self._parts))

    def alias(self, name: str) -> Expression:
        return Expression(lambda c: c.alias(name), (self,))

    def cast(self, dtype) -> Expression:
        return Expression(lambda c: c.cast(dtype), (self,))

    def __invert__(self):
        return Expression(lambda c: ~c, (self,))

    def __neg__(self):
        return Expression(lambda c: -c, (self,))


def _operator(name: str):
    def apply(self, other):
        return Expression(lambda a, b: getattr(a, name)(b), (self, other))

    return apply


for _name in ("add", "sub", "mul", "truediv", "mod", "radd", "rsub", "rmul", "rtruediv", "eq", "ne", "lt", "le", "gt", "ge", "and", "or", "rand", "ror"):
    setattr(Expression, f"__{_name}__", _operator(f"__{_name}__"))
Expression.__hash__ = object.__hash__


class UdfCall(Expression):
    """One call with columns and constants."""

    def __init__(self, function: Function, args: tuple, kwargs: dict):
        self.function, self.args, self.kwargs = function, args, kwargs

    def resolve(self, schema: T.StructType, resolve_column: Callable, decided: list) -> Column:
        inner = [a.resolve(schema, resolve_column, decided) if isinstance(a, Expression) else a for a in self.args]
        columns = [a for a in inner if isinstance(a, Column)]
        fields = [resolve_column(c) for c in columns]
        column, decision = plan(self.function, inner, self.kwargs, columns, fields, current())
        decided.append(decision)
        return column


def plan(function: Function, args: list, kwargs: dict, columns: list[Column], fields: list[T.StructField], config: EngineConfig) -> tuple[Column, Decision]:
    """Chooses the tier of a call; the choice is final before anything runs."""
    o = function.options
    mode = config.effective(o.mode)
    dtype = function.dtype
    shape = layout([f.dataType for f in fields], dtype)
    told = f"{getattr(function.fn, '__module__', '')}.{getattr(function.fn, '__qualname__', function.__name__)}"

    def python(tier: int, reason: str, digest: str | None = None) -> tuple[Column, Decision]:
        fn = _with_constants(function.fn, args, kwargs)
        call = batch.settled(fn, dtype, o.on_error, min(o.max_retries, config.policy.max_retries))
        if o.nulls == "propagate":
            inner = call

            def call(*xs):
                return None if any(x is None for x in xs) else inner(*xs)

        decision = Decision(told, tier, reason, mode, shape, digest)
        if tier == 2:
            return batch.batch_function(call, dtype, len(columns), config.policy)(*columns), decision
        return batch.row_function(call, dtype, bool(o.deterministic))(*columns), decision

    if o.is_batch:
        return batch.F.arrow_udf(function.fn, dtype)(*columns), Decision(told, 2, "batch.given", mode, shape)
    if o.is_generator:  # a row for each value; rows without one go
        made = _with_constants(function.fn, args, kwargs)
        listed = batch.row_function(lambda *xs: [batch.normalize_scalar(v, name_of(dtype)) for v in made(*xs)], T.ArrayType(dtype), bool(o.deterministic))
        return batch.F.explode(listed(*columns)), Decision(told, 3, "function.generator", mode, shape)
    if o.is_async:
        import asyncio

        function = Function(lambda *xs, f=function.fn, **k: asyncio.run(f(*xs, **k)), o)
        column, _ = python(3, "function.async")
        return column, Decision(told, 3, "function.async", mode, shape)
    try:
        captured, root = _captured(function, args, kwargs, len(columns), config)
        strict = o.nulls == "call"
        given = [argument(c, f.dataType, f.nullable) for c, f in zip(columns, fields, strict=True)]
        column = as_declared(Lowering(given, strict).lower(root), dtype, strict)
        if o.on_error != "raise":
            raise Rejected("option.on_error")
    except Rejected as e:
        if mode != "auto":
            return python(3, f"mode.{mode}")
        reason = str(e)
        pure = o.deterministic if o.deterministic is not None else batch.is_pure(_bare(function.fn))
        return python(2, reason) if pure else python(3, reason)
    digest = ir.digest(root)
    if mode != "auto":
        return python(3, f"mode.{mode}", digest)
    return column, Decision(told, 1, "lowered", mode, shape, digest)


def _bare(fn):
    from .capture import unwrapped

    try:
        fn = unwrapped(fn)[0]
    except Rejected:
        pass
    return getattr(fn, "__func__", fn)


def _captured(function: Function, args: list, kwargs: dict, n: int, config: EngineConfig) -> tuple[Captured, ir.Node]:
    import inspect

    try:
        names = [p for p in inspect.signature(function.fn).parameters]
    except (TypeError, ValueError):
        raise Rejected("function.opaque") from None
    constants = {names[i]: a for i, a in enumerate(args) if not isinstance(a, Column) and i < len(names)} | kwargs
    captured = capture(function.fn, config.policy, n, constants)
    return captured, captured.root


def _with_constants(fn: Callable, args: list, kwargs: dict) -> Callable:
    places = [i for i, a in enumerate(args) if isinstance(a, Column)]
    if places == list(range(len(args))) and not kwargs:
        return fn
    fixed = [None if isinstance(a, Column) else a for a in args]

    def call(*xs):
        given = list(fixed)
        for i, x in zip(places, xs, strict=True):
            given[i] = x
        return fn(*given, **kwargs)

    return call


def func(fn: Callable | None = None, **options):
    """Decorator, with or without options (see Options)."""
    known = {k: v for k, v in options.items() if k in Options.__dataclass_fields__}
    extra = {k: v for k, v in options.items() if k not in known}
    o = Options(**known, extra=extra)
    if o.on_error not in ("raise", "null"):
        raise ValueError("on_error is raise or null")
    if o.nulls not in ("call", "propagate"):
        raise ValueError("nulls is call or propagate")
    return Function(fn, o) if fn is not None else lambda f: Function(f, o)


__all__ = ["Decision", "Expression", "Function", "Options", "UdfCall", "func", "name_of", "plan"]
