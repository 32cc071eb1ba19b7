"""Tiers 2 and 3: functions that stay Python."""

from __future__ import annotations

import ast
import builtins
import inspect
import textwrap
import types
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Policy
from .types import name_of, normalize_scalar

_PURE_BUILTINS = {"abs", "all", "any", "bool", "chr", "dict", "divmod", "enumerate", "filter", "float", "frozenset", "int", "isinstance", "len", "list", "map", "max", "min", "ord", "pow", "range", "repr", "reversed", "round", "set", "sorted", "str", "sum", "tuple", "zip"}
_PURE_MODULES = {"math", "re", "json", "unicodedata", "string", "hashlib", "zlib", "base64", "datetime", "decimal", "fractions", "functools", "itertools", "operator", "urllib.parse", "html"}


_PLAIN = {bool, int, float, complex, str, bytes, tuple, frozenset}
_MUTATORS = {"add", "append", "appendleft", "clear", "discard", "extend", "insert", "pop", "popitem", "put", "remove", "reverse", "send", "setdefault", "sort", "update", "write", "writelines"}


def _own(value: ast.expr | None) -> bool:
    """Whether an expression makes a collection of its own."""
    if isinstance(value, ast.Call):
        return isinstance(value.func, ast.Name) and value.func.id in ("list", "dict", "set", "sorted")
    return isinstance(value, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp))


def is_pure(fn, level: int = 0) -> bool:
    """Whether a function plainly only computes: no stores outside, and calls to known names alone."""
    if isinstance(fn, (types.BuiltinFunctionType, type)):
        return getattr(fn, "__module__", None) in _PURE_MODULES or getattr(builtins, getattr(fn, "__name__", ""), None) is fn and fn.__name__ in _PURE_BUILTINS
    if not isinstance(fn, types.FunctionType) or level > 3:
        return False
    if fn.__module__ in _PURE_MODULES:
        return True
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    except (OSError, TypeError, SyntaxError):
        return False
    local = set(fn.__code__.co_varnames)
    defaults = [*(fn.__defaults__ or ()), *(fn.__kwdefaults__ or {}).values()]
    if not all(v is None or type(v) in _PLAIN for v in defaults):
        return False
    made: dict[str, list[ast.expr | None]] = {}  # what each local name is bound to; None: something unknown
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            made.setdefault(n.id, [])
        if isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    made.setdefault(t.id, []).append(n.value)
    cells = dict(zip(fn.__code__.co_freevars, fn.__closure__ or (), strict=True))
    for n in ast.walk(tree):
        if isinstance(n, (ast.Global, ast.Nonlocal, ast.Yield, ast.YieldFrom, ast.Await, ast.Import, ast.ImportFrom, ast.Delete)):
            return False
        if isinstance(n, (ast.Attribute, ast.Subscript)) and isinstance(n.ctx, ast.Store):
            base = n.value
            if not (isinstance(base, ast.Name) and base.id in local):
                return False
        if isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name) and f.id in local or not isinstance(f, (ast.Name, ast.Attribute)):
                return False  # whatever it is bound to may have effects
            if isinstance(f, ast.Attribute) and f.attr in _MUTATORS and isinstance(f.value, ast.Name) and f.value.id in local and not all(map(_own, made.get(f.value.id) or [None])):
                return False  # what it changes may be known outside
            while isinstance(f, ast.Attribute):
                f = f.value
            if isinstance(f, ast.Name) and f.id not in local:
                target = cells[f.id].cell_contents if f.id in cells else fn.__globals__.get(f.id, getattr(builtins, f.id, None))
                if isinstance(n.func, ast.Name):
                    if not (is_pure(target, level + 1) or any(d is n for d in getattr(tree.body[0], "decorator_list", []))):
                        return False
                elif isinstance(target, types.ModuleType):
                    if target.__name__ not in _PURE_MODULES:
                        return False
                elif not isinstance(target, (str, bytes, tuple, frozenset, dict, type)) and type(target).__module__ != "re":
                    return False
    return True


def settled(fn: Callable, dtype: T.DataType, on_error: str = "raise", max_retries: int = 0) -> Callable:
    """The function with its result's type contract, retries, and null for errors where asked for."""
    name = name_of(dtype)

    def call(*args):
        for left in range(max_retries, -1, -1):
            try:
                return normalize_scalar(fn(*args), name)
            except Exception:
                if left == 0:
                    if on_error == "null":
                        return None
                    raise

    return call


def profitable(unique: int, rows: int, capacity: int) -> bool:
    """Whether evaluating distinct values only is worth it."""
    return 0 < unique <= capacity and 2 * unique <= rows


def over_domain(fn: Callable, column: pa.Array, out: pa.DataType, capacity: int) -> pa.Array:
    """fn over a column, called once per distinct value, in order of first occurrence, if that pays."""
    if column.null_count == 0 and len(column):
        encoded = pc.dictionary_encode(column)
        if profitable(len(encoded.dictionary), len(column), capacity):
            return pa.array([fn(v) for v in encoded.dictionary.to_pylist()], type=out).take(encoded.indices)
    return pa.array([fn(v) for v in column.to_pylist()], type=out)


def batch_function(fn: Callable, dtype: T.DataType, n_args: int, policy: Policy):
    """Tier 2: an Arrow function over whole batches; strings of one column by their distinct values."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = to_arrow_type(dtype)
    capacity = policy.dictionary_capacity

    def run(*columns: pa.Array) -> pa.Array:
        if len(columns) == 1 and (pa.types.is_string(columns[0].type) or pa.types.is_large_string(columns[0].type)):
            return over_domain(fn, columns[0], out, capacity)
        return pa.array([fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type=out)

    if n_args == 1:

        def batched(a: pa.Array) -> pa.Array:
            return run(a)
    elif n_args == 2:

        def batched(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:

        def batched(*columns: pa.Array) -> pa.Array:
            return run(*columns)

    batched.__name__ = getattr(fn, "__name__", "batched")
    return F.arrow_udf(batched, dtype)


def row_function(fn: Callable, dtype: T.DataType, deterministic: bool):
    """Tier 3: a row function; one that may have effects is never evaluated twice for a row."""
    u = F.udf(fn, dtype)
    return u if deterministic else u.asNondeterministic()
