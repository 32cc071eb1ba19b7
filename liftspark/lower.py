"""Expressions to Catalyst columns, with Python's meaning.

Where Spark's operator differs from Python's, the column says what Python
does: comparisons with NaN, truth of a NaN, white space, a missing element,
a sum of floats, and None where a value is needed (an error whose text
carries Python's). Conditional parts stay under ``when``, so that what may
raise is evaluated only where Python would.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ir
from .capture import Rejected
from .types import name_of
from .unicode_tables import WHITE, WHITE_CLASS, without_property

NUMERIC = ("int64", "float64")
_NULL = "null"


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str  # bool int64 float64 string bytes null array<..> or another Spark type
    nullable: bool
    dtype: T.DataType


def _spark(kind: str) -> T.DataType:
    return {"bool": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), _NULL: T.NullType()}[kind]


def _typed(column: Column, kind: str, nullable: bool = False) -> Typed:
    return Typed(column, kind, nullable, _spark(kind))


def argument(column: Column, dtype: T.DataType, nullable: bool) -> Typed:
    """A column as a Python function gets it: every int is 64 bits wide, every float double."""
    kind = name_of(dtype)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return _typed(column.cast("long"), "int64", nullable)
    if isinstance(dtype, T.FloatType):
        return _typed(column.cast("double"), "float64", nullable)
    if kind in ("bool", "int64", "float64", "string", "bytes"):
        return _typed(column, kind, nullable)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return Typed(column, kind, nullable, dtype)
    raise Rejected(f"type.{kind}")


class Lowering:
    """Lowers one expression over given arguments. ``strict``: None where a value is needed raises, as in Python; else it gives null."""

    def __init__(self, arguments: list[Typed], strict: bool = True):
        self.arguments, self.strict = arguments, strict
        self.present: frozenset[ir.Node] = frozenset()  # known not to be None here

    def lower(self, node: ir.Node) -> Typed:
        t = getattr(self, f"_{type(node).__name__.lower()}")(node)
        return Typed(t.column, t.kind, False, t.dtype) if node in self.present else t

    # None

    def _need(self, t: Typed, doing: str) -> Typed:
        """The value, or Python's error where it is None."""
        if t.kind == _NULL:
            raise Rejected("type.none")
        if not t.nullable or not self.strict:
            return t
        error = F.raise_error(F.lit(f"TypeError: {doing}: 'NoneType'")).cast(t.dtype)
        return Typed(F.coalesce(t.column, error), t.kind, False, t.dtype)

    def _nulls(self, *ts: Typed) -> bool:
        return not self.strict and any(t.nullable for t in ts)

    # leaves

    def _arg(self, node: ir.Arg) -> Typed:
        return self.arguments[node.index]

    def _const(self, node: ir.Const) -> Typed:
        v = node.value
        if v is None:
            return _typed(F.lit(None), _NULL, True)
        kind = {bool: "bool", int: "int64", float: "float64", str: "string", bytes: "bytes"}.get(type(v))
        if kind is None:
            raise Rejected("constant.type")
        return _typed(F.lit(bytearray(v)) if kind == "bytes" else F.lit(v).cast(_spark(kind)), kind)

    # numbers

    def _widened(self, node_a: ir.Node, node_b: ir.Node, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """An int beside a float becomes one; only constants and counts, which are exact, do so."""
        if {a.kind, b.kind} == {"int64", "float64"}:
            for node, t in ((node_a, a), (node_b, b)):
                if t.kind == "int64" and not (isinstance(node, ir.Const) and abs(node.value) <= 2**53 or isinstance(node, (ir.Reduce,)) or isinstance(node, ir.Call) and node.model == "len"):
                    raise Rejected("type.mixed")
            a, b = (t if t.kind == "float64" else _typed(t.column.cast("double"), "float64", t.nullable) for t in (a, b))
        return a, b

    def _binary(self, node: ir.Binary) -> Typed:
        a, b = self._need(self.lower(node.left), node.op), self._need(self.lower(node.right), node.op)
        if node.op == "add" and a.kind == b.kind in ("string", "bytes"):
            return _typed(F.concat(a.column, b.column), a.kind, self._nulls(a, b))
        if node.op == "truediv" and a.kind == b.kind == "int64":
            return _typed(a.column.cast("double") / b.column.cast("double"), "float64", self._nulls(a, b))
        a, b = self._widened(node.left, node.right, a, b)
        if a.kind != b.kind or a.kind not in NUMERIC:
            raise Rejected(f"type.{node.op}")
        x, y = a.column, b.column
        if node.op == "mod":
            if a.kind != "int64":
                raise Rejected("type.mod")
            column = ((x % y) + y) % y  # the sign of the divisor, as in Python
        else:
            column = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "truediv": lambda: x / y}[node.op]()
        return _typed(column, a.kind, self._nulls(a, b))

    def _negate(self, node: ir.Negate) -> Typed:
        a = self._need(self.lower(node.value), "negate")
        if a.kind not in NUMERIC:
            raise Rejected("type.negate")
        return _typed(-a.column, a.kind, self._nulls(a))

    # truth

    def _of_integers(self, node: ir.Node) -> bool:
        """A quotient of two integers is never NaN: a divisor of 0 is an error."""
        return isinstance(node, ir.Binary) and node.op == "truediv" and self.lower(node.left).kind == self.lower(node.right).kind == "int64"

    def _compare(self, node: ir.Compare) -> Typed:
        a, b = self.lower(node.left), self.lower(node.right)
        if node.op not in ("eq", "ne"):
            a, b = self._need(a, "compare"), self._need(b, "compare")
        elif a.kind == _NULL or b.kind == _NULL:
            raise Rejected("compare.none")
        if {a.kind, b.kind} == {"int64", "float64"}:
            a, b = self._widened(node.left, node.right, a, b)
        if a.kind != b.kind or a.kind not in ("bool", "int64", "float64", "string", "bytes"):
            raise Rejected("type.compare")
        x, y = a.column, b.column
        column = {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y}[node.op]()
        if a.kind == "float64":
            real = [~F.isnan(t.column) for n, t in ((node.left, a), (node.right, b)) if not (isinstance(n, ir.Const) and not math.isnan(n.value) or self._of_integers(n))]
            for r in real:
                column = (~r | column) if node.op == "ne" else (r & column)
        if node.op in ("eq", "ne") and self.strict and (a.nullable or b.nullable):
            # None equals None alone.
            same = F.coalesce(column, F.lit(node.op == "ne") if not (a.nullable and b.nullable) else (a.column.isNull() & b.column.isNull()) == F.lit(node.op == "eq"))
            return _typed(same, "bool")
        return _typed(column, "bool", self._nulls(a, b))

    def _isnone(self, node: ir.IsNone) -> Typed:
        return _typed(self.lower(node.value).column.isNull(), "bool")

    def _not(self, node: ir.Not) -> Typed:
        a = self.lower(node.value)
        if a.kind != "bool":
            raise Rejected("type.not")
        return _typed(~a.column, "bool", a.nullable)

    def _truth(self, node: ir.Truth) -> Typed:
        a = self.lower(node.value)
        if a.kind == "bool":
            column = a.column
        elif a.kind == "int64":
            column = a.column != 0
        elif a.kind == "float64":
            column = F.isnan(a.column) | (a.column != 0.0)
        elif a.kind in ("string", "bytes"):
            column = F.octet_length(a.column) > 0
        elif isinstance(a.dtype, (T.ArrayType, T.MapType)):
            column = F.size(a.column) > 0
        else:
            raise Rejected("type.truth")
        return _typed(F.coalesce(column, F.lit(False)) if a.nullable else column, "bool")  # None is false

    def _select(self, node: ir.Select) -> Typed:
        c = self.lower(node.condition)
        before = self.present
        yes_known, no_known = _known(node.condition)
        self.present = before | yes_known
        a = self.lower(node.yes)
        self.present = before | no_known
        b = self.lower(node.no)
        self.present = before
        if a.kind != b.kind and _NULL not in (a.kind, b.kind):
            raise Rejected("type.select")
        t = b if a.kind == _NULL else a
        condition = F.coalesce(c.column, F.lit(False)) if c.nullable else c.column
        column = F.when(condition, a.column.cast(t.dtype) if a.kind == _NULL else a.column).otherwise(b.column.cast(t.dtype) if b.kind == _NULL else b.column)
        return Typed(column, t.kind, a.nullable or b.nullable, t.dtype)

    def _oneof(self, node: ir.OneOf) -> Typed:
        a = self.lower(node.value)
        if a.kind != ("string" if isinstance(node.options[0], str) else "int64"):
            raise Rejected("type.contains")
        column = a.column.isin(*node.options)
        return _typed(F.coalesce(column, F.lit(False)) if a.nullable else column, "bool")

    def _cast(self, node: ir.Cast) -> Typed:
        if node.target == "bool":
            return self._truth(ir.Truth(node.value))
        a = self._need(self.lower(node.value), node.target)
        pair = (a.kind, node.target)
        if pair in (("int64", "int"), ("float64", "float"), ("string", "str")):
            return a
        if pair in (("bool", "int"), ("float64", "int")):
            return _typed(a.column.cast("long"), "int64", self._nulls(a))
        if pair in (("int64", "float"), ("bool", "float")):
            return _typed(a.column.cast("double"), "float64", self._nulls(a))
        if pair == ("int64", "str"):
            return _typed(a.column.cast("string"), "string", self._nulls(a))
        if pair == ("bool", "str"):
            return _typed(F.when(a.column, "True").when(~a.column, "False"), "string", self._nulls(a))
        raise Rejected(f"cast.{a.kind}.{node.target}")  # Spark writes floats and reads numbers differently

    # structure

    def _field(self, node: ir.Field) -> Typed:
        a = self._need(self.lower(node.value), "field")
        if isinstance(a.dtype, T.StructType):
            if node.key not in a.dtype.names:
                raise Rejected("field.absent")
            f = a.dtype[node.key]
            return argument(a.column.getField(node.key), f.dataType, f.nullable)
        if isinstance(a.dtype, T.MapType):
            return self._element(a, F.lit(node.key), a.dtype.valueType, a.dtype.valueContainsNull, node.key)
        raise Rejected("type.field")

    def _element(self, a: Typed, key: Column, dtype: T.DataType, nullable: bool, told: str) -> Typed:
        found = F.when(F.map_contains_key(a.column, key), F.try_element_at(a.column, key)).otherwise(F.raise_error(F.lit(f"KeyError: {told!r}")).cast(dtype))
        return argument(found, dtype, nullable)

    def _lookup(self, node: ir.Lookup) -> Typed:
        a, k = self._need(self.lower(node.value), "index"), self._need(self.lower(node.key), "index")
        if isinstance(a.dtype, T.MapType):
            if name_of(a.dtype.keyType) != k.kind:
                raise Rejected("type.lookup")
            return self._element(a, k.column, a.dtype.valueType, a.dtype.valueContainsNull, "key")
        if k.kind != "int64":
            raise Rejected("type.lookup")
        size = F.length(a.column) if a.kind == "string" else F.size(a.column)
        inside = (k.column >= -size) & (k.column < size)
        place = F.when(k.column < 0, k.column + size).otherwise(k.column) + 1
        if a.kind == "string":
            return _typed(F.when(inside, F.substring(a.column, place.cast("int"), F.lit(1))).otherwise(F.raise_error(F.lit("IndexError: string index out of range")).cast("string")), "string", self._nulls(a, k))
        if isinstance(a.dtype, T.ArrayType):
            e = a.dtype.elementType
            return argument(F.when(inside, F.try_element_at(a.column, place.cast("int"))).otherwise(F.raise_error(F.lit("IndexError: list index out of range")).cast(e)), e, a.dtype.containsNull)
        raise Rejected("type.lookup")

    def _maketuple(self, node: ir.MakeTuple) -> Typed:
        ts = [self.lower(x) for x in node.items]
        if not ts or any(t.kind == _NULL for t in ts):
            raise Rejected("type.tuple")
        names = [f"_{i + 1}" for i in range(len(ts))]
        dtype = T.StructType([T.StructField(n, t.dtype) for n, t in zip(names, ts, strict=True)])
        return Typed(F.struct(*[t.column.alias(n) for t, n in zip(ts, names, strict=True)]), dtype.simpleString(), False, dtype)

    def _makelist(self, node: ir.MakeList) -> Typed:
        ts = [self.lower(x) for x in node.items]
        if not ts or len({t.kind for t in ts}) != 1 or ts[0].kind == _NULL:
            raise Rejected("type.list")
        dtype = T.ArrayType(ts[0].dtype)
        return Typed(F.array(*[t.column for t in ts]), dtype.simpleString(), False, dtype)

    # text

    def _call(self, node: ir.Call) -> Typed:
        a, *rest = [self._need(self.lower(x), node.model) for x in node.args]
        nulls = self._nulls(a, *rest)
        if node.model == "len":
            if a.kind in ("string", "bytes"):
                return _typed((F.length(a.column) if a.kind == "string" else F.octet_length(a.column)).cast("long"), "int64", nulls)
            if isinstance(a.dtype, (T.ArrayType, T.MapType)):
                return _typed(F.size(a.column).cast("long"), "int64", nulls)
            raise Rejected("type.len")
        if node.model == "abs":
            if a.kind not in NUMERIC:
                raise Rejected("type.abs")
            return _typed(F.abs(a.column), a.kind, nulls)
        if a.kind != "string" or any(r.kind != "string" for r in rest):
            raise Rejected(f"type.{node.model}")
        x = a.column
        if node.model in ("startswith", "endswith", "contains"):
            return _typed({"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[node.model](x, rest[0].column), "bool", nulls)
        column = {"lower": lambda: F.lower(x), "upper": lambda: F.upper(x), "strip": lambda: F.btrim(x, F.lit(WHITE)), "replace": lambda: F.replace(x, rest[0].column, rest[1].column)}[node.model]()
        return _typed(column, "string", nulls)

    def _text(self, node: ir.Node, doing: str) -> Typed:
        a = self._need(self.lower(node), doing)
        if a.kind != "string":
            raise Rejected(f"type.{doing}")
        return a

    def _translate(self, node: ir.Translate) -> Typed:
        a = self._text(node.text, "translate")
        x = a.column
        if all(len(new) <= 1 for _, new in node.table):
            one = [(k, v) for k, v in node.table if v]
            gone = [k for k, v in node.table if not v]
            x = F.translate(x, "".join(k for k, _ in one) + "".join(gone), "".join(v for _, v in one)) if node.table else x
        else:
            keys = {k for k, _ in node.table}
            if any(c in keys for _, v in node.table for c in v):
                raise Rejected("translate.chain")  # a replacement would be replaced again
            for k, v in node.table:
                x = F.replace(x, F.lit(k), F.lit(v))
        return _typed(x, "string", self._nulls(a))

    def _collapsespace(self, node: ir.CollapseSpace) -> Typed:
        a = self._text(node.text, "sub")
        return _typed(F.btrim(F.regexp_replace(a.column, f"[{WHITE_CLASS}]+", node.by), F.lit(node.by)), "string", self._nulls(a))

    def _regexreplace(self, node: ir.RegexReplace) -> Typed:
        a = self._text(node.text, "sub")
        pattern = f"[{WHITE_CLASS}]+" if node.pattern == r"\s+" else node.pattern
        return _typed(F.regexp_replace(a.column, pattern, node.by.replace("\\", "\\\\").replace("$", "\\$")), "string", self._nulls(a))

    # reductions

    def _reduce(self, node: ir.Reduce) -> Typed:
        a = self._need(self.lower(node.sequence), "iterate")
        nulls = self._nulls(a)
        if a.kind == "string":
            if node.kind != "count":
                raise Rejected("type.sum")
            if node.predicate is None:
                n = F.length(a.column)
            elif isinstance(node.predicate, ir.Property):
                n = F.length(a.column) - F.length(without_property(a.column, node.predicate.name))
            else:
                raise Rejected("type.predicate")
            return self._counted(n.cast("long"), node, nulls)
        if not isinstance(a.dtype, T.ArrayType):
            raise Rejected("type.iterate")
        element = a.dtype.elementType
        kind = "float64" if isinstance(element, (T.FloatType, T.DoubleType)) else "int64" if isinstance(element, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else None
        if kind is None or isinstance(node.predicate, ir.Property):
            raise Rejected("type.element")
        x = F.transform(a.column, lambda e: e.cast(_spark(kind)))
        if a.dtype.containsNull and self.strict:
            none = F.raise_error(F.lit("TypeError: element: 'NoneType'")).cast(x_type := _spark(kind))
            x = F.transform(x, lambda e: F.coalesce(e, none).cast(x_type))
        if node.predicate is not None:
            p = node.predicate
            bound = p.bound
            if type(bound) is bool or kind == "int64" and type(bound) is float or kind == "float64" and type(bound) is int and abs(bound) > 2**53:
                raise Rejected("type.predicate")
            inner = Lowering([], self.strict)

            def passes(e: Column) -> Column:
                inner.arguments = [_typed(e, kind)]
                return inner.lower(ir.Compare(p.op, ir.Arg(0, "x"), ir.Const(float(bound) if kind == "float64" else bound))).column

            x = F.filter(x, passes)
        if node.kind == "count":
            return self._counted(F.size(x).cast("long"), node, nulls)
        start = node.start
        if kind == "int64":
            if type(start) is not int:
                raise Rejected("type.start")
            return _typed(F.aggregate(x, F.lit(start).cast("long"), lambda s, e: s + e), "int64", nulls)
        if type(start) is int and not node.exact:
            raise Rejected("type.start")
        total = self._compensated(x, float(start)) if node.exact else F.aggregate(x, F.lit(float(start)), lambda s, e: s + e)
        if type(start) is int and self.strict:  # the sum of no floats is the int 0
            total = F.when(F.size(x) == 0, F.raise_error(F.lit("TypeError: float64 takes float, not int")).cast("double")).otherwise(total)
        return _typed(total, "float64", nulls)

    def _counted(self, n: Column, node: ir.Reduce, nulls: bool) -> Typed:
        if type(node.start) is float:
            return _typed(n.cast("double") + F.lit(node.start), "float64", nulls)
        return _typed(n + F.lit(node.start) if node.start else n, "int64", nulls)

    @staticmethod
    def _compensated(x: Column, start: float) -> Column:
        """The built-in sum carries the rounding error of each step beside the total."""
        zero = F.struct(F.lit(start).alias("s"), F.lit(0.0).alias("c"))

        def step(acc: Column, e: Column) -> Column:
            s, t = acc["s"], acc["s"] + e
            lost = F.when(F.abs(s) >= F.abs(e), (s - t) + e).otherwise((e - t) + s)
            return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

        def close(acc: Column) -> Column:
            c = acc["c"]
            finite = ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)) & (c != 0.0)
            return F.when(finite, acc["s"] + c).otherwise(acc["s"])

        return F.aggregate(x, zero, step, close)


def _known(condition: ir.Node) -> tuple[frozenset, frozenset]:
    """Expressions that aren't None where the condition holds, and where it doesn't."""
    none = frozenset()
    if isinstance(condition, ir.IsNone):
        return none, frozenset([condition.value])
    if isinstance(condition, ir.Not):
        yes, no = _known(condition.value)
        return no, yes
    if isinstance(condition, ir.Truth):
        if isinstance(condition.value, ir.Select):
            return _known(condition.value)
        return frozenset([condition.value]), none
    if isinstance(condition, ir.Select):
        if condition.no == ir.Const(False):
            return _known(condition.condition)[0] | _known(condition.yes)[0], none
        if condition.yes == ir.Const(True):
            return none, _known(condition.condition)[1] | _known(condition.no)[1]
    return none, none


def as_declared(t: Typed, declared: T.DataType, strict: bool) -> Column:
    """The result under the declared type's contract."""
    want = name_of(declared)
    if t.kind == _NULL:
        return t.column.cast(declared)
    if t.kind == want:
        return t.column
    if t.kind == "int64" and want == "int32":
        return t.column.cast("int")  # ANSI casts raise when out of range
    if t.kind == "float64" and want == "float32":
        narrow = t.column.cast("float")
        over = (F.abs(narrow) == F.lit(math.inf)) & (F.abs(t.column) != F.lit(math.inf))
        return F.when(over, F.raise_error(F.lit("OverflowError: out of range for float32")).cast("float")).otherwise(narrow)
    if isinstance(declared, (T.StructType, T.ArrayType)) and isinstance(t.dtype, type(declared)):
        have = [f.dataType for f in t.dtype] if isinstance(t.dtype, T.StructType) else [t.dtype.elementType]
        need = [f.dataType for f in declared] if isinstance(declared, T.StructType) else [declared.elementType]
        if [name_of(x) for x in have] == [name_of(x) for x in need]:
            return t.column.cast(declared)
    raise Rejected(f"return.{t.kind}.{want}")
