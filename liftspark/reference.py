"""Evaluates expressions in plain Python: the meaning that columns are tested against."""

from __future__ import annotations

import operator

from . import ir

_BINARY = {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "truediv": operator.truediv, "mod": operator.mod}
_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
_CAST = {"bool": bool, "int": int, "float": float, "str": str}


def evaluate(node: ir.Node, args: list):
    def go(n):
        match n:
            case ir.Arg(index, _):
                return args[index]
            case ir.Const(value):
                return value
            case ir.Binary(op, a, b):
                return _BINARY[op](go(a), go(b))
            case ir.Negate(a):
                return -go(a)
            case ir.Compare(op, a, b):
                return _COMPARE[op](go(a), go(b))
            case ir.IsNone(a):
                return go(a) is None
            case ir.Not(a):
                return not go(a)
            case ir.Truth(a):
                return bool(go(a))
            case ir.Cast(target, a):
                return _CAST[target](go(a))
            case ir.Select(c, a, b):
                return go(a) if go(c) else go(b)
            case ir.Field(a, key):
                v = go(a)
                return v[key] if isinstance(v, dict) else getattr(v, key)
            case ir.Lookup(a, k):
                return go(a)[go(k)]
            case ir.MakeTuple(items):
                return tuple(map(go, items))
            case ir.MakeList(items):
                return list(map(go, items))
            case ir.Call("len", (a,)):
                return len(go(a))
            case ir.Call("abs", (a,)):
                return abs(go(a))
            case ir.Call("contains", (a, b)):
                return go(b) in go(a)
            case ir.Call(model, (a, *rest)):
                return getattr(go(a), model)(*map(go, rest))
            case ir.OneOf(a, options):
                return go(a) in options
            case ir.Reduce(kind, sequence, predicate, start, exact):
                passing = [x for x in go(sequence) if predicate is None or _passes(predicate, x)]
                if kind == "count":
                    return start + len(passing)
                if exact:
                    return sum(passing, start)
                for x in passing:
                    start += x
                return start
            case ir.Translate(text, table):
                return go(text).translate({ord(k): v for k, v in table})
            case ir.CollapseSpace(text, by):
                return _spaces(go(text), by).strip()
            case ir.RegexReplace(text, r"\s+", by):
                return _spaces(go(text), by)
            case ir.RegexReplace(text, pattern, by):
                import re

                return re.sub(pattern, lambda _: by, go(text))
        raise TypeError(type(n).__name__)

    return go(node)


def _passes(p: ir.Node, x) -> bool:
    return getattr(x, f"is{p.name}")() if isinstance(p, ir.Property) else _COMPARE[p.op](x, p.bound)


def _spaces(text: str, by: str) -> str:
    out, inside = [], False
    for c in text:
        if not c.isspace():
            out.append(c)
        elif not inside:
            out.append(by)
        inside = c.isspace()
    return "".join(out)
