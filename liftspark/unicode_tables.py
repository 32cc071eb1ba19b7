"""Character classes in the JVM's regex language that equal Python's predicates.

The JVM's own classes are older than Python's tables. Each class here is the
JVM's, plus the ranges where the two differ, found by asking both about every
code point once per process.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BASE = {"alnum": r"\p{L}\p{N}", "alpha": r"\p{L}", "decimal": r"\p{Nd}", "digit": r"\p{Nd}", "numeric": r"\p{N}"}
_ASCII = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "decimal": "0-9", "digit": "0-9", "numeric": "0-9"}


def _points() -> Iterator[int]:
    """Every code point but the surrogates; a list of them would stay in each worker."""
    return itertools.chain(range(0xD800), range(0xE000, 0x110000))


WHITE = "".join(chr(c) for c in _points() if chr(c).isspace())
WHITE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE)


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=8)
def _class(name: str) -> tuple[str, str]:
    """(class of code points to add, class of code points to take away) relative to the JVM's."""
    jvm = SparkSession.active()._jvm
    text = "".join(map(chr, _points()))
    kept = set(jvm.java.util.regex.Pattern.compile(f"[^{_BASE[name]}]+").matcher(text).replaceAll(""))
    mine = {chr(c) for c in _points() if getattr(chr(c), f"is{name}")()}
    return _ranges(sorted(map(ord, mine - kept))), _ranges(sorted(map(ord, kept - mine)))


def regex_class(name: str) -> str:
    """Inside of a bracket expression."""
    if name == "space":
        return WHITE_CLASS
    more, less = _class(name)
    return f"{_BASE[name]}{more}" + (f"&&[^{less}]" if less else "")


def without_property(text: Column, name: str) -> Column:
    """The text without the characters that have a property: first the ASCII ones, then the few others."""
    if name == "space":
        return F.regexp_replace(text, f"[{WHITE_CLASS}]+", "")
    return F.regexp_replace(F.regexp_replace(text, f"[{_ASCII[name]}]+", ""), f"[{regex_class(name)}]+", "")
