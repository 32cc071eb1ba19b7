"""Scalar functions that the queries use; each is plain Python."""

from __future__ import annotations

import functools
import json
import math

from ..udf import func

THRESHOLD = 0.0
REGIONS = {"A": "accepted", "N": "new", "R": "returned"}


@func(return_dtype="float64")
def affine(v):
    return v * 2.0 + 3.0


@func(return_dtype="bool")
def at_least_two(v):
    return v >= 2.0


@func(return_dtype="float64")
def plus_ten(v):
    return v + 10.0


@func(return_dtype="float64")
def add(a, b):
    return a + b


@func(return_dtype="float64")
def subtract(a, b):
    return a - b


@func(return_dtype="float64")
def multiply(a, b):
    return a * b


@func(return_dtype="float64")
def divide(a, b):
    return a / b


@func(return_dtype="int64")
def add_int(a, b):
    return a + b * 2 - 1


@func(return_dtype="float64")
def divide_int(a, b):
    return a / b


@func(return_dtype="bool")
def equal(a, b):
    return a == b


@func(return_dtype="bool")
def not_equal(a, b):
    return a != b


@func(return_dtype="bool")
def less(a, b):
    return a < b


@func(return_dtype="bool")
def less_or_equal(a, b):
    return a <= b


@func(return_dtype="bool")
def greater(a, b):
    return a > b


@func(return_dtype="bool")
def greater_or_equal(a, b):
    return a >= b


@func(return_dtype="bool")
def above_one(x):
    return x > 1.0


@func(return_dtype="bool")
def differs_from_itself(x):
    return x != x


@func(return_dtype="bool")
def is_missing(x):
    return x is None


@func(return_dtype="float64")
def pick(a, b):
    return a if a > b else b


@func(return_dtype="float64")
def tiered(price):
    if price > 50000.0:
        rate = 0.9
    elif price > 20000.0:
        rate = 0.95
    else:
        return price
    return price * rate


@func(return_dtype="int64")
def truncated(v):
    return int(v)


@func(return_dtype="string")
def digits(v):
    return str(v)


@func(return_dtype="float64")
def widened(v):
    return float(v)


@func(return_dtype="bool")
def truthy(v):
    return bool(v)


@func(return_dtype="float32")
def single(v):
    return v * 1.1


@func(return_dtype="string")
def constant(v):
    return "fixed"


@func(return_dtype="float64")
def revenue(price, quantity, tax):
    return price * quantity * (1.0 + tax)


@func(return_dtype="float64")
def discounted(price, threshold):
    return price * 0.9 if price > threshold else price


@func(return_dtype="float64")
def raised(price):
    return None if price is None else price * 1.1


@func(return_dtype="float64")
def score(price, quantity, tax):
    if price is None or quantity is None or tax is None:
        return None
    return price * quantity + tax


@func(return_dtype="bool")
def promising(quantity, discount):
    return 0.05 <= discount <= 0.07 and quantity < 24.0


@func(return_dtype="float64")
def field_price(row):
    return row.price * 0.9


@func(return_dtype="struct<_1: bigint, _2: double>")
def both(a, b):
    return (a, b)


@func(return_dtype="array<double>")
def listed(a, b):
    return [a, b]


@func(return_dtype="int64")
def length(s):
    return len(s)


@func(return_dtype="string")
def lowered(s):
    return s.lower()


@func(return_dtype="string")
def uppered(s):
    return s.upper()


@func(return_dtype="bool")
def starts(s):
    return s.startswith("The")


@func(return_dtype="bool")
def ends(s):
    return s.endswith(".")


@func(return_dtype="float64")
def absolute(v):
    return abs(v)


@func(return_dtype="string")
def joined(a, b):
    return a + "/" + b


@func(return_dtype="int64")
def count_alnum(s):
    return sum(1 for c in s if c.isalnum())


@func(return_dtype="int64")
def count_alpha(s):
    return sum(1 for c in s if c.isalpha())


@func(return_dtype="int64")
def count_decimal(s):
    return sum(1 for c in s if c.isdecimal())


@func(return_dtype="int64")
def count_digit(s):
    return sum(1 for c in s if c.isdigit())


@func(return_dtype="int64")
def count_numeric(s):
    return sum(1 for c in s if c.isnumeric())


@func(return_dtype="int64")
def count_space(s):
    return sum(1 for c in s if c.isspace())


@func(return_dtype="int64")
def count_alnum_loop(s):
    n = 0
    for c in s:
        if c.isalnum():
            n += 1
    return n


@func(return_dtype="float64")
def sum_all(xs):
    return sum(x for x in xs)


@func(return_dtype="float64")
def sum_loop(xs):
    total = 0.0
    for x in xs:
        total += x
    return total


@func(return_dtype="float64")
def sum_seeded(xs):
    total = 1.5
    for x in xs:
        if x > THRESHOLD:
            total += x
    return total


@func(return_dtype="int64")
def count_positive(xs):
    return sum(1 for x in xs if x > 0.0)


@func(return_dtype="float64")
def mean_of(xs):
    total = 0.0
    for x in xs:
        total += x
    return total / len(xs)


def _traced(fn):
    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        return fn(*args, **kwargs)

    return wrapper


@func(return_dtype="float64")
@_traced
def wrapped_affine(v):
    return v * 1.5 + 1.25


@func(return_dtype="float64")
def rounded(v):
    print("", end="")  # an effect, so this stays a row function
    return float(math.floor(v * 1.5 + 1.25))


@func(return_dtype="string", deterministic=True)
def value_of_k(props):
    return str(json.loads(props)["k"])


@func(return_dtype="float64")
def batched_root(v):
    return math.sqrt(v)


@func(return_dtype="string")
def meaning(flag):
    return REGIONS[flag]


SETTINGS_NAME = " run "


def _prefix(name, version="v1"):
    if name is None:
        return "none"
    return name.strip() + "-" + version


@func(return_dtype="string")
def labelled(kind):
    return _prefix(SETTINGS_NAME) + "/" + kind  # the helper's part folds to a constant


@func(return_dtype="int64")
def code_point_slot(s):
    return len(s[0])


@func(return_dtype="bool")
def known_type(kind):
    return kind in ("click", "view")


@func(return_dtype="string")
def first_character(s):
    return s[0] if s else s  # of an empty text it is empty, of None it is None, as in SQL


@func(return_dtype="string")
def last_character(s):
    return s[-1] if s else s  # as above


@func(return_dtype="int64")
def looked_up(m, k):
    return m[k]


@func(return_dtype="string")
def stripped(s):
    return s.strip()


@func(return_dtype="bool")
def mentions(s):
    return "license" in s


@func(return_dtype="int64")
def remainder(a):
    return (0 - a) % 7


@func(return_dtype="float64")
def negated(v):
    return -v


@func(return_dtype="float64")
def clamped(v):
    return min(max(v, 10.0), 40.0)


@func(return_dtype="bool")
def not_small(v):
    return not v < 10.0


@func(return_dtype="string")
def swapped(s):
    return s.replace("e", "é")


@func(return_dtype="float64")
def discounted_row(row, rate):
    return row.price * (1.0 - rate)
