"""Lowered columns against the functions themselves, and against the interpreter of expressions."""

import functools
import math
import re
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftspark import EngineConfig, Policy, config, func, ir, select, where, with_columns
from liftspark.capture import Rejected, capture, safe_pattern
from liftspark.explain import counters, explain_udf, report
from liftspark.functions import scalar as s
from liftspark.functions import text as t
from liftspark.lower import Lowering, argument
from liftspark.plans.registry import QUERIES
from liftspark.reference import evaluate
from liftspark.types import canonical, layout, normalize_scalar, schema_digest

FLOATS = [0.0, -0.0, 1.25, -1.25, 2.5, float("nan"), math.inf, -math.inf, 1.7976931348623157e308, 5e-324]
TEXTS = ["", "a", "The end.", "  a\tb  c\n", "naïve Ⅷ² ٣ x1", "a😀b", "“q” – x…", "\x1c\x85 x ", "<b>bold</b> $1 \\ <i", "ﬁ ǅ Ω ß İ"]


def run(spark, f, rows, kind):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    out = select(df, "i", y=f(F.col("x")))
    return [r["y"] for r in sorted(out.collect(), key=lambda r: r["i"])], report(out)[0]


def same(a, b):
    return a is b or a == b and math.copysign(1, a) == math.copysign(1, b) if isinstance(a, float) and isinstance(b, float) and a == a else a != a and b != b if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", ["affine", "at_least_two", "above_one", "differs_from_itself", "absolute", "truthy", "wrapped_affine", "plus_ten"])
def test_floats_bit_for_bit(spark, name):
    f = getattr(s, name)
    got, how = run(spark, f, FLOATS, "double")
    assert how["tier"] == 1, how
    assert all(same(a, f.fn(b)) for a, b in zip(got, FLOATS, strict=True)), got


@pytest.mark.parametrize("name", ["count_alnum", "count_alpha", "count_decimal", "count_digit", "count_numeric", "count_space", "count_alnum_loop", "length", "lowered", "starts", "ends"])
def test_text_properties(spark, name):
    f = getattr(s, name)
    texts = TEXTS if name != "lowered" else TEXTS[:-1]
    got, how = run(spark, f, texts, "string")
    assert how["tier"] == 1, how
    assert got == [f.fn(x) for x in texts]


@pytest.mark.parametrize("name", ["normalize_punctuation", "expand_punctuation", "normalize_space", "normalize_space_em", "strip_tags", "length_between", "alnum_at_least_or_empty", "alnum_ratio"])
def test_text_functions(spark, name):
    f = getattr(t, name)
    got, how = run(spark, f, TEXTS, "string")
    assert how["tier"] == 1, how
    assert got == [f.fn(x) for x in TEXTS]


def test_every_code_point_of_each_class(spark):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    chunks = ["".join(map(chr, points[i : i + 1000])) for i in range(0, len(points), 1000)]
    for name in ("alnum", "alpha", "decimal", "digit", "numeric", "space"):
        f = getattr(s, f"count_{name}")
        got, how = run(spark, f, chunks, "string")
        assert how["tier"] == 1 and got == [f.fn(x) for x in chunks], name


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=20), min_size=1, max_size=30))
def test_space_and_tags_on_any_text(spark, texts):
    texts = [x.replace("\x00", "") for x in texts]
    for f in (t.normalize_space, t.strip_tags, t.normalize_punctuation):
        assert run(spark, f, texts, "string")[0] == [f.fn(x) for x in texts]


def test_arrays(spark):
    rows = [[], [1.0], [0.1] * 10, [1e100, 1.0, -1e100], [-1.0, 2.0, float("nan")], [0.1, 0.2, 0.3]]
    for name in ("sum_loop", "sum_seeded", "count_positive"):
        f = getattr(s, name)
        got, how = run(spark, f, rows, "array<double>")
        assert how["tier"] == 1 and all(same(a, f.fn(b)) for a, b in zip(got, rows, strict=True)), (name, got)
    got, how = run(spark, s.sum_all, rows[1:], "array<double>")
    assert how["tier"] == 1 and all(same(a, s.sum_all.fn(b)) for a, b in zip(got, rows[1:], strict=True))
    with pytest.raises(Exception, match="TypeError"):
        run(spark, s.sum_all, [[]], "array<double>")


def test_null_reaches_the_function(spark):
    assert run(spark, s.is_missing, [None, 1.0], "double")[0] == [True, False]
    assert run(spark, s.raised, [None, 2.0], "double")[0] == [None, 2.0 * 1.1]
    with pytest.raises(Exception, match="TypeError"):
        run(spark, s.affine, [1.0, None], "double")

    @func(return_dtype="float64", nulls="propagate")
    def doubled(v):
        return v * 2.0

    assert run(spark, doubled, [1.0, None], "double")[0] == [2.0, None]


def test_errors(spark):
    def fails(f, rows, kind, text):
        with pytest.raises(Exception, match=text):
            run(spark, f, rows, kind)

    @func(return_dtype="float64")
    def inverse(v):
        return 1.0 / v

    @func(return_dtype="int64")
    def bigger(v):
        return v + 1

    fails(inverse, [0.0], "double", "DIVIDE_BY_ZERO")
    fails(bigger, [2**63 - 1], "bigint", "OVERFLOW")
    fails(s.single, [1e300], "double", "OverflowError")
    fails(s.meaning, ["Q"], "string", "KeyError|UNKNOWN|PythonException")


def test_first_character_of_any_text(spark, tmp_path):
    texts = ["", "a", "😀b", None, "\n c"]
    got, how = run(spark, s.first_character, texts, "string")
    assert how["tier"] == 1 and got == ["", "a", "😀", None, "\n"] == [s.first_character.fn(x) for x in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, QUERIES["op_index"](spark, str(tmp_path)).collect())) == dict(enumerate(got))

    @func(return_dtype="string")
    def bare(x):
        return x[0]

    with pytest.raises(Exception, match="IndexError"):
        run(spark, bare, ["a", ""], "string")


def test_last_character_of_any_text(spark, tmp_path):
    texts = ["", "a", "b😀", None, "c \n"]
    got, how = run(spark, s.last_character, texts, "string")
    assert how["tier"] == 1 and got == ["", "a", "😀", None, "\n"] == [s.last_character.fn(x) for x in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(map(tuple, QUERIES["op_index_negative"](spark, str(tmp_path)).collect())) == dict(enumerate(got))


def test_guarded_division_does_not_raise(spark):
    @func(return_dtype="bool")
    def big_share(v):
        return v != 0.0 and 10.0 / v > 1.0

    assert run(spark, big_share, [0.0, 2.0, 20.0], "double")[0] == [False, True, False]


def test_tiers_and_reasons(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("a",)], "x string")
    calls = [
        (s.length, 1, "lowered"),
        (t.clean_links, 2, "regex.unsafe"),
        (s.meaning, 2, "constant.type"),
        (func(print, return_dtype="string"), 3, "function.opaque"),
    ]
    for f, tier, reason in calls:
        how = report(select(df, y=f(F.col("x"))))[0]
        assert (how["tier"], how["reason"]) == (tier, reason), how
    assert counters(select(df, y=s.length(F.col("x")))) == {"tier.1": 1, "reason.lowered": 1}
    assert '"tier": 1' in explain_udf(select(df, y=s.length(F.col("x"))))


def test_rejections():
    def prints(v):
        print(v)
        return v

    def two_ifs(v):
        return sum(1 for c in v if c.isalpha() if c.isdigit())

    def keyword(v):
        return len(obj=v)

    def effect(v):
        global EFFECT
        EFFECT = v
        return v

    def generator(v):
        yield v

    def shadow(v, len=max):
        return len(v)

    under = re.compile(r"\s+")

    def underscore(v):
        return under.sub("_", v).strip()

    for f in (prints, two_ifs, keyword, effect, generator, shadow, underscore, lambda v: v):
        with pytest.raises(Rejected):
            capture(f)


def test_safe_patterns():
    assert safe_pattern(r"<[^>]+>") and safe_pattern("abc") and safe_pattern(r"[a-z]+x\.")
    assert not any(map(safe_pattern, ["", "a*", "(a)", "a|b", "^a", "a$", "a.b", r"\d", r"[\w]", "é", "a{2}", "[a&&b]", "[[a]]"]))


def test_interpreter_agrees_with_functions():
    for f, values in ((s.affine, FLOATS), (s.tiered, [1.0, 30000.0, 60000.0]), (t.normalize_space, TEXTS), (t.expand_punctuation, TEXTS), (s.sum_loop, [[0.1] * 7]), (s.sum_all, [[0.1] * 7])):
        read = capture(f.fn)
        assert all(same(evaluate(read.root, [v]), f.fn(v)) for v in values), f.__name__


def test_dependencies_are_watched():
    box = 2.0

    def times(v):
        return v * box

    read = capture(times)
    assert read.dependencies_match()
    box = 3.0
    assert not read.dependencies_match()


def test_partials_wrappers_and_inlining(spark):
    def base(v, k):
        return v * k

    def through(v):
        return base(v, 3.0) + 1.0

    half = functools.partial(base, k=0.5)
    assert run(spark, func(half, return_dtype="float64"), [4.0], "double")[0] == [2.0]
    got, how = run(spark, func(through, return_dtype="float64"), [4.0], "double")
    assert got == [13.0] and how["tier"] == 1

    class Scale:
        @func(return_dtype="float64")
        def twice(self, v):
            return v * 2.0

    got, how = run(spark, Scale().twice, [4.0], "double")
    assert got == [8.0] and how["tier"] == 1


def test_modes_agree(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "row_id long, value double")
    before = config.current()
    seen = {}
    try:
        for mode in ("off", "observe", "auto"):
            config.configure(EngineConfig(mode=mode))
            out = with_columns(df, {"p": s.affine(F.col("value"))})
            out = select(where(out, s.at_least_two(F.col("value"))), "row_id", "p", q=s.plus_ten(F.col("value")))
            seen[mode] = (sorted(map(tuple, out.collect())), {d["tier"] for d in report(out)})
    finally:
        config.configure(before)
    assert seen["off"][0] == seen["observe"][0] == seen["auto"][0]
    assert seen["off"][1] == seen["observe"][1] == {3} and seen["auto"][1] == {1}


def test_config_only_tightens():
    assert EngineConfig(mode="auto").effective("observe") == "observe"
    assert EngineConfig(mode="observe").effective("auto") == "observe"
    assert EngineConfig(disabled=True).effective("auto") == "off"
    assert EngineConfig(rollout_authorized=False).effective() == "observe"
    assert Policy().tighten(max_nodes=10**9).max_nodes == Policy().max_nodes
    with pytest.raises(ValueError):
        EngineConfig(mode="fast")
    with pytest.raises(ValueError):
        Policy(max_nodes=0)


def test_values_and_types():
    assert canonical("Boolean") == "bool" and canonical("utf8") == "string"
    for kind, good in (("bool", [True]), ("int32", [-(2**31), 2**31 - 1]), ("int64", [-(2**63), 2**63 - 1]), ("float32", [1.1]), ("float64", [1.1])):
        for v in good:
            normalize_scalar(v, kind)
    assert normalize_scalar(1.1, "float32") == struct.unpack("<f", struct.pack("<f", 1.1))[0]
    for kind, bad, error in (("bool", 1, TypeError), ("int32", 2**31, OverflowError), ("int64", True, TypeError), ("float64", 1, TypeError), ("float32", 1e300, OverflowError)):
        with pytest.raises(error):
            normalize_scalar(bad, kind)
    with pytest.raises(TypeError):
        normalize_scalar(None, "int64", nullable=False)
    assert layout([T.DoubleType()], T.BooleanType()) == "scalar_slot"
    assert layout([T.StringType()], T.LongType()) == "exact_unicode"
    assert layout([T.StringType()] * 2, T.LongType()) == "python_object"
    a = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert schema_digest(a) == schema_digest(T.StructType(list(reversed(a.fields))))


def test_lowered_predicates_stay_in_codegen(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    plan = where(df, t.length_between(F.col("x"), low=1, high=5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_batches_of_distinct_values():
    import pyarrow as pa

    from liftspark.batch import over_domain, profitable

    seen = []

    def f(x):
        seen.append(x)
        return (x or "none").upper()

    assert over_domain(f, pa.array(["a", "b", "a", "a", "b", "a"]), pa.string(), 100).to_pylist() == ["A", "B", "A", "A", "B", "A"]
    assert seen == ["a", "b"]
    assert over_domain(f, pa.array(["a", None, "b"]), pa.string(), 100).to_pylist() == ["A", "NONE", "B"]
    assert not profitable(0, 0, 10) and not profitable(3, 5, 10) and profitable(2, 4, 10) and not profitable(11, 100, 10)


def test_options(spark):
    attempts = []

    @func(return_dtype="float64", on_error="null", max_retries=2)
    def picky(v):
        if v < 0.0:
            raise ValueError(v)
        return v

    assert run(spark, picky, [1.0, -1.0], "double")[0] == [1.0, None]
    assert picky(3.0) == 3.0 and attempts == []

    @func(return_dtype="struct<_1: bigint, _2: double>", unnest=True)
    def both(a, b):
        return (a, b)

    df = spark.createDataFrame([(1, 2.0)], "a bigint, b double")
    assert select(df, "a", both(F.col("a"), F.col("b"))).columns == ["a", "_1", "_2"]


def test_effects_happen_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v + 1.0

    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    out = with_columns(df, {"y": func(counted, return_dtype="float64")(F.col("x"))})
    where(out, s.at_least_two(F.col("y"))).collect()
    assert seen.value == 10


def test_mixed_types_fall_back(spark):
    @func(return_dtype="float64")
    def odd(v):
        return v + 1

    how = run(spark, odd, [1.5], "double")[1]
    assert how["tier"] == 1  # an int constant that a float holds exactly

    @func(return_dtype="int64")
    def wrong(v):
        return v * 2.0

    df = spark.createDataFrame([(1.0,)], "x double")
    out = select(df, y=wrong(F.col("x")))
    assert report(out)[0]["tier"] == 2
    with pytest.raises(Exception, match="TypeError"):
        out.collect()


def test_lowering_without_a_session_schema(spark):
    read = capture(s.affine.fn)
    typed = Lowering([argument(F.col("x"), T.FloatType(), True)]).lower(read.root)
    assert typed.kind == "float64" and ir.size(read.root) == 5


def test_generators_and_coroutines(spark):
    @func(return_dtype="bigint", is_generator=True)
    def up_to(n):
        yield from range(n)

    @func(return_dtype="float64", is_async=True)
    async def later(v):
        return v + 1.0

    df = spark.createDataFrame([(0, 1.0), (3, 2.0)], "n bigint, v double")
    assert sorted(r["y"] for r in select(df, y=up_to(F.col("n"))).collect()) == [0, 1, 2]
    assert sorted(r["y"] for r in select(df, y=later(F.col("v"))).collect()) == [2.0, 3.0]


def test_constant_helpers_fold(spark):
    df = spark.createDataFrame([("a",)], "x string")
    out = select(df, y=s.labelled(F.col("x")))
    assert out.first()["y"] == "run-v1/a" and report(out)[0]["tier"] == 1
    assert "run-v1/" in out._jdf.queryExecution().optimizedPlan().toString()


def test_calls_of_local_names_are_not_pure():
    from liftspark.batch import is_pure

    seen = []

    def by_default(x, log=print):
        log(x)
        return x

    def by_alias(x):
        sink = seen.append
        sink(x)
        return x

    def by_subscript(x):
        return [print][0](x)

    def by_other_name(x):
        out = seen
        out.append(x)
        return x

    def own_list(x):
        out = []
        out.append(x + 1)
        return out[0]

    def methods(x, least=3):
        return x.strip().lower()[:least]

    assert not any(map(is_pure, (by_default, by_alias, by_subscript, by_other_name)))
    assert is_pure(own_list) and is_pure(methods)
