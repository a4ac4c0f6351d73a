"""What SQL cannot show: types, names, errors, nulls, empty inputs, files and plans."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillframe import EagerFrame, LazyFrame, col, from_columns, lit, read_csv, read_parquet, scan_csv, scan_parquet
from quillframe.functions import types as rules
from quillframe.sources.readers import columns_frame


def frame(spark, schema, rows):
    return LazyFrame(spark.createDataFrame(rows, schema))


def got(f):
    return [tuple(r) for r in f.df.collect()]


@pytest.fixture(scope="module")
def nums(spark):
    return frame(
        spark,
        "a bigint, b bigint, x double, y double, i int, f float, p boolean, s string",
        [(-7, 2, 1.5, 0.0, 7, 1.5, True, "é"), (7, 0, -0.0, 2.0, -2, 0.5, False, ""), (None, 3, None, 1.0, None, None, None, None), (2**53 + 1, -2, float("nan"), 1.0, 1, 0.0, True, "a%B_ß")],
    )


def test_divide_and_modulo(nums):
    assert got(nums.select_exprs([col("a") / col("b"), col("a") % col("b"), col("x") / col("y")]))[:3] == [(-3, -1, None), (None, None, 0.0), (None, None, None)]
    assert got(nums.select_exprs([col("a") / 2.0]))[0] == (-3.5,)


@pytest.mark.parametrize(
    ("expr", "kind"),
    [(col("i") + col("i"), T.LongType()), (col("f") + col("f"), T.DoubleType()), (col("i") * 1.0, T.DoubleType()), (col("i") / 2, T.LongType()), (lit(3), T.LongType()), (col("i").abs(), T.IntegerType()), (col("s").length(), T.LongType()), (col("i") == 1, T.BooleanType())],
)
def test_types(nums, expr, kind):
    assert expr.infer_type(nums.schema()) == kind
    assert nums.select_exprs([expr.alias("z")]).schema()["z"].dataType == kind


@pytest.mark.parametrize("expr", [col("p") + 1, col("s") + 1, col("s") == 1, col("p") & col("a"), ~col("a"), col("s").abs(), lit("a") < 2])
def test_type_errors(nums, expr):
    with pytest.raises(TypeError):
        nums.select_exprs([expr])


def test_string_functions_need_strings(nums):
    with pytest.raises(ValueError, match="string operand"):
        nums.select_exprs([col("a").length()])


def test_strings(nums):
    out = got(nums.select_exprs([col("s").length(), col("s").to_upper(), col("s").to_lower(), col("s").contains("%"), col("s").starts_with("a%"), col("s").ends_with("longer than it")]))
    assert out == [(2, "é", "é", False, False, False), (0, "", "", False, False, False), (None,) * 6, (6, "A%B_ß", "a%b_ß", True, True, False)]


def test_kleene(spark):
    three = [True, False, None]
    f = frame(spark, "p boolean, q boolean", [(p, q) for p in three for q in three])
    both = lambda p, q: False if p is False or q is False else None if p is None or q is None else True
    either = lambda p, q: True if p or q else None if p is None or q is None else False
    assert got(f.select_exprs([col("p") & col("q"), col("p") | col("q"), ~col("p")])) == [(both(p, q), either(p, q), None if p is None else not p) for p in three for q in three]
    assert len(got(f.filter(col("p")))) == 3


def test_promotion_table():
    i, d, b, s, n = T.IntegerType(), T.FloatType(), T.BooleanType(), T.StringType(), T.NullType()
    assert rules.arithmetic_type(i, n) == T.LongType() and rules.arithmetic_type(n, d) == T.DoubleType() and rules.arithmetic_type(n, n) == n
    assert rules.comparison_type(b, i) == T.LongType() and rules.comparison_type(i, d) == T.DoubleType() and rules.comparison_type(s, s) is None
    with pytest.raises(TypeError):
        rules.arithmetic_type(n, s)


@pytest.fixture(scope="module")
def groups(spark):
    return frame(spark, "k string, v bigint, i int, d double", [("a|b", -5, 3, 1.0), ("a|b", 0, 2, None), ("a|b", None, None, 2.0), (None, None, None, None), (None, None, None, None), ("c", 2, 1, 0.0)])


def test_aggregates(groups):
    f = groups.group_by(["k"]).agg([col("v").sum(), col("v").mean().alias("m"), col("v").count(), col("i").sum(), col("d").mean(), col("d").max()])
    assert f.column_names() == ["k", "agg_0", "m", "agg_2", "agg_3", "agg_4", "agg_5"]
    assert sorted(got(f), key=repr) == sorted([("a|b", -5, -2, 2, 5, 1.5, 2.0), (None, None, None, 0, None, None, None), ("c", 2, 2, 1, 1, 0.0, 0.0)], key=repr)
    assert f.schema()["agg_3"].dataType == T.IntegerType()


def test_global_aggregate_of_nothing(groups):
    nothing = groups.filter(lit(False))
    assert got(nothing.agg([col("v").sum(), col("v").count()])) == []
    assert got(nothing.group_by(["k"]).agg([col("v").sum()])) == []
    assert got(groups.agg([col("v").sum()])) == [(-3,)]


def test_aggregate_shapes(groups):
    assert groups.aggregate([("v", "sum"), ("d", "max")]).column_names() == ["v_sum", "d_max"]
    assert groups.aggregate_map({"v": "sum", "d": "max"}).column_names() == ["d_max", "v_sum"]
    with pytest.raises(ValueError, match="Unknown aggregate"):
        groups.aggregate([("v", "median")])
    with pytest.raises(ValueError, match="already has a name"):
        groups.aggregate([("n", col("v").sum().alias("m"))])
    with pytest.raises(ValueError, match="aggregates"):
        groups.agg([col("v").sum() + 1])
    with pytest.raises(ValueError, match="only be used in agg"):
        groups.select_exprs([col("v").sum()])
    for bad in (col("k").sum(), col("k").min()):
        with pytest.raises(TypeError):
            groups.agg([bad])
    assert got(groups.agg([col("k").count()])) == [(4,)]


@pytest.fixture(scope="module")
def sides(spark):
    left = frame(spark, "k bigint, v string, p double", [(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0)])
    right = frame(spark, "q double, k bigint, v string", [(0.1, 1, "x"), (0.2, 1, "y"), (0.3, 3, "z"), (0.4, None, "w")])
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 4), ("left", 6), ("right", 6), ("outer", 8)])
def test_joins(sides, how, n):
    out = sides[0].join(sides[1], ["k"], how)
    assert out.column_names() == ["k", "v", "p", "q", "v_right"]
    found = got(out)
    assert len(found) == n
    assert ((3, None, None, 0.3, "z") in found) == (how in ("right", "outer"))
    assert ((None, "d", 4.0, None, None) in found) == (how in ("left", "outer"))


def test_join_errors(spark, sides):
    left, right = sides
    for bad in (lambda: left.join(right, ["k"], "semi"), lambda: left.join(right, []), lambda: left.join(right, ["p"]), lambda: left.join(frame(spark, "k int", [(1,)]), ["k"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError, match="repeat"):
        left.with_column("v_right", lit(1)).join(right, ["k"])


def test_sort(spark):
    f = frame(spark, "a int, b string, d date", [(10, "x", None), (9, None, None), (None, "y", None), (9, "a", None)])
    assert [r[:2] for r in got(f.sort(["a", "b"]))] == [(9, "a"), (9, None), (10, "x"), (None, "y")]
    assert [r[:2] for r in got(f.sort(["a", "b"], ascending=False))] == [(None, "y"), (10, "x"), (9, None), (9, "a")]
    assert len(got(f.sort([]))) == 4
    with pytest.raises(ValueError):
        f.sort(["z"])


def test_names(spark):
    f = frame(spark, "`a.b` bigint, c bigint", [(1, 2)])
    assert got(f.select(["a.b"]).with_column("a.b", col("a.b") + 1)) == [(2,)]
    assert f.with_column("c", lit("x")).column_names() == ["a.b", "c"]
    for bad in (lambda: f.select(["C"]), lambda: f.filter(col("A.b") > 1), lambda: f.select(["c"]).filter(col("a.b") > 1), lambda: f.group_by(["z"])):
        with pytest.raises(ValueError, match="not found"):
            bad()
    with pytest.raises(ValueError):
        f.head(-1)
    with pytest.raises(TypeError):
        f.filter(col("c") + 1)
    with pytest.raises(TypeError):
        bool(col("c") == 1)


def test_construction(spark):
    f = from_columns({"b": [1, None], "a": pa.array(["x", "y"])}, spark)
    assert f.column_names() == ["a", "b"] and f.num_rows() == 2 and f.num_columns() == 2
    assert f.table().column("b").to_pylist() == [1, None]
    for bad in ([], [("a", [1]), ("b", [1, 2])], [("a", None)]):
        with pytest.raises(ValueError):
            columns_frame(bad, spark)
    assert EagerFrame().num_rows() == 0 and EagerFrame().num_cols() == 0


def test_eager(spark, capsys):
    f = from_columns([("name", ["Ann", "Bob", "Al"]), ("age", [40, 20, 35]), ("salary", [10, 20, 31])], spark)
    out = f.filter(col("age") > 30).select(["name", "salary"]).sort(["name"])
    assert [tuple(r) for r in out.df.collect()] == [("Al", 31), ("Ann", 10)]
    assert f.aggregate([("salary", "mean")]).df.first()[0] == 20
    out.print(-1)
    assert "2 rows x 2 columns" in capsys.readouterr().out
    assert f.head().num_rows() == 3 and f.lazy().collect().num_rows() == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('i,d,s,b,day,t,none,z,n\n1,1.5,"a, ""q""",true,2024-01-31,2024-01-31 10:00:00,,0,NULL\n2,NaN,,false,2024-02-01,2024-01-31T11:00:00,,1,3\n')
    f = scan_csv(str(path), spark=spark)
    kinds = [x.dataType.simpleString() for x in f.schema()]
    assert kinds == ["bigint", "double", "string", "boolean", "date", "timestamp_ntz", "void", "bigint", "bigint"]
    rows = got(f)
    assert rows[0][2] == 'a, "q"' and rows[1][1] is None and rows[1][2] == "" and rows[0][8] is None
    empty = tmp_path / "head.csv"
    empty.write_text("a,b\n")
    assert read_csv(str(empty), spark=spark).num_rows() == 0


def test_files(spark, tmp_path):
    f = from_columns([("a", [1, None, 3]), ("s", ["x", "", None])], spark)
    for single in (False, True):
        f.write_csv(str(tmp_path / "c.csv"), single_file=single)
        f.write_csv(str(tmp_path / "c.csv"), single_file=single)
        assert (tmp_path / "c.csv").is_file() == single
        back = [tuple(r) for r in read_csv(str(tmp_path / "c.csv"), f.schema(), spark).sort(["a"]).df.collect()]
        assert [r[0] for r in back] == [1, 3, None]
        f.write_parquet(str(tmp_path / "p"), chunk_size=2, single_file=single)
        assert sorted(map(repr, [tuple(r) for r in read_parquet(str(tmp_path / "p"), spark).df.collect()])) == sorted(map(repr, [(1, "x"), (None, ""), (3, None)]))
    f.lazy().sink_parquet(str(tmp_path / "q"))
    assert scan_parquet(str(tmp_path / "q"), spark).collect().num_rows() == 3


def test_plans(spark, tmp_path):
    path = str(tmp_path / "t")
    from_columns([("a", [1, 2]), ("b", [3, 4]), ("c", ["x", "y"])], spark).write_parquet(path)
    f = scan_parquet(path, spark).filter((col("a") > 1) & lit(True)).select(["a", "b"]).sort(["b"]).head(1)
    dot = f.explain(str(tmp_path / "plan.dot"), optimized=True)
    assert "Unoptimized Plan" in dot and "Optimized Plan" in dot and (tmp_path / "plan.dot").read_text() == dot
    assert "Sort" in f.plan() and f.optimize()
    physical = f.df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in physical and "GreaterThan(a,1)" in physical and "struct<a:bigint,b:bigint>" in physical


def test_nan_follows_spark(nums):
    assert math.isnan(got(nums.agg([col("x").max()]))[0][0])
