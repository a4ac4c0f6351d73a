"""One query for each operator of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillframe import EagerFrame, LazyFrame, col, lit, scan_parquet
from quillframe.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> LazyFrame:
    return scan_parquet(f"{sf}/{name}.parquet", spark)


def _add(name: str, table: str, build: Callable[[LazyFrame], LazyFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: build(_table(spark, sf, table)).df
    SQL[name] = sql


def _many(name: str, build: Callable[[Callable[[str], LazyFrame]], LazyFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf: build(lambda table: _table(spark, sf, table)).df
    SQL[name] = sql


KEY = ["l_orderkey", "l_linenumber"]


def _holed(name: str = "l_linenumber", at: int = 3):
    """A bigint that is null where the column equals ``at``: 0 / 0 where it matches."""
    return col(name) + (col(name) - at) % (col(name) - at)


_holed_sql = "(l_linenumber + (l_linenumber - 3) % NULLIF(l_linenumber - 3, 0))::BIGINT"

# Projection and columns
_add("scan_select", "lineitem", lambda f: f.select(["l_linenumber", "l_orderkey", "l_shipdate"]), "SELECT l_linenumber, l_orderkey, l_shipdate FROM lineitem")
_add("select_exprs_names", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), col("l_quantity") * 2, (col("l_linenumber") + 1).alias("next"), lit("x"), lit(7)]), "SELECT l_orderkey, l_quantity * 2 AS expr_1, (l_linenumber + 1)::BIGINT AS next, 'x' AS expr_3, 7::BIGINT AS expr_4 FROM lineitem")
_add("with_column_replace", "part", lambda f: f.with_column("p_size", col("p_size") * 10), "SELECT * REPLACE ((p_size * 10)::BIGINT AS p_size) FROM part")
_add("with_column_append", "part", lambda f: f.with_column("big", col("p_size") > 25), "SELECT *, p_size > 25 AS big FROM part")
# Comparisons and boolean logic
for _name, _op, _fn in (("eq", "=", lambda a, b: a == b), ("ne", "<>", lambda a, b: a != b), ("lt", "<", lambda a, b: a < b), ("le", "<=", lambda a, b: a <= b), ("gt", ">", lambda a, b: a > b), ("ge", ">=", lambda a, b: a >= b)):
    _add(f"filter_cmp_{_name}", "lineitem", lambda f, fn=_fn: f.filter(fn(col("l_quantity"), 25)).select([*KEY, "l_quantity"]), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
_add("filter_and_or_not", "lineitem", lambda f: f.filter(((_holed() > 4) | (col("l_discount") > 0.05)) & ~(col("l_returnflag") == "R")).select([*KEY, "l_discount", "l_returnflag"]), f"SELECT l_orderkey, l_linenumber, l_discount, l_returnflag FROM lineitem WHERE ({_holed_sql} > 4 OR l_discount > 0.05) AND NOT (l_returnflag = 'R')")
_add("kleene_truth", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), ((_holed() > 2) & (col("l_quantity") > 25)).alias("both"), ((_holed() > 2) | (col("l_quantity") > 25)).alias("either"), (~(_holed() > 2)).alias("neither")]), f"SELECT l_orderkey, {_holed_sql} > 2 AND l_quantity > 25 AS both, {_holed_sql} > 2 OR l_quantity > 25 AS either, NOT ({_holed_sql} > 2) AS neither FROM lineitem")
_add("compare_bool_number", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), ((col("l_quantity") > 25) == lit(1)).alias("same")]), "SELECT l_orderkey, (l_quantity > 25)::BIGINT = 1 AS same FROM lineitem")
_add("filter_string_eq", "customer", lambda f: f.filter(col("c_mktsegment") == "BUILDING"), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
_add("filter_string_lt", "nation", lambda f: f.filter(col("n_name") < "NATION_12"), "SELECT * FROM nation WHERE n_name < 'NATION_12'")
_add("filter_true", "region", lambda f: f.filter(lit(True)), "SELECT * FROM region")
_add("filter_false", "region", lambda f: f.filter(lit(False)), "SELECT * FROM region WHERE FALSE")
_add("is_null", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), _holed().is_null().alias("gone")]), f"SELECT l_orderkey, {_holed_sql} IS NULL AS gone FROM lineitem")
_add("is_not_null", "lineitem", lambda f: f.filter(_holed().is_not_null()).select(KEY), f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_holed_sql} IS NOT NULL")
# Arithmetic
for _name, _op, _fn in (("add", "+", lambda a, b: a + b), ("sub", "-", lambda a, b: a - b), ("mul", "*", lambda a, b: a * b)):
    _add(f"arith_{_name}", "lineitem", lambda f, fn=_fn: f.select_exprs([col("l_orderkey"), fn(col("l_linenumber"), col("l_linenumber")).alias("whole"), fn(col("l_quantity"), col("l_linenumber")).alias("mixed"), fn(10, col("l_linenumber")).alias("reflected")]), f"SELECT l_orderkey, (l_linenumber {_op} l_linenumber)::BIGINT AS whole, l_quantity {_op} l_linenumber AS mixed, (10 {_op} l_linenumber)::BIGINT AS reflected FROM lineitem")
_add("int_div", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), ((lit(0) - col("l_orderkey")) / (col("l_linenumber") - 3)).alias("q")]), "SELECT l_orderkey, ((0 - l_orderkey) // NULLIF(l_linenumber - 3, 0))::BIGINT AS q FROM lineitem")
_add("int_mod", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), ((lit(0) - col("l_orderkey")) % (col("l_linenumber") - 3)).alias("r")]), "SELECT l_orderkey, ((0 - l_orderkey) % NULLIF(l_linenumber - 3, 0))::BIGINT AS r FROM lineitem")
_add("float_div_zero", "lineitem", lambda f: f.select_exprs([col("l_orderkey"), (col("l_quantity") / col("l_discount")).alias("q")]), "SELECT l_orderkey, l_quantity / NULLIF(l_discount, 0) AS q FROM lineitem")
_add("float_mod", "customer", lambda f: f.select_exprs([col("c_custkey"), (col("c_acctbal") % 7.5).alias("r")]), "SELECT c_custkey, c_acctbal % 7.5::DOUBLE AS r FROM customer")
_add("abs_neg", "customer", lambda f: f.select_exprs([col("c_custkey"), col("c_acctbal").abs().alias("a"), (-col("c_nationkey")).alias("n")]), "SELECT c_custkey, abs(c_acctbal) AS a, -c_nationkey AS n FROM customer")
# Strings
_add("str_length_bytes", "documents", lambda f: f.select_exprs([col("doc_id"), col("text").length().alias("n")]), "SELECT doc_id, strlen(text) AS n FROM documents")
_add("str_contains", "documents", lambda f: f.select_exprs([col("doc_id"), col("text").contains("%").alias("percent"), col("text").contains("th_").alias("under"), col("text").contains("").alias("none")]), "SELECT doc_id, contains(text, '%') AS percent, contains(text, 'th_') AS under, contains(text, '') AS none FROM documents")
_add("str_starts_with", "part", lambda f: f.filter(col("p_brand").starts_with("Brand#1")).select(["p_partkey", "p_brand"]), "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
_add("str_ends_with", "part", lambda f: f.filter(col("p_brand").ends_with("3")).select(["p_partkey", "p_brand"]), "SELECT p_partkey, p_brand FROM part WHERE suffix(p_brand, '3')")
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_add("str_lower_ascii", "documents", lambda f: f.select_exprs([col("doc_id"), col("text").to_lower().alias("t")]), f"SELECT doc_id, translate(text, '{_UP}', '{_LOW}') AS t FROM documents")
_add("str_upper_ascii", "documents", lambda f: f.select_exprs([col("doc_id"), col("text").to_upper().alias("t")]), f"SELECT doc_id, translate(text, '{_LOW}', '{_UP}') AS t FROM documents")
# Aggregation. Sums of doubles depend on the order of addition: they go through whole cents.
_cents = lambda c: (col(c) * 100 + 0.5) - (col(c) * 100 + 0.5) % 1.0
_add("group_sum", "orders", lambda f: f.group_by(["o_orderstatus"]).aggregate([("cents", _cents("o_totalprice").sum())]), "SELECT o_orderstatus, SUM(floor(o_totalprice * 100 + 0.5)) AS cents FROM orders GROUP BY 1")
_add("group_mean", "lineitem", lambda f: f.group_by(["l_returnflag"]).agg([col("l_quantity").mean().alias("m")]), "SELECT l_returnflag, AVG(l_quantity) AS m FROM lineitem GROUP BY 1")
_add("group_count", "lineitem", lambda f: f.group_by(["l_returnflag"]).agg([_holed().count().alias("n")]), f"SELECT l_returnflag, COUNT({_holed_sql}) AS n FROM lineitem GROUP BY 1")
_add("group_min", "orders", lambda f: f.group_by(["o_orderpriority"]).agg([col("o_totalprice").min().alias("least")]), "SELECT o_orderpriority, MIN(o_totalprice) AS least FROM orders GROUP BY 1")
_add("group_max", "orders", lambda f: f.group_by(["o_orderpriority"]).agg([col("o_totalprice").max().alias("most")]), "SELECT o_orderpriority, MAX(o_totalprice) AS most FROM orders GROUP BY 1")
_add("group_sum_int", "lineitem", lambda f: f.group_by(["l_linestatus"]).agg([col("l_linenumber").sum().alias("s"), col("l_partkey").sum().alias("p")]), "SELECT l_linestatus, CAST(SUM(l_linenumber) AS INTEGER) AS s, CAST(SUM(l_partkey) AS BIGINT) AS p FROM lineitem GROUP BY 1")
_add("group_mean_int", "lineitem", lambda f: f.group_by(["l_linestatus"]).agg([(lit(0) - col("l_partkey")).mean().alias("m"), col("l_linenumber").mean().alias("k")]), "SELECT l_linestatus, CAST(-(SUM(l_partkey) // COUNT(l_partkey)) AS BIGINT) AS m, CAST(SUM(l_linenumber) // COUNT(l_linenumber) AS INTEGER) AS k FROM lineitem GROUP BY 1")
_add("group_multi_key", "lineitem", lambda f: f.group_by(["l_returnflag", "l_linestatus"]).agg([col("l_orderkey").count().alias("n")]), "SELECT l_returnflag, l_linestatus, COUNT(l_orderkey) AS n FROM lineitem GROUP BY 1, 2")
_add("group_null_key", "lineitem", lambda f: f.with_column("k", _holed()).group_by(["k"]).agg([col("l_orderkey").count().alias("n")]), f"SELECT {_holed_sql} AS k, COUNT(l_orderkey) AS n FROM lineitem GROUP BY 1")
_add("agg_pairs", "lineitem", lambda f: f.group_by(["l_returnflag"]).aggregate([("l_quantity", "sum"), ("l_quantity", "max"), ("l_orderkey", "count")]), "SELECT l_returnflag, SUM(l_quantity) AS l_quantity_sum, MAX(l_quantity) AS l_quantity_max, COUNT(l_orderkey) AS l_orderkey_count FROM lineitem GROUP BY 1")
_add("agg_named", "lineitem", lambda f: f.group_by(["l_returnflag"]).aggregate([("most", col("l_tax").max()), ("n", col("l_tax").count())]), "SELECT l_returnflag, MAX(l_tax) AS most, COUNT(l_tax) AS n FROM lineitem GROUP BY 1")
_add("agg_map", "lineitem", lambda f: f.group_by(["l_returnflag"]).aggregate_map({"l_tax": "min", "l_orderkey": "max", "l_quantity": "mean"}), "SELECT l_returnflag, MAX(l_orderkey) AS l_orderkey_max, AVG(l_quantity) AS l_quantity_mean, MIN(l_tax) AS l_tax_min FROM lineitem GROUP BY 1")
_add("agg_default_names", "lineitem", lambda f: f.group_by(["l_linestatus"]).agg([col("l_tax").min(), col("l_tax").max().alias("most"), col("l_tax").count()]), "SELECT l_linestatus, MIN(l_tax) AS agg_0, MAX(l_tax) AS most, COUNT(l_tax) AS agg_2 FROM lineitem GROUP BY 1")
_add("agg_expr_arg", "lineitem", lambda f: f.group_by(["l_returnflag"]).agg([(col("l_quantity") * col("l_linenumber")).sum().alias("s")]), "SELECT l_returnflag, SUM(l_quantity * l_linenumber) AS s FROM lineitem GROUP BY 1")
_add("global_agg", "lineitem", lambda f: f.agg([col("l_quantity").sum().alias("q"), col("l_orderkey").max().alias("k"), lit(1).count().alias("n")]), "SELECT SUM(l_quantity) AS q, MAX(l_orderkey) AS k, COUNT(*) AS n FROM lineitem")
_add("global_agg_empty", "lineitem", lambda f: f.filter(col("l_quantity") < 0).aggregate([("l_quantity", "sum"), ("l_orderkey", "count")]), "SELECT SUM(l_quantity) AS l_quantity_sum, COUNT(l_orderkey) AS l_orderkey_count FROM lineitem WHERE l_quantity < 0 HAVING COUNT(*) > 0")
_add("global_agg_map", "orders", lambda f: f.aggregate_map({"o_totalprice": "max", "o_custkey": "min"}), "SELECT MIN(o_custkey) AS o_custkey_min, MAX(o_totalprice) AS o_totalprice_max FROM orders")
_add("having_agg", "orders", lambda f: f.group_by(["o_custkey"]).aggregate([("o_orderkey", "count")]).filter(col("o_orderkey_count") > 12), "SELECT o_custkey, COUNT(o_orderkey) AS o_orderkey_count FROM orders GROUP BY 1 HAVING COUNT(o_orderkey) > 12")
_add("having_key", "orders", lambda f: f.group_by(["o_orderstatus"]).aggregate([("o_orderkey", "count")]).filter(col("o_orderstatus") != "F"), "SELECT o_orderstatus, COUNT(o_orderkey) AS o_orderkey_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
# Joins
_docs = lambda t: t("documents").filter(col("n_chars") > 500).select(["doc_id", "lang", "n_chars"])
_labels = lambda t: t("labels").filter(col("quality") == 1)
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    _many(f"join_{_how}", lambda t, how=_how: _docs(t).join(_labels(t), ["doc_id"], how), f"SELECT doc_id, lang, n_chars, quality, toxic FROM (SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500) {_sql} JOIN (SELECT * FROM labels WHERE quality = 1) USING (doc_id)")
_many("join_multi_key", lambda t: t("lineitem").select([*KEY, "l_quantity"]).join(t("lineitem").group_by(KEY).agg([col("l_tax").max().alias("tax")]), KEY), "SELECT l_orderkey, l_linenumber, l_quantity, tax FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, MAX(l_tax) AS tax FROM lineitem GROUP BY 1, 2) USING (l_orderkey, l_linenumber)")
_many("join_null_key", lambda t: t("lineitem").with_column("k", _holed()).select(["k", "l_orderkey"]).join(t("region").select_exprs([(col("r_regionkey") + 1).alias("k"), col("r_name")]), ["k"], "left"), f"SELECT l.k, l_orderkey, r_name FROM (SELECT {_holed_sql} AS k, l_orderkey FROM lineitem) l LEFT JOIN (SELECT (r_regionkey + 1)::BIGINT AS k, r_name FROM region) r ON l.k = r.k")
_many("join_suffix_right", lambda t: t("documents").select_exprs([col("doc_id").alias("id"), col("lang"), col("n_chars")]).join(t("documents").select_exprs([(col("doc_id") + 1).alias("id"), col("lang"), col("source")]), ["id"]), "SELECT a.doc_id AS id, a.lang, a.n_chars, b.lang AS lang_right, b.source FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1")
_many("join_dup_keys", lambda t: t("nation").select_exprs([col("n_regionkey").alias("k"), col("n_name")]).join(t("supplier").select_exprs([(col("s_nationkey") % 5).alias("k64"), col("s_suppkey")]).join(t("region").select_exprs([(col("r_regionkey") + 0).alias("k64"), col("r_regionkey").alias("k")]), ["k64"]).select(["k", "s_suppkey"]), ["k"]), "SELECT n_regionkey AS k, n_name, s_suppkey FROM nation JOIN supplier ON n_regionkey = s_nationkey % 5")
_many("join_self", lambda t: t("nation").join(t("nation"), ["n_regionkey"]), "SELECT a.n_regionkey, a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
# Sort, head, top-k
_add("sort_asc_nulls_last", "lineitem", lambda f: f.with_column("k", (col("l_orderkey") + 0) / (col("l_linenumber") - 1)).select(["k"]).sort(["k"]), "SELECT (l_orderkey // NULLIF(l_linenumber - 1, 0))::BIGINT AS k FROM lineitem ORDER BY k ASC NULLS LAST")
_add("sort_desc_nulls_first", "lineitem", lambda f: f.with_column("k", (col("l_orderkey") + 0) / (col("l_linenumber") - 1)).select(["k"]).sort(["k"], False), "SELECT (l_orderkey // NULLIF(l_linenumber - 1, 0))::BIGINT AS k FROM lineitem ORDER BY k DESC NULLS FIRST")
_add("sort_multi", "part", lambda f: f.sort(["p_brand", "p_partkey"]), "SELECT * FROM part ORDER BY p_brand, p_partkey")
_add("topk", "orders", lambda f: f.sort(["o_totalprice", "o_orderkey"], False).head(25), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
_add("head_zero", "orders", lambda f: f.head(0), "SELECT * FROM orders LIMIT 0")


# Construction, sinks
def _columns(spark: SparkSession, _sf: str, as_map: bool) -> DataFrame:
    pairs = [("k", [1, 2, None]), ("b", ["x", "", None]), ("a", [0.5, None, -1.0])]
    return readers.columns_frame(dict(pairs) if as_map else pairs, spark)


QUERIES["from_columns_list"] = lambda spark, sf: _columns(spark, sf, False)
QUERIES["from_columns_dict"] = lambda spark, sf: _columns(spark, sf, True)
SQL["from_columns_list"] = SQL["from_columns_dict"] = "SELECT CAST(k AS BIGINT) AS k, b, CAST(a AS DOUBLE) AS a FROM (VALUES (1, 'x', 0.5), (2, '', NULL), (NULL, NULL, -1.0)) t(k, b, a)"


QUERIES["from_columns_arrow"] = lambda spark, sf: EagerFrame(pa.table({"k": [1, 2, None], "b": ["x", "", None], "a": [0.5, None, -1.0]})).df
QUERIES["empty_frame"] = lambda spark, sf: spark.createDataFrame([(f.num_rows(), f.num_cols()) for f in [EagerFrame()]], "n_rows long, n_cols long")
SQL["from_columns_arrow"], SQL["empty_frame"] = SQL["from_columns_list"], "SELECT 0::BIGINT AS n_rows, 0::BIGINT AS n_cols"


def _shared(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a local master may do with a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sink-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base}/sink-{uuid.uuid4().hex}"


def _round_trip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    to, nation = _shared(spark), _table(spark, sf, "nation")
    if kind == "csv":
        nation.sink_csv(to)
        return readers.csv_frame(to, nation.schema(), spark)
    nation.sink_parquet(to)
    return readers.parquet_frame(to, spark)


def _eager_round_trip(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Eager read, write in one file and read again; CSV types are inferred."""
    to, orders = _shared(spark), readers.read_parquet(f"{sf}/orders.parquet", spark)
    picked = orders.select(["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    if kind == "csv":
        picked.write_csv(to, single_file=True)
        return readers.read_csv(to, spark=spark).df
    picked.write_parquet(to, chunk_size=5000, single_file=True)
    return readers.read_parquet(to, spark).df


QUERIES["csv_roundtrip"] = lambda spark, sf: _round_trip(spark, sf, "csv")
QUERIES["parquet_roundtrip"] = lambda spark, sf: _round_trip(spark, sf, "parquet")
SQL["csv_roundtrip"] = SQL["parquet_roundtrip"] = "SELECT * FROM nation"
QUERIES["eager_csv_inferred"] = lambda spark, sf: _eager_round_trip(spark, sf, "csv")
QUERIES["eager_parquet"] = lambda spark, sf: _eager_round_trip(spark, sf, "parquet")
SQL["eager_csv_inferred"] = SQL["eager_parquet"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
QUERIES["collect_head"] = lambda spark, sf: _table(spark, sf, "orders").sort(["o_orderkey"]).collect().head().df
SQL["collect_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"


# Pipelines
def flagship(f: LazyFrame) -> LazyFrame:
    return f.filter(col("l_discount") > 0.05).group_by(["l_returnflag", "l_linestatus"]).aggregate([("qty", col("l_quantity").sum()), ("mean_qty", col("l_quantity").mean()), ("n", col("l_orderkey").count())]).sort(["l_returnflag", "l_linestatus"])


_add("pipeline_pricing", "lineitem", flagship, "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, AVG(l_quantity) AS mean_qty, COUNT(l_orderkey) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2 ORDER BY 1, 2")
_many("pipeline_segments", lambda t: t("orders").filter(col("o_totalprice") > 1000.0).select_exprs([col("o_custkey").alias("key"), col("o_orderkey")]).join(t("customer").select_exprs([col("c_custkey").alias("key"), col("c_mktsegment"), col("c_acctbal")]).filter(col("c_acctbal") > 0.0), ["key"]).group_by(["c_mktsegment"]).aggregate([("o_orderkey", "count"), ("c_acctbal", "max")]).sort(["c_mktsegment"]), "SELECT c_mktsegment, COUNT(o_orderkey) AS o_orderkey_count, MAX(c_acctbal) AS c_acctbal_max FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_acctbal > 0 GROUP BY 1 ORDER BY 1")
_many("pipeline_top_orders", lambda t: t("lineitem").with_column("k", col("l_orderkey") + 0).group_by(["k"]).aggregate([("q", col("l_quantity").sum()), ("lines", col("l_linenumber").count())]).join(t("orders").select_exprs([col("o_orderkey").alias("k"), col("o_orderstatus")]), ["k"]).filter(col("lines") > 2).sort(["q", "k"], False).head(40), "SELECT k, q, lines, o_orderstatus FROM (SELECT l_orderkey AS k, SUM(l_quantity) AS q, COUNT(l_linenumber) AS lines FROM lineitem GROUP BY 1) JOIN orders ON k = o_orderkey WHERE lines > 2 ORDER BY q DESC, k DESC LIMIT 40")
_many("pipeline_events", lambda t: t("events").filter(col("event_type") != "view").with_column("dear", col("value") > 50.0).group_by(["event_type", "dear"]).aggregate([("event_id", "count"), ("value", "max"), ("user_id", "min")]).sort(["event_type", "dear"]), "SELECT event_type, value > 50 AS dear, COUNT(event_id) AS event_id_count, MAX(value) AS value_max, MIN(user_id) AS user_id_min FROM events WHERE event_type <> 'view' GROUP BY 1, 2 ORDER BY 1, 2")
