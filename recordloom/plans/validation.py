"""Constraints over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.common import read
from recordloom.operators import triples as T
from recordloom.operators import validate as V
from recordloom.plans.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.query


def _rules() -> list[tuple[str, str, list[V.Constraint]]]:
    v = F.col
    return [
        ("orders", "o_orderkey", [
            V.Constraint("status_in", V.one_of("o_orderstatus", ["O", "F"]), v("o_orderstatus")),
            V.Constraint("price_range", V.in_range("o_totalprice", 1000, 450000), F.round("o_totalprice", 2), "warning"),
            V.Constraint("priority_pattern", V.pattern("o_orderpriority", "^[1-3]-"), v("o_orderpriority"), "info"),
        ]),
        ("lineitem", "l_orderkey", [
            V.Constraint("quantity_or_discount", V.any_of(V.in_range("l_quantity", 1, 45), V.in_range("l_discount", 0.05)), F.round("l_quantity", 2)),
            V.Constraint("one_flag", V.exactly_one(V.one_of("l_returnflag", ["R"]), V.one_of("l_linestatus", ["O"]), V.in_range("l_tax", 0.07)), v("l_returnflag"), "warning"),
            V.Constraint("not_returned_open", V.negated(V.one_of("l_returnflag", ["A"]) & V.one_of("l_linestatus", ["O"])), v("l_linestatus")),
        ]),
        ("observations", "obs_id", [
            V.Constraint("status_required", V.required("status"), v("status")),
            V.Constraint("unit_length", V.length_between("quantity_unit", 1, 10), v("quantity_unit"), "info"),
            V.Constraint("value_datatype", V.datatype("value_string", "double"), v("value_string"), "warning"),
        ]),
        ("records", "ord", [
            V.Constraint("closed", V.closed("properties", ["clinical:sourceEHR", "clinical:effectiveDate", "clinical:status"]) | F.lit(False), v("record_type")),
        ]),
    ]


_SQL = """v AS (
  SELECT 'orders' AS table_name, o_orderkey::VARCHAR AS focus, 'status_in' AS rule, 'violation' AS severity, o_orderstatus AS value FROM orders WHERE NOT o_orderstatus IN ('O', 'F')
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'price_range', 'warning', round(o_totalprice, 2)::VARCHAR FROM orders WHERE NOT (o_totalprice >= 1000 AND o_totalprice <= 450000)
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'priority_pattern', 'info', o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')
  UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR, 'quantity_or_discount', 'violation', round(l_quantity, 2)::VARCHAR FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45 OR l_discount >= 0.05)
  UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR, 'one_flag', 'warning', l_returnflag FROM lineitem WHERE NOT ((l_returnflag = 'R')::INT + (l_linestatus = 'O')::INT + (l_tax >= 0.07)::INT = 1)
  UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR, 'not_returned_open', 'violation', l_linestatus FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'
  UNION ALL SELECT 'observations', obs_id::VARCHAR, 'status_required', 'violation', NULL FROM observations WHERE status IS NULL
  UNION ALL SELECT 'observations', obs_id::VARCHAR, 'unit_length', 'info', quantity_unit FROM observations WHERE NOT (length(quantity_unit) BETWEEN 1 AND 10)
  UNION ALL SELECT 'observations', obs_id::VARCHAR, 'value_datatype', 'warning', value_string FROM observations WHERE value_string IS NOT NULL AND try_cast(value_string AS DOUBLE) IS NULL
  UNION ALL SELECT 'records', ord::VARCHAR, 'closed', 'violation', record_type FROM records WHERE len(list_filter(map_keys(properties), lambda k: NOT list_contains(['clinical:sourceEHR', 'clinical:effectiveDate', 'clinical:status'], k))) > 0)"""


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, key, rules in _rules():
        found = V.violations(read(spark, sf, table), F.col(key), table, rules)
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {_SQL} SELECT * FROM v")
def shape_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _violations(spark, sf)


@query(f"WITH {_SQL} SELECT table_name, rule, severity, count(*) AS n, count(DISTINCT focus) AS n_focus FROM v GROUP BY ALL")
def severity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _violations(spark, sf).groupBy("table_name", "rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("focus").alias("n_focus"))


@query(
    "SELECT 'observations' AS table_name, obs_id::VARCHAR AS focus, 'code_class' AS rule, 'violation' AS severity, code AS value FROM observations WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM measures WHERE code IS NOT NULL)"
)
def shape_class(spark: SparkSession, sf: str) -> DataFrame:
    return V.missing_class(read(spark, sf, "observations"), F.col("obs_id"), "observations", "code_class", "code", read(spark, sf, "measures"), "code")


@query(
    """WITH t AS (SELECT DISTINCT subject_uri AS s, predicate AS p, object_uri AS o FROM record_edges)
    SELECT s, n FROM (SELECT x.s, count(t.o) AS n FROM (SELECT DISTINCT s FROM t) x LEFT JOIN t ON t.s = x.s AND t.p = 'clinical:hasLabResult' GROUP BY x.s) WHERE n > 1"""
)
def shape_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "record_edges").select(F.col("subject_uri").alias("s"), F.col("predicate").alias("p"), F.col("object_uri").alias("o"))
    return V.cardinality(t, t.select("s").distinct(), "clinical:hasLabResult", 0, 1)


@query(
    "SELECT record_type AS type, count(DISTINCT uri) AS n_subjects, record_type IN ('clinical:LabResultRecord', 'clinical:ConditionRecord') AS shaped FROM records WHERE record_type IS NOT NULL GROUP BY record_type"
)
def shape_coverage(spark: SparkSession, sf: str) -> DataFrame:
    types = read(spark, sf, "records").where("record_type IS NOT NULL").select(F.col("uri").alias("s"), F.col("record_type").alias("type"))
    shaped = spark.createDataFrame([("clinical:LabResultRecord",), ("clinical:ConditionRecord",)], "type string")
    return V.coverage(types, shaped)


@query("SELECT status, count(*) AS n, count(*) FILTER (n_props = 0) AS n_empty FROM (SELECT CASE WHEN tombstoned_at IS NULL THEN 'live' ELSE 'deleted' END AS status, len(map_keys(properties)) AS n_props FROM records) GROUP BY status")
def record_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").select(F.when(F.col("tombstoned_at").isNull(), "live").otherwise("deleted").alias("status"), F.size(F.map_keys("properties")).alias("n_props"))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("n_props") == 0).alias("n_empty"))
