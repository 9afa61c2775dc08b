"""Sources, item resolution, cohort and panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.functions.durable import shared_folder
from foretrace.operators import cohort as C
from foretrace.operators import items, panel
from foretrace.plans import standin as S
from foretrace.plans.registry import register
from foretrace.settings import CHART_SOURCE, LAB_SOURCE, CohortRules, Variable
from foretrace.sources import sinks, tables

ITEM_VARIABLES = [
    Variable("ring", CHART_SOURCE, ("RING",), ("hot", "old")),
    Variable("plate_or_rod", CHART_SOURCE, ("plate", "r_d"), ("small",)),
    Variable("exact_gear", CHART_SOURCE, ("Red Gear",), match="exact"),
    Variable("nothing", CHART_SOURCE, ("no such label",)),
    Variable("bolt", LAB_SOURCE, ("bolt",), ("cold",), fluids=("promo", "Small")),
    Variable("gizmo", LAB_SOURCE, ("gizmo",)),
]


def dictionary(spark, sf):
    return S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"), F.col("p_type").alias("fluid"))


def item_mapping(spark, sf):
    d = dictionary(spark, sf)
    return items.resolve(d, ITEM_VARIABLES, CHART_SOURCE).unionByName(items.resolve(d, ITEM_VARIABLES, LAB_SOURCE))


MAPPING_SQL = f"""
SELECT 'ring' AS variable, '{CHART_SOURCE}' AS source, p_partkey AS itemid, p_name AS label FROM part
WHERE p_name ILIKE '%RING%' AND NOT contains(lower(p_name), 'hot') AND NOT contains(lower(p_name), 'old')
UNION ALL SELECT 'plate_or_rod', '{CHART_SOURCE}', p_partkey, p_name FROM part
WHERE (p_name ILIKE '%plate%' OR p_name ILIKE '%r_d%') AND NOT contains(lower(p_name), 'small')
UNION ALL SELECT 'exact_gear', '{CHART_SOURCE}', p_partkey, p_name FROM part WHERE p_name ILIKE 'Red Gear'
UNION ALL SELECT 'bolt', '{LAB_SOURCE}', p_partkey, p_name FROM part
WHERE p_name ILIKE '%bolt%' AND NOT contains(lower(p_name), 'cold') AND lower(p_type) IN ('promo', 'small')
UNION ALL SELECT 'gizmo', '{LAB_SOURCE}', p_partkey, p_name FROM part WHERE p_name ILIKE '%gizmo%'"""


@register("csv_scan_tolerant", "p_partkey:i p_name:s p_retailprice:d",
          "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <= 45")
def csv_scan(spark, sf):
    """The dictionary as gzip CSV in which some rows do not parse."""
    folder = scratch(spark, "csv")
    bad = F.when(F.col("p_size") > 45, F.lit("not a number")).otherwise(F.col("p_partkey").cast("string"))
    S.table(spark, sf, "part").select(bad.alias("p_partkey"), "p_name", "p_retailprice").write.option(
        "header", True).option("compression", "gzip").csv(f"{folder}/part.csv.gz")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
                           T.StructField("p_retailprice", T.DoubleType())])
    return tables.read_table(spark, folder, "part", schema)


def scratch(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("items_resolved", "variable:s source:s itemid:i label:s", MAPPING_SQL)
def items_resolved(spark, sf):
    return item_mapping(spark, sf)


@register("items_per_variable", "variable:s source:s n_items:i", f"""
SELECT v.variable, v.source, count(m.itemid) AS n_items FROM (VALUES {", ".join(f"('{v.name}', '{v.source}')" for v in ITEM_VARIABLES)}) v(variable, source)
LEFT JOIN ({MAPPING_SQL}) m ON m.variable = v.variable GROUP BY ALL""")
def items_per_variable(spark, sf):
    return items.with_unmatched(item_mapping(spark, sf), ITEM_VARIABLES)


@register("drug_items", "itemid:i", """
SELECT DISTINCT p_partkey AS itemid FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE '%anvil%'""")
def drug_items(spark, sf):
    return items.item_ids(dictionary(spark, sf), ["Ring", "anvil"])


@register("mapping_store", "variable:s source:s itemid:i label:s", MAPPING_SQL)
def mapping_store(spark, sf):
    path = scratch(spark, "mapping")
    sinks.write_mapping(item_mapping(spark, sf), path)
    return sinks.read_mapping(spark, path)


# Orders as stays: length and age follow from the order and customer rows.
def order_stays(spark, sf):
    hours = (F.floor("o_totalprice") % 200).cast("int")
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") * 7 % 60).cast("int"))
    end = start + F.make_dt_interval(F.lit(0), hours, (F.col("o_orderkey") * 13 % 60).cast("int"))
    return S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"),
        start.alias("intime"), end.alias("outtime"))


def order_eligible(spark, sf, first=True):
    patients = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.floor(F.col("c_acctbal") / 100).alias("anchor_age"))
    admissions = S.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("hadm_id"))
    return C.eligible_stays(order_stays(spark, sf), patients, admissions, CohortRules(48, 18, first))


ORDER_STAYS = """
SELECT o_custkey AS subject_id, o_orderkey AS stay_id, o_orderstatus, s AS intime,
  s + to_hours(CAST(floor(o_totalprice) % 200 AS BIGINT)) + to_minutes(o_orderkey*13 % 60) AS outtime
FROM (SELECT *, o_orderdate + to_minutes(o_orderkey*7 % 60) AS s FROM orders)"""
ELIGIBLE = """
SELECT st.subject_id, st.stay_id, st.intime, st.outtime, st.los_hours, CAST(floor(c.c_acctbal/100) AS BIGINT) AS age
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS rn FROM (
  SELECT *, date_diff('hour', intime, outtime) AS los_hours FROM (""" + ORDER_STAYS + """))
  WHERE los_hours >= 48) st
JOIN customer c ON c.c_custkey = st.subject_id
WHERE floor(c.c_acctbal/100) >= 18 AND st.o_orderstatus <> 'P'"""


@register("eligible_first_stays", "subject_id:i stay_id:i los_hours:i age:i", ELIGIBLE + " AND rn = 1")
def eligible_first(spark, sf):
    return order_eligible(spark, sf).withColumnRenamed("age_at_admission", "age")


@register("eligible_all_stays", "subject_id:i stay_id:i los_hours:i age:i", ELIGIBLE)
def eligible_all(spark, sf):
    return order_eligible(spark, sf, first=False).withColumnRenamed("age_at_admission", "age")


@register("stay_length_hours", "los_hours:i n:i",
          f"SELECT date_diff('hour', intime, outtime) AS los_hours, count(*) AS n FROM ({ORDER_STAYS}) GROUP BY 1")
def stay_length(spark, sf):
    from foretrace.functions.cells import hours_crossed

    return order_stays(spark, sf).groupBy(hours_crossed("intime", "outtime").alias("los_hours")).agg(F.count(F.lit(1)).alias("n"))


DAYS = 60


def line_events(spark, sf, key="stay_id"):
    return S.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(key), F.col("l_partkey").alias("itemid"), F.col("l_shipdate").alias("charttime"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("valuenum"))


def line_stays(spark, sf):
    return S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("intime"))


WINDOWED = f"""
SELECT l_orderkey AS k, l_partkey AS itemid, l_shipdate AS t, l_quantity AS value, o_orderdate FROM lineitem
JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL {DAYS} DAY"""


def _days(events, sf, spark, key):
    return events.join(line_stays(spark, sf).select(key, "intime"), key)


@register("chart_events_in_window", "stay_id:i itemid:i day:i value:d", f"""
SELECT k AS stay_id, itemid, date_diff('day', DATE '1995-01-01', t) AS day, value
FROM (SELECT w.*, l_returnflag FROM ({WINDOWED.replace('l_quantity AS value', 'l_quantity AS value, l_returnflag')}) w)
WHERE l_returnflag <> 'N' AND itemid IN (SELECT itemid FROM ({MAPPING_SQL}) WHERE source = '{CHART_SOURCE}')""")
def chart_events(spark, sf):
    wanted = item_mapping(spark, sf).filter(F.col("source") == CHART_SOURCE)
    out = C.extract_events(line_events(spark, sf), wanted, line_stays(spark, sf), DAYS * 24,
                           item_ids=items.pushable_ids(wanted))
    return out.select("stay_id", "itemid", F.date_diff("charttime", F.lit("1995-01-01").cast("date")).alias("day"),
                      F.col("valuenum").alias("value"))


@register("lab_events_in_window", "hadm_id:i itemid:i day:i value:d", f"""
SELECT k AS hadm_id, itemid, date_diff('day', DATE '1995-01-01', t) AS day, value
FROM ({WINDOWED.replace('l_quantity AS value', 'l_quantity AS value, l_returnflag')})
WHERE l_returnflag <> 'N' AND itemid IN (SELECT itemid FROM ({MAPPING_SQL}) WHERE source = '{LAB_SOURCE}')""")
def lab_events(spark, sf):
    wanted = item_mapping(spark, sf).filter(F.col("source") == LAB_SOURCE)
    out = C.extract_events(line_events(spark, sf, "hadm_id"), wanted, line_stays(spark, sf), DAYS * 24, key="hadm_id")
    return out.select("hadm_id", "itemid", F.date_diff("charttime", F.lit("1995-01-01").cast("date")).alias("day"),
                      F.col("valuenum").alias("value"))


@register("drug_events_in_window", "stay_id:i itemid:i day:i", f"""
SELECT k AS stay_id, itemid, date_diff('day', DATE '1995-01-01', t) AS day FROM ({WINDOWED})
WHERE itemid IN (SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_name ILIKE '%anvil%')""")
def drug_events(spark, sf):
    starts = line_events(spark, sf).withColumnRenamed("charttime", "starttime")
    wanted = items.item_ids(dictionary(spark, sf), ["Ring", "anvil"])
    out = C.extract_events(starts, wanted, line_stays(spark, sf), DAYS * 24, time_col="starttime", value_col=None)
    return out.select("stay_id", "itemid", F.date_diff("starttime", F.lit("1995-01-01").cast("date")).alias("day"))


@register("events_store_by_window", "stay_id:i itemid:i value:d", f"""
SELECT k AS stay_id, itemid, value FROM ({WINDOWED.replace('l_quantity AS value', 'l_quantity AS value, l_returnflag')})
WHERE l_returnflag <> 'N' AND itemid IN (SELECT itemid FROM ({MAPPING_SQL}))""")
def events_store(spark, sf):
    root = scratch(spark, "events")
    events = C.extract_events(line_events(spark, sf), item_mapping(spark, sf), line_stays(spark, sf), DAYS * 24)
    sinks.write_events(events, root, "chart", DAYS * 24, cluster_by="stay_id")
    return sinks.read_events(spark, root, "chart", DAYS * 24).withColumnRenamed("valuenum", "value")


@register("aligned_offsets", "stay_id:i variable:s offset:d value:d", 'SELECT stay_id, variable, "offset", value FROM aligned')
def aligned_offsets(spark, sf):
    return S.aligned(spark, sf)


@register("invalid_values_per_variable", "variable:s n_dropped:i",
          "SELECT variable, count(*) AS n_dropped FROM aligned WHERE value < 0.1 OR value > 300 GROUP BY 1")
def invalid_values(spark, sf):
    return panel.invalid_counts(S.aligned(spark, sf), S.VARIABLES)


@register("valid_values", "stay_id:i variable:s offset:d value:d", 'SELECT stay_id, variable, "offset", value FROM clean')
def valid_values(spark, sf):
    return panel.drop_invalid(S.aligned(spark, sf), S.VARIABLES)


@register("range_table_shares", "variable:s in_valid:d in_hard:d", """
SELECT variable, avg(CAST(value BETWEEN 0.1 AND 300 AS DOUBLE)) AS in_valid,
  avg(CAST(value >= 0 AND (variable <> 'purchase' OR value <= 180) AS DOUBLE)) AS in_hard FROM aligned GROUP BY 1""")
def range_shares(spark, sf):
    ranges = panel.range_table(spark, S.VARIABLES)
    inside = lambda lo, hi: ((F.col("value") >= F.coalesce(F.col(lo), F.lit(float("-inf"))))
                             & (F.col("value") <= F.coalesce(F.col(hi), F.lit(float("inf"))))).cast("double")
    return S.aligned(spark, sf).join(F.broadcast(ranges), "variable").groupBy("variable").agg(
        F.avg(inside("valid_lo", "valid_hi")).alias("in_valid"), F.avg(inside("hard_lo", "hard_hi")).alias("in_hard"))


@register("panel_resampled", "stay_id:i variable:s hour:i value:d", "SELECT * FROM panel")
def panel_resampled(spark, sf):
    return panel.resample(panel.drop_invalid(S.aligned(spark, sf), S.VARIABLES))


@register("coverage_all", "stay_id:i coverage:d", "SELECT * FROM covered")
def coverage_all(spark, sf):
    return C.coverage(S.Workspace(spark, sf).panel, len(S.VARIABLES), S.WINDOWS, S.COVERAGE)


@register("coverage_vitals_and_labs", "stay_id:i coverage:d labs_seen:i", """
SELECT stay_id, count(*) FILTER (variable IN ('click', 'signup', 'view'))/90.0 AS coverage,
  count(DISTINCT variable) FILTER (variable IN ('error', 'purchase') AND hour < 15) AS labs_seen
FROM panel GROUP BY stay_id
HAVING count(*) FILTER (variable IN ('click', 'signup', 'view'))/90.0 >= 0.35
  AND count(DISTINCT variable) FILTER (variable IN ('error', 'purchase') AND hour < 15) = 2""")
def coverage_labs(spark, sf):
    return C.coverage_vitals_labs(S.Workspace(spark, sf).panel, S.VARIABLES, S.WINDOWS, 0.35)


@register("stays_sampled", "stay_id:i", """
SELECT stay_id FROM stays ORDER BY md5('sample-42:' || stay_id), stay_id LIMIT 50""")
def stays_sampled(spark, sf):
    return C.sample_stays(S.stays(spark, sf), 50, S.SEED)


@register("cohort_splits", "stay_id:i split:s", "SELECT stay_id, split FROM cohort")
def cohort_splits(spark, sf):
    return S.Workspace(spark, sf).cohort


@register("validation_subsets", "stay_id:i subset:s", "SELECT * FROM subsets")
def validation_subsets(spark, sf):
    return S.Workspace(spark, sf).subsets


@register("panel_of_split", "stay_id:i variable:s hour:i value:d",
          "SELECT p.* FROM panel p SEMI JOIN (SELECT stay_id FROM cohort WHERE split = 'val') USING (stay_id)")
def panel_of_split(spark, sf):
    ws = S.Workspace(spark, sf)
    return C.route(ws.panel, ws.cohort, "val")


@register("cohort_panel_store", "split:s variable:s n_cells:i total:d", """
SELECT split, variable, count(*) AS n_cells, sum(value) AS total FROM panel JOIN cohort USING (stay_id) GROUP BY ALL""")
def cohort_panel_store(spark, sf):
    root = scratch(spark, "cohort")
    ws = S.Workspace(spark, sf)
    sinks.write_cohort_and_panel(ws.cohort, ws.panel, root)
    stays, cells = sinks.read_cohort_and_panel(spark, root)
    return cells.join(stays.select("stay_id", "split"), "stay_id").groupBy("split", "variable").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))
