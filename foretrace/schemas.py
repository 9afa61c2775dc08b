"""Fixed table schemas; scans never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "string": T.StringType(), "timestamp": T.TimestampType(),
    }
    pairs = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


STAYS = _fields("subject_id long, hadm_id long, stay_id long, intime timestamp, outtime timestamp")
PATIENTS = _fields("subject_id long, anchor_age int, anchor_year int")
ADMISSIONS = _fields("hadm_id long, admittime timestamp")
CHART_EVENTS = _fields("stay_id long, itemid long, charttime timestamp, valuenum double")
LAB_EVENTS = _fields("hadm_id long, itemid long, charttime timestamp, valuenum double")
DRUG_EVENTS = _fields("stay_id long, itemid long, starttime timestamp")
CHART_ITEMS = _fields("itemid long, label string, category string, param_type string, unitname string")
LAB_ITEMS = _fields("itemid long, label string, fluid string, category string")
MAPPING = _fields("variable string, source string, itemid long, label string")
PANEL = _fields("stay_id long, variable string, hour int, value double")
FORECASTS = _fields(
    "run string, condition string, stay_id long, variable string, hour int, "
    "y_true double, y_pred double, y_lower double, y_upper double, y_raw double, fingerprint string"
)
