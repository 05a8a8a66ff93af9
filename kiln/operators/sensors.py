"""Sensor pipeline: schema mapping, failure derivation and physical labelling.

B1-B6, E1, E2, H7, H8, H12.  Every rule is a column expression, so labelling a
table is one narrow stage (no shuffle) that stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.text import fixed_map
from kiln.operators.indexing import row_index

# --- fixed values -----------------------------------------------------------
NO_FAILURE = "No Failure"
TOOL_WEAR = "Tool Wear Failure"
HEAT_DISSIPATION = "Heat Dissipation Failure"
POWER = "Power Failure"
OVERSTRAIN = "Overstrain Failure"
RANDOM = "Random Failure"
# raw flag -> failure type, in priority order (first active flag wins)
FAILURE_PRIORITY = [
    ("twf", TOOL_WEAR),
    ("hdf", HEAT_DISSIPATION),
    ("pwf", POWER),
    ("osf", OVERSTRAIN),
    ("rnf", RANDOM),
]
# machine -> quality type
MACHINE_TYPE = {
    "CNC-01": "H", "CNC-02": "H", "CNC-03": "H",
    "CONV-01": "M", "CONV-02": "M",
    "PRESS-01": "L",
}
# quality type -> machines, assigned round robin within the type
TYPE_TO_MACHINES = {
    "H": ["CNC-01", "CNC-02", "CNC-03"],
    "M": ["CONV-01", "CONV-02"],
    "L": ["PRESS-01"],
}
# overstrain limit (wear x torque) per type: current and older rule sets
OSF_LIMITS_V3 = {"H": 7000, "M": 8500, "L": 10000}
OSF_LIMITS_V2 = {"H": 10000, "M": 11500, "L": 13000}
# physical rule thresholds
TOOL_WEAR_LIMIT_MIN = 200
HEAT_DT_LIMIT_K = 8.6
HEAT_RPM_LIMIT = 1380
POWER_MIN_W = 3500
POWER_MAX_W = 9000
# series start of the mapped sensor log
SERIES_START = "2026-01-01 00:00:00"
# -----------------------------------------------------------------------------

FEATURES = ["air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"]


def omega(rpm: Column) -> Column:
    """H7: angular speed in rad/s."""
    return rpm * 2 * F.lit(math.pi) / 60


def physics_features(df: DataFrame) -> DataFrame:
    """H7: power (W), temperature difference (K) and strain (wear x torque)."""
    return df.select(
        "*",
        (F.col("torque_nm") * omega(F.col("rotational_speed_rpm"))).alias("power_w"),
        (F.col("process_temperature_k") - F.col("air_temperature_k")).alias("delta_t_k"),
        (F.col("tool_wear_min") * F.col("torque_nm")).alias("strain"),
    )


def clip(c: Column, lo, hi) -> Column:
    """H8."""
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def machine_type(machine_id: Column) -> Column:
    """Machine -> H/M/L."""
    return fixed_map(MACHINE_TYPE)[machine_id]


def label_rule(limits: dict[str, int] | None = None, acceptance: float | None = None,
               key: Column | None = None) -> Column:
    """First matching physical rule, else "No Failure".

    ``acceptance`` (optional) keeps a rule hit only when a hash of ``key`` falls
    below it -- a deterministic stand-in for label noise.
    """
    limit = fixed_map(limits or OSF_LIMITS_V3)[machine_type(F.col("machine_id"))]
    rpm = F.col("rotational_speed_rpm")
    power = F.col("torque_nm") * omega(rpm)
    dt = F.col("process_temperature_k") - F.col("air_temperature_k")
    accept = F.lit(True)
    if acceptance is not None:
        accept = (F.abs(F.xxhash64(key)) % 1_000_000) < int(acceptance * 1_000_000)
    return (F.when((F.col("tool_wear_min") > TOOL_WEAR_LIMIT_MIN) & accept, F.lit(TOOL_WEAR))
            .when((dt < HEAT_DT_LIMIT_K) & (rpm < HEAT_RPM_LIMIT) & accept, F.lit(HEAT_DISSIPATION))
            .when(((power < POWER_MIN_W) | (power > POWER_MAX_W)) & accept, F.lit(POWER))
            .when((F.col("tool_wear_min") * F.col("torque_nm") > limit) & accept, F.lit(OVERSTRAIN))
            .otherwise(F.lit(NO_FAILURE)))


def binary_target(failure_type: Column) -> Column:
    """B5."""
    return (failure_type != F.lit(NO_FAILURE)).cast("int")


def label_failures(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """B3 + B5 on a sensor table."""
    ft = label_rule(limits)
    return df.withColumn("failure_type", ft).withColumn("machine_failure", binary_target(F.col("failure_type")))


def quantize_readings(df: DataFrame) -> DataFrame:
    """Temperatures and torque to one decimal, speed and wear to integers."""
    return df.select(
        *[c for c in df.columns if c not in FEATURES],
        F.round("air_temperature_k", 1).alias("air_temperature_k"),
        F.round("process_temperature_k", 1).alias("process_temperature_k"),
        F.col("rotational_speed_rpm").cast("int").alias("rotational_speed_rpm"),
        F.round("torque_nm", 1).alias("torque_nm"),
        F.col("tool_wear_min").cast("int").alias("tool_wear_min"),
    )


def derive_failure_type(df: DataFrame, priority=FAILURE_PRIORITY) -> DataFrame:
    """B2: "No Failure" when the machine flag is 0, else the first active sub-flag;
    a failure without any sub-flag is a random failure."""
    expr = F.when(F.col("machine_failure") == 0, F.lit(NO_FAILURE))
    for flag, label in priority:
        expr = expr.when(F.col(flag) == 1, F.lit(label))
    return df.withColumn("failure_type", expr.otherwise(F.lit(RANDOM)))


def round_robin_machine(df: DataFrame, order_col: str = "row_order", type_col: str = "type",
                        candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """The i-th row of each type (in ``order_col`` order) gets candidate i mod n.

    The per-type index comes from ``row_index`` (range buckets + offsets), not a
    3-key window that would put a whole type into one task.
    """
    cand = candidates or TYPE_TO_MACHINES
    arr = F.create_map(*[x for t, ms in cand.items() for x in (F.lit(t), F.array(*[F.lit(m) for m in ms]))])
    idx = row_index(df, order_col, (type_col,), name="type_index")
    machines = arr[F.col(type_col)]
    return idx.withColumn("machine_id", F.element_at(machines, (F.col("type_index") % F.size(machines) + 1).cast("int")))


def surrogate_keys(df: DataFrame, order_col: str, prefix: str = "REC-", width: int = 5,
                   name: str = "record_id") -> DataFrame:
    """1-based zero-padded key in ``order_col`` order."""
    idx = row_index(df, order_col, (), name="_row_index")
    return (idx.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.col("_row_index") + 1))
            .withColumnRenamed("_row_index", "row_index"))


def map_machine_schema(raw: DataFrame, order_col: str = "row_order") -> DataFrame:
    """B1: raw machine readings -> sensor_log schema (keys, machines, hourly series,
    failure type).  Uses E1, E2, B2 and H12."""
    df = derive_failure_type(raw)
    df = round_robin_machine(df, order_col)
    df = surrogate_keys(df, order_col)
    ts = F.timestamp_add("HOUR", F.col("row_index"), F.lit(SERIES_START).cast("timestamp_ntz"))
    return df.select(
        "record_id", "machine_id",
        F.col("product_id").alias("original_product_id"),
        ts.alias("timestamp"),
        *FEATURES,
        F.col("machine_failure").cast("int").alias("machine_failure"),
        "failure_type",
    )
