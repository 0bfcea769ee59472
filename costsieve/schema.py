"""Schemas and fixed parameters of the billing model."""

from __future__ import annotations

from pyspark.sql import types as T

REQUIRED_COLUMNS = ["date", "service", "cost"]
OWNER_KEYWORDS = ["owner", "project", "environment"]

# One fixed LEAK row shape for every detector; missing keys are NULL.
LEAK = T.StructType([
    T.StructField("leak_type", T.StringType(), False),
    T.StructField("provider", T.StringType(), True),
    T.StructField("service", T.StringType(), True),
    T.StructField("resource_id", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("z_score", T.DoubleType(), True),
    T.StructField("exact_waste", T.DoubleType(), True),
    T.StructField("detector_rank", T.IntegerType(), False),
    T.StructField("order_num", T.DoubleType(), True),
    T.StructField("order_seq", T.LongType(), True),
])

# ---- fixed values: detector names, thresholds, weights (must match the reference) ----
ZOMBIE = "ZOMBIE_RESOURCE"
IDLE = "IDLE_RESOURCE"
RUNAWAY = "RUNAWAY_COST"
ALWAYS_ON = "ALWAYS_ON_HIGH_COST"
ORPHANED = "ORPHANED_STORAGE"
IDLE_DB = "IDLE_DATABASE"
SNAPSHOT = "SNAPSHOT_SPRAWL"
UNTAGGED = "UNTAGGED_RESOURCE"
RI_SAVINGS = "RI_SAVINGS_PLAN_WASTE"
RI_UNUSED = "RI_UNUSED_RESERVATION"
RI_TYPES = [RI_SAVINGS, RI_UNUSED]

# Detector order used for dedupe (first kept) and stable ordering.
DETECTOR_RANK = {
    ZOMBIE: 1, IDLE: 2, RUNAWAY: 3, ALWAYS_ON: 4, ORPHANED: 5,
    IDLE_DB: 6, SNAPSHOT: 7, UNTAGGED: 8, RI_SAVINGS: 9, RI_UNUSED: 10,
}

ALWAYS_ON_MIN_DAILY_COST = 50.0
ALWAYS_ON_PRESENCE_RATIO = 0.9
RUNAWAY_COST_GROWTH_PERCENT = 30
RUNAWAY_MIN_DAYS = 3
RUNAWAY_MIN_DAILY_COST = 2.0
RUNAWAY_ZSCORE_THRESHOLD = 2.5
RUNAWAY_MAX_USAGE_RATIO = 10
IDLE_USAGE_RATIO_THRESHOLD = 5
IDLE_MIN_DAILY_COST = 1.0
IDLE_MIN_DAYS_ACTIVE = 3
ZOMBIE_MIN_DAYS = 14
ZOMBIE_FALLBACK_THRESHOLD = {"AWS": 0.05, "AZURE": 0.10}
ZOMBIE_FALLBACK_OTHER = 3.0
IDLE_DB_MIN_DAYS = 7
IDLE_DB_USAGE_RATIO_THRESHOLD = 0.2
IDLE_DB_MIN_DAILY_COST = 10.0
RI_MIN_WASTE_USD = 10.0
UNTAGGED_TOP_N = 20
UNTAGGED_EMPTY_VALUES = ["", "unknown", "none", "nan"]
ZSCORE_WINDOW = 7
ZSCORE_MIN_PERIODS = 3
ZSCORE_EPSILON = 0.01

LEAK_TYPE_WEIGHTS = {
    "RI_SAVINGS_PLAN_WASTE": 50,
    "RI_UNUSED_RESERVATION": 50,
    "ZOMBIE_RESOURCE": 60,
    "RUNAWAY_COST": 55,
    "ALWAYS_ON_HIGH_COST": 35,
    "IDLE_DATABASE": 30,
    "ORPHANED_STORAGE": 25,
    "IDLE_RESOURCE": 20,
    "SNAPSHOT_SPRAWL": 15,
    "UNTAGGED_RESOURCE": 10,
}
# Reason keyword groups and the points each adds.
REASON_BONUSES = [
    (["grew", "increase", "spike", "stddevs above"], 10),
    (["30 days", "60 days", "90 days", "long-running"], 10),
    (["storage", "snapshot", "backup", "egress"], 5),
    (["no ownership", "untagged"], 5),
]
LOW_SIGNAL_PENALTY = {"types": ["UNTAGGED_RESOURCE", "SNAPSHOT_SPRAWL"], "points": 5}
SEVERITY_LABELS = [(65, "HIGH"), (35, "MEDIUM"), (0, "LOW")]
SEVERITY_ACTIONS = {
    "HIGH": "Immediate investigation and remediation required",
    "MEDIUM": "Review and schedule remediation within this sprint",
    "LOW": "Monitor — clean up when convenient",
}
WASTE_MULTIPLIERS = {
    "ZOMBIE_RESOURCE": 1.0,
    "IDLE_RESOURCE": 1.0,
    "IDLE_DATABASE": 1.0,
    "ALWAYS_ON_HIGH_COST": 1.0,
    "RUNAWAY_COST": 0.3,
    "ORPHANED_STORAGE": 0.5,
    "SNAPSHOT_SPRAWL": 0.3,
    "UNTAGGED_RESOURCE": 0.2,
}
DEFAULT_WASTE_MULTIPLIER = 0.2
LEAK_PRIORITY = {
    "RI_SAVINGS_PLAN_WASTE": 120,
    "RI_UNUSED_RESERVATION": 120,
    "RUNAWAY_COST": 100,
    "ALWAYS_ON_HIGH_COST": 90,
    "ZOMBIE_RESOURCE": 80,
    "IDLE_DATABASE": 70,
    "IDLE_RESOURCE": 60,
    "ORPHANED_STORAGE": 50,
    "SNAPSHOT_SPRAWL": 40,
    "UNTAGGED_RESOURCE": 30,
}
CURRENCY_RATES = {"USD": 1.0, "EUR": 0.92, "INR": 83.5}
# ---- end of fixed values ----
