"""Set-based parts of the recommendation enrichment.

The network call itself is not rebuilt (see README). What remains is relational: pick
the candidates, render one request text per candidate as a column, parse a table of
replies, and attach the parsed replies to the leaks with a null-safe join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costsieve.operators.ranking import join_back

# ---- fixed values: candidate rule and request template ----
ENRICH_SEVERITIES = ["HIGH", "MEDIUM"]
ENRICH_MAX = 10
PROMPT_FIELDS = ["leak_type", "provider", "service", "resource_id", "reason", "severity",
                 "estimated_monthly_waste", "confidence"]
PROMPT_NUMBERS = ["estimated_monthly_waste"]
PROMPT_HEAD = (
    "You are a senior AWS FinOps engineer reviewing a cloud cost leak finding.\n\n"
    "Leak details:\n"
)
PROMPT_TAIL = (
    "\n\nRespond with a JSON object ONLY — no preamble, no markdown fences.\n"
    "Use exactly these keys:\n"
    "{\n"
    '  "root_cause": "<one sentence: why does this leak exist>",\n'
    '  "fix_command": "<exact AWS CLI command or console action to remediate>",\n'
    '  "estimated_remediation_minutes": <integer>,\n'
    '  "risk_level": "<LOW|MEDIUM|HIGH>",\n'
    '  "risk_note": "<one sentence: what could go wrong when fixing this>",\n'
    '  "priority_reason": "<one sentence: why act now or why it can wait>"\n'
    "}\n"
)
RECOMMENDATION = T.StructType([
    T.StructField("root_cause", T.StringType()),
    T.StructField("fix_command", T.StringType()),
    T.StructField("estimated_remediation_minutes", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("risk_note", T.StringType()),
    T.StructField("priority_reason", T.StringType()),
])
# ---- end of fixed values ----

LEAK_KEY = ["leak_type", "provider", "service", "resource_id"]


def enrich_candidates(leaks: DataFrame, n: int = ENRICH_MAX, order_col: str = "first_key") -> DataFrame:
    """G1: the first n HIGH/MEDIUM leaks in list order (no re-sort by severity)."""
    return leaks.where(F.col("severity").isin(*ENRICH_SEVERITIES)).orderBy(order_col).limit(n)


def json_value(c: Column, number: bool = False) -> Column:
    """JSON text of one scalar as Python's ``json.dumps`` writes it: null for null, numbers
    without an exponent below 1e16, and characters beyond ASCII as \\u escapes."""
    if number:
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%s", c.cast("decimal(38,18)").cast("string")), "0+$", ""), r"\.$", ".0")
        return F.coalesce(F.when(F.abs(c).between(1e-4, 1e16) | (c == 0), plain).otherwise(F.lower(c.cast("string"))), F.lit("null"))
    quoted = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    # one UTF-16 unit after the other, as \u and four digits
    unit = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(....)", r"\\u$1")
    escaped = F.array_join(F.transform(F.split(quoted, ""), lambda x: F.when(F.octet_length(x) > 1, unit(x)).otherwise(x)), "")
    return F.when(c.isNull(), "null").when(F.octet_length(quoted) == F.length(quoted), quoted).otherwise(escaped)


def prompt_text() -> Column:
    """The request text for one leak: template around an indented JSON of 8 fields."""
    parts = []
    for i, name in enumerate(PROMPT_FIELDS):
        sep = "," if i < len(PROMPT_FIELDS) - 1 else ""
        parts += [F.lit(f'  "{name}": '), json_value(F.col(name), name in PROMPT_NUMBERS), F.lit(sep + "\n")]
    body = F.concat(F.lit("{\n"), *parts, F.lit("}"))
    return F.concat(F.lit(PROMPT_HEAD), body, F.lit(PROMPT_TAIL))


def enrich_prompts(candidates: DataFrame) -> DataFrame:
    """One request row per candidate (the batch request table)."""
    return candidates.select(*LEAK_KEY, prompt_text().alias("prompt"))


def parse_recommendations(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Strip code fences, parse the six keys; text that is not a JSON object -> all null."""
    no_fence = F.regexp_replace(F.regexp_replace(F.col(text_col), "```json", ""), "```", "")
    raw = F.regexp_replace(no_fence, r"^\s+|\s+$", "")  # Python str.strip()
    is_obj = raw.startswith("{") & raw.endswith("}")
    parsed = F.when(is_obj, F.from_json(raw, RECOMMENDATION, {"mode": "PERMISSIVE"}))
    return replies.select(*LEAK_KEY, parsed.alias("llm_recommendation"))


def attach_recommendations(leaks: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Left join on (leak_type, provider, service, resource_id), null-safe."""
    return join_back(leaks, recommendations.select(*LEAK_KEY, "llm_recommendation"), LEAK_KEY, "left")
