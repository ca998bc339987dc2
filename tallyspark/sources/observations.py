"""Observation tables of 17 fields: what a row must state, and which rows a cut-off leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as e
from ..operators.returns import InputError
from ..operators.stage import written

#: Fields and values of the format: fixed values.
FIELDS = ["id", "entity", "metric", "value", "unit", "currency", "basis", "periodStart", "periodEnd", "observedAt", "publishedAt", "availableAt", "retrievedAt", "sourceUrl", "sourceVersion",
    "locator", "verification"]
TEXT = ["id", "entity", "metric", "unit", "basis", "sourceUrl", "sourceVersion", "locator"]
CURRENCIES = ("CNY", "USD", "HKD")
DECLARED = "declared-not-original-verified"
TIMES = ["observedAt", "publishedAt", "availableAt", "retrievedAt"]


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` with reason and, as ``__`` and its name, the instant that each time states, which several rules ask for and which is parsed once."""
    if set(rows.columns) != set(FIELDS):
        raise InputError(f"an observation has the fields {FIELDS}")
    c = F.col
    at = {t: c(f"__{t}") for t in TIMES}
    broken = lambda t: c(t).isNotNull() & at[t].isNull()
    blank = ~e.has_text(TEXT[0])
    for name in TEXT[1:]:
        blank = blank | ~e.has_text(name)
    period = lambda p: c(p).isNotNull() & e.strict_day(p).isNull()
    return rows.withColumns({f"__{t}": e.instant(c(t)) for t in TIMES}).withColumn(
        "reason",
        e.first_reason(
            (blank, "blank_field"),
            (~c("sourceUrl").startswith("https://") | F.coalesce(c("verification") != DECLARED, F.lit(True)), "no_declared_source"),
            (c("currency").isNotNull() & ~c("currency").isin(*CURRENCIES), "unknown_currency"),
            (~e.finite(c("value").try_cast("double")) | ~c("value").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "no_decimal"),
            (period("periodStart") | period("periodEnd") | F.coalesce(c("periodStart") > c("periodEnd"), F.lit(False)), "period"),
            (broken("observedAt") | broken("publishedAt") | broken("availableAt") | at["retrievedAt"].isNull(), "no_instant"),
            (F.coalesce(at["publishedAt"] > at["retrievedAt"], F.lit(False)), "retrieved_before_publication"),
            (F.coalesce(at["availableAt"] < at["publishedAt"], F.lit(False)), "available_before_publication"),
        ),
    )


def reason(rows: DataFrame) -> DataFrame:
    """``rows`` with reason: the first rule that a row breaks, or null."""
    return _read(rows).drop(*(f"__{t}" for t in TIMES))


def validated(rows: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(ids that the cut-off leaves out, ids whose availability is unknown) of rows that all hold and whose ids are unique; others raise."""
    late = (F.col("__retrievedAt") > cutoff) | F.coalesce(F.col("__availableAt") > cutoff, F.lit(False))
    # Rows are judged once: what they cost to make, and to parse, is not paid again by each check and each result.
    told = written(_read(rows).select("id", "reason", late.alias("late"), F.col("availableAt").isNull().alias("unknown")), "observations")
    if bad := told.where("reason IS NOT NULL").groupBy("reason").count().collect():
        raise InputError(f"rows that break a rule: { {r['reason']: r['count'] for r in bad} }")
    if not told.groupBy("id").count().where("count > 1").isEmpty():
        raise InputError("an id is repeated")
    return told.where("late").select("id"), told.where("unknown").select("id")
