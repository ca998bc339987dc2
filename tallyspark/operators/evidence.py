"""What may be known when, and what counts as evidence: predicates and conversions as column expressions.

A reason is null where everything holds, and names the first rule that doesn't; nothing unknown is taken for true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .returns import InputError

DAY = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
#: Days are those of UTC+8.
ZONE_SECONDS = 8 * 3600


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule (broken, name) that is broken; a rule that is null counts as broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for broken, name in rules), F.lit(None).cast("string"))


# Dates and times
def strict_day(x: Column | str) -> Column:
    """A date from YYYY-MM-DD, else null."""
    return F.when(_c(x).rlike(DAY), F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd")).cast("date"))


def instant(x: Column | str) -> Column:
    """A timestamp from text that states its offset from UTC, else null."""
    return F.when(_c(x).rlike(INSTANT), F.try_to_timestamp(F.regexp_replace(_c(x), "Z$", "+00:00")))


def _zone_day(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((seconds + ZONE_SECONDS) / 86400).cast("int"))


def knowledge_day(x: Column | str) -> Column:
    """The day on which something stamped so is known: a date as it is, a timestamp with offset as its day at UTC+8, in whatever zone the session is."""
    return F.coalesce(strict_day(x), _zone_day(F.unix_seconds(instant(x))))


def epoch_day(milliseconds: Column | str) -> Column:
    """The day at UTC+8 of milliseconds since 1970; null below zero."""
    return F.when(_c(milliseconds) >= 0, _zone_day(F.floor(_c(milliseconds) / 1000)))


def effective_cutoff(*days: Column | str) -> Column:
    """The earliest of several cut-offs; those that are null don't limit."""
    return F.least(*map(_c, days))


# Numbers and text
def finite(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Whether a number is known, finite and within bounds."""
    c = _c(x).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = ok & (c >= low) if low is not None else ok
    return F.coalesce(ok & (c <= high) if high is not None else ok, F.lit(False))


def has_text(x: Column | str) -> Column:
    return F.coalesce(F.length(F.trim(_c(x))) > 0, F.lit(False))


def is_hash(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_code(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^[0-9]{6}$"), F.lit(False))


def is_portable_id(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def decimal_text(x: Column | str) -> Column:
    """A decimal in fixed notation without trailing zeros, from text or a number; null unless it is above zero."""
    d = _c(x).try_cast("decimal(38,12)")
    text = F.regexp_replace(d.cast("string"), r"\.?0+$", "")
    return F.when(d > 0, text)


def with_unit(value: Column | str, unit: Column | str, wanted: str) -> Column:
    """The number in ``value`` where its unit is the one asked for, else null."""
    return F.when(_c(unit) == wanted, _c(value).try_cast("double"))


def percent_text(x: Column | str, digits: int = 2) -> Column:
    return F.when(_c(x).isNotNull(), F.format_string(f"%.{digits}f%%", _c(x).cast("double") * 100)).otherwise(F.lit("unknown"))


def url_ok(x: Column | str, https_only: bool = True) -> Column:
    """Whether a URL has a host, no credentials, no blanks, and the scheme and port that are asked for."""
    c = _c(x)
    scheme = F.try_parse_url(c, F.lit("PROTOCOL"))
    ok = scheme.isin("https") if https_only else scheme.isin("https", "http")
    port = F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
    ok = ok & F.try_parse_url(c, F.lit("HOST")).isNotNull() & F.try_parse_url(c, F.lit("USERINFO")).isNull() & ~c.rlike(r"[\s\x00-\x1f\x7f]")
    return F.coalesce(ok & port.isin("", "443") if https_only else ok, F.lit(False))


# Evidence
def available(at: Column | str, source: Column | str, cutoff: Column, signal: Column | None = None) -> Column:
    """The reason why a piece of evidence may not be used at the cut-off, and at the signal if there is one."""
    t = instant(at)
    rules = [(t > cutoff, "after_cutoff")] + ([(t > signal, "after_signal")] if signal is not None else [])
    return first_reason((t.isNull(), "no_instant"), *rules, (~has_text(source), "no_source"))


def disclosure_reason(row: dict[str, Column], as_of: Column, historical: bool = False) -> Column:
    """The reason why a disclosure may not be used as of a day. ``row`` has the columns report_date, published_at, retrieved_at, available_at, frozen_at, version_id
    and source_sha256; the last five may be null, but not all of them for a view of what was known in the past."""
    day = {k: knowledge_day(row[k]) for k in ("report_date", "published_at", "retrieved_at", "available_at", "frozen_at")}
    given = lambda k: row[k].isNotNull()
    rules = [
        (day["report_date"].isNull() | day["published_at"].isNull() | as_of.isNull(), "no_dates"),
        ((day["report_date"] > day["published_at"]) | (day["published_at"] > as_of), "published_after_cutoff"),
        (given("retrieved_at") & (day["retrieved_at"] < day["published_at"]), "retrieved_before_publication"),
        (given("available_at") & ((day["available_at"] < day["published_at"]) | (day["available_at"] > as_of)), "not_available_by_cutoff"),
        (given("frozen_at") & F.coalesce(day["frozen_at"] < day["available_at"], F.lit(True)), "frozen_before_available"),
        (given("version_id") & ~has_text(row["version_id"]), "no_version"),
        (given("source_sha256") & ~is_hash(row["source_sha256"]), "no_hash"),
    ]
    if historical:
        whole = given("available_at") & given("frozen_at") & has_text(row["version_id"]) & is_hash(row["source_sha256"])
        rules.append((~whole | (day["frozen_at"] > as_of), "not_frozen_by_cutoff"))
    return first_reason(*rules)


def evidence_known(row: dict[str, Column], cutoff: Column) -> tuple[Column, Column]:
    """(reason why a record is no evidence, whether it was known by the cut-off). ``row`` has source, locator, version, published, acquired_at and sha256."""
    published, acquired = strict_day(row["published"]), instant(row["acquired_at"])
    reason = first_reason(
        (~row["source"].startswith("https://"), "no_https"),
        (~has_text(row["locator"]) | ~has_text(row["version"]), "no_locator"),
        (published.isNull() | acquired.isNull(), "no_dates"),
        (published > _zone_day(F.unix_seconds(acquired)), "acquired_before_publication"),
        (~is_hash(row["sha256"]), "no_hash"),
    )
    return reason, reason.isNull() & (acquired <= cutoff) & (published <= _zone_day(F.unix_seconds(cutoff)))


def evidence_value(row: dict[str, Column], as_of: Column) -> Column:
    """The reason why a stated number (value, basis, note, source_url, locator, published) is no evidence: assumptions need a note only."""
    assumed = row["basis"] == "assumption"
    return first_reason(
        (~row["basis"].isin("source-statement", "calculation", "assumption"), "no_basis"),
        (~finite(row["value"]), "no_number"),
        (~has_text(row["note"]), "no_note"),
        (~assumed & (~url_ok(row["source_url"]) | ~has_text(row["locator"])), "no_source"),
        (~assumed & F.coalesce(strict_day(row["published"]) > as_of, F.lit(True)), "published_after_cutoff"),
    )


def execution_status(flags: Column) -> Column:
    """blocked if any of the flags is false, unknown if any is null, else what was declared."""
    return F.when(F.exists(flags, lambda x: x == F.lit(False)), "blocked").when(F.exists(flags, lambda x: x.isNull()), "unknown").otherwise("declared_only")


# Numbers bound to documents
def pointer_path(pointer: Column | str) -> Column:
    """A JSON pointer (``/a/0/b``, with ``~1`` for / and ``~0`` for ~) as a path of ``get_json_object``."""
    steps = F.filter(F.split(_c(pointer), "/"), lambda s, i: i > 0)
    step = lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("['"), F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("']")))
    return F.when(_c(pointer).startswith("/"), F.concat(F.lit("$"), F.array_join(F.transform(steps, step), "")))


def binding_reason(document: Column, pointer: Column, value: Column, scale: Column, as_of: Column, published: Column | None = None) -> Column:
    """The reason why ``value`` doesn't stand at ``pointer`` in a JSON ``document``, times ``scale``, within 1e-10 of its size or 1e-8. ``published`` is the date of the
    row that it stands in."""
    found = F.call_function("get_json_object", document, pointer_path(pointer)).try_cast("double") * scale
    near = F.abs(value - found) <= F.greatest(1e-10 * F.greatest(F.abs(value), F.abs(found)), F.lit(1e-8))
    rules = [(~_c(pointer).startswith("/"), "no_pointer"), (~(scale > 0), "no_scale"), (found.isNull(), "no_field"), (~near, "other_value")]
    return first_reason(*rules, *([] if published is None else [(strict_day(published) > as_of, "published_after_cutoff")]))


# Choices
def tradeoff(gain: Column, reduction: Column, is_baseline: Column, band: float = 1e-8) -> Column:
    """How a result compares with the baseline in return gained and drawdown reduced."""
    more, less, safer, riskier = gain > band, gain < -band, reduction > band, reduction < -band
    return F.when(is_baseline, "baseline").when(more & safer, "better_both").when(less & safer, "less_drawdown_less_return").when(more & riskier,
        "more_return_more_drawdown").when(less & riskier, "worse_both").otherwise("mixed")


def trailing(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` rows by date of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def thinned(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` evenly spaced rows of each key by date, the first and the last among them."""
    w = Window.partitionBy(*keys)
    k, n = F.col("__k"), F.col("__n")
    step = F.greatest(n - 1, F.lit(1)) / F.lit(most - 1)
    near = F.floor(F.ceil(k / step - 1e-9) * step + 1e-9) == k
    ranked = df.withColumns({"__k": F.row_number().over(w.orderBy("date")) - 1, "__n": F.count("*").over(w)})
    return ranked.where((n <= most) | near).drop("__k", "__n")


def unknown_fields(given: dict, allowed: set[str], where: str = "config") -> dict:
    """``given`` if it has no fields beyond ``allowed``; unknown fields are an error, never ignored."""
    if more := sorted(set(given) - allowed):
        raise InputError(f"unknown fields of {where}: {more}")
    return given


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side: empty for equal sets."""
    names = left.columns
    return left.select(*names).exceptAll(right.select(*names)).withColumn("side", F.lit("left")).unionByName(right.select(*names).exceptAll(left.select(*names)).withColumn("side", F.lit("right")))


def bijection(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The one-to-one join of two tables; a key that a side lacks or repeats raises."""
    for side in (left, right):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise InputError("a key is repeated")
    broken = reduce(lambda a, b: a | b, (F.col(f"__{s}").isNull() for s in ("l", "r")))
    joined = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), list(keys), "full")
    if not joined.where(broken).isEmpty():
        raise InputError("a key is on one side only")
    return joined.drop("__l", "__r")
