"""Net asset values as records: requests, provider responses, native archives, replay and checks. Nothing goes online unless it is asked to."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import evidence
from ..operators.returns import InputError
from . import LARGEST, digest, sha256, strict_json

#: Fields of a request, and what this version takes: fixed values of the format.
REQUEST = {"id", "source", "fundCode", "start", "end", "asOf", "currency", "frequency", "fields"}
SOURCE, CURRENCY, FREQUENCY, COLUMNS = "eastmoney-fund-nav", "CNY", "daily", ["unit_nav", "distribution_text"]
SCHEMA, METHOD = "cn-research-collection/1.0", "fund-nav-normalization/1.0"
RECORDS = "id string, status string, date string, unit_nav string, distribution_text string, sha256 string, failure string"
#: The provider's times are those of UTC+8.
ZONE = dt.timezone(dt.timedelta(hours=8))


def day(text: object) -> dt.date:
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise InputError("a day is YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(text)
    except ValueError as e:
        raise InputError(str(e)) from e


def request(value: dict) -> dict:
    """A request with exactly its fields: a code of six digits as text, start <= end <= asOf, daily values in one currency."""
    if not isinstance(value, dict) or set(value) != REQUEST:
        raise InputError(f"a request has the fields {sorted(REQUEST)}")
    if not str(value["id"]).strip() or value["source"] != SOURCE or not isinstance(value["fundCode"], str) or not re.fullmatch("[0-9]{6}", value["fundCode"]):
        raise InputError("a request needs an id, a known source and a code of six digits")
    if not day(value["start"]) <= day(value["end"]) <= day(value["asOf"]) or (value["currency"], value["frequency"], value["fields"]) != (CURRENCY, FREQUENCY, COLUMNS):
        raise InputError("dates out of order, or an unknown currency, frequency or field")
    return dict(value)


def url_for(req: dict) -> str:
    return f"https://fund.eastmoney.com/pingzhongdata/{request(req)['fundCode']}.js"


def decimal_text(value: object) -> str:
    """A positive number in fixed notation without trailing zeros."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float, Decimal)):
        raise InputError("a net asset value is a number")
    try:
        number = Decimal(str(value))
    except InvalidOperation as e:
        raise InputError("a net asset value is a number") from e
    if not number.is_finite() or number <= 0:
        raise InputError("a net asset value is above zero")
    text = f"{number:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def embedded(text: str, name: str) -> object:
    """The JSON value that a script assigns to a variable; the script isn't run."""
    found = re.search(rf"var\s+{re.escape(name)}\s*=\s*", text)
    if not found:
        raise InputError(f"the response has no {name}")
    _, end = json.JSONDecoder().raw_decode(text, found.end())
    return strict_json(text[found.end() : end].encode(), exact=True)


def normalized(rows: list[dict], req: dict) -> list[dict]:
    """Rows (date, nav, distribution_text) inside the request's dates, in order and once each. Nothing is sorted or dropped silently, and no rows at all raise."""
    lo, hi = day(req["start"]), day(req["end"])
    out = [{"date": r["date"], "unit_nav": decimal_text(r.get("nav")), "distribution_text": r.get("distribution_text") or ""} for r in rows if lo <= day(r.get("date")) <= hi]
    dates = [r["date"] for r in out]
    if not out or dates != sorted(set(dates)):
        raise InputError("dates repeat or are out of order, or none lies in the span")
    return out


def record(req: dict, rows: list[dict], *, name: str | None = None, retrieved_at: str | None = None, raw: bytes | None = None, origin: str = "provided-response", failure: str | None = None) -> dict:
    """A record with what is known of its origin, its coverage, and a digest of itself. A failure has no rows and says why."""
    data = [] if failure else normalized(rows, request(req))
    missing = [label for label, lacks in (("retrieved_at", retrieved_at is None), ("raw", raw is None), ("name", name is None)) if lacks]
    out = {
        "schema": SCHEMA,
        "method": METHOD,
        "request": request(req),
        "status": "failed" if failure else "success",
        "data": data,
        "name": name,
        "retrieved_at": retrieved_at,
        "raw_sha256": sha256(raw) if raw is not None else None,
        "origin": origin,
        "failure": failure,
        "coverage": {"start": data[0]["date"] if data else None, "end": data[-1]["date"] if data else None, "count": len(data), "completeness": "unknown"},
        "missing": missing,
        "verified": {"source": False, "calendar": False, "events": False},
    }
    return out | {"digest": digest(out)}


def parsed(raw: bytes, req: dict, **more: object) -> dict:
    """The record of a provider's response: its code must be the request's, its times become days at UTC+8."""
    req = request(req)
    if len(raw) > LARGEST:
        raise InputError("the response is too large")
    text = raw.decode("utf-8-sig")
    if embedded(text, "fS_code") != req["fundCode"]:
        raise InputError("the response is of another fund")
    rows = []
    for point in embedded(text, "Data_netWorthTrend") or []:
        at = point.get("x")
        if isinstance(at, bool) or not isinstance(at, (int, float, Decimal)) or at < 0:
            raise InputError("a time is milliseconds since 1970")
        rows.append({"date": dt.datetime.fromtimestamp(float(at) / 1000, ZONE).date().isoformat(), "nav": point.get("y"), "distribution_text": point.get("unitMoney") or ""})
    return record(req, rows, name=embedded(text, "fS_name"), raw=raw, **more)


def fetched(req: dict, online: bool = False, fetcher: Callable[[str], bytes] | None = None) -> dict:
    """The record of a request that is sent; what fails is a record that says so. Without ``online`` nothing is sent."""
    if online is not True:
        raise InputError("collecting goes online only when it is asked to")
    raw, at = None, None
    try:
        if fetcher is None:
            from urllib.request import Request, urlopen

            with urlopen(Request(url_for(req)), timeout=25) as response:
                raw = response.read(LARGEST + 1)
        else:
            raw = fetcher(url_for(req))
        at = dt.datetime.now(dt.timezone.utc).isoformat()
        return parsed(raw, req, retrieved_at=at, origin="online-response")
    except (OSError, ValueError, TypeError, KeyError) as e:
        return record(req, [], raw=raw if raw is None or len(raw) <= LARGEST else None, retrieved_at=at, origin="online-response", failure=str(e) or type(e).__name__)


def from_native(native: dict, req: dict, raw: bytes | None = None) -> dict:
    """The record of exactly one fund in a native archive of a known kind, as of the same day or over the same span. Prices are no net asset values."""
    req = request(req)
    if native.get("type") == "research-bundle":
        match = [r for r in native.get("rows") or [] if r.get("kind") == "fund" and r.get("code") == req["fundCode"]]
        if len(match) != 1 or native.get("asOf") != req["asOf"] or (match[0].get("history") and match[0].get("historyBasis") != "nav-with-distributions"):
            raise InputError("a bundle needs one fund row of the code, its day, and net asset values")
        row = match[0]
        return record(req, row.get("history") or [], name=(row.get("identity") or {}).get("name"), retrieved_at=row.get("retrievedAt"), raw=raw, origin="workbench-native",
            failure=None if row.get("history") else str(row.get("errors") or "no history"))
    if native.get("type") == "portfolio-source-archive":
        match = [r for r in native.get("results") or [] if r.get("code", (r.get("request") or {}).get("code")) == req["fundCode"]]
        if len(match) != 1:
            raise InputError("an archive needs one result of the code")
        row = match[0]
        if row.get("status") == "failed":
            return record(req, [], origin="portfolio-native", failure=str(row.get("reason") or "failed"))
        if row.get("basis") != "nav_with_unverified_events" or (row.get("requested_start"), row.get("requested_end")) != (req["start"], req["end"]):
            raise InputError("the archive has another basis or span")
        if raw is not None and row.get("response_sha256") not in (None, sha256(raw)):
            raise InputError("the response's digest is another one")
        return record(req, row["history"], name=row.get("name"), retrieved_at=row.get("retrieved_at"), raw=raw, origin="portfolio-native")
    raise InputError("unknown kind of archive")


def validate(value: dict) -> dict:
    """``value`` if it is a record whose digest, request, rows and coverage agree and that certifies nothing."""
    body = {k: x for k, x in value.items() if k != "digest"}
    if value.get("schema") != SCHEMA or value.get("method") != METHOD or value.get("digest") != digest(body):
        raise InputError("another schema, method or digest")
    req, data = request(value["request"]), value["data"]
    if value["status"] == "failed":
        if data or not value["failure"]:
            raise InputError("a failure has a reason and no rows")
    elif normalized([{"date": r["date"], "nav": r["unit_nav"], "distribution_text": r["distribution_text"]} for r in data], req) != data:
        raise InputError("rows aren't in normal form")
    want = {"start": data[0]["date"] if data else None, "end": data[-1]["date"] if data else None, "count": len(data), "completeness": "unknown"}
    if value["coverage"] != want or any(value["verified"].values()):
        raise InputError("the coverage is another one, or something is called verified")
    return value


def replayed(snapshot: dict, raw: bytes) -> dict:
    """The record of a frozen response again: its bytes must have the snapshot's digest, its rows must be equal."""
    validate(snapshot)
    if sha256(raw) != snapshot["raw_sha256"]:
        raise InputError("the response is another one")
    again = parsed(raw, snapshot["request"], retrieved_at=snapshot["retrieved_at"], origin="frozen-response-replay")
    if again["data"] != snapshot["data"]:
        raise InputError("the replayed rows differ")
    return again


def teaching_response(code: str = "000001", days: int = 60) -> bytes:
    """A made response in the provider's form: a slow walk, one distribution."""
    start = dt.datetime(2024, 1, 2, tzinfo=ZONE)
    points = [{"x": int((start + dt.timedelta(days=k)).timestamp() * 1000), "y": round(1 + 0.001 * ((k * 37) % 23 - 9), 4), "unitMoney": "0.01" if k == 30 else ""} for k in range(days)]
    return f'var fS_code = "{code}";var fS_name = "Teaching fund";var Data_netWorthTrend = {json.dumps(points)};'.encode()


class _Part(InputPartition):
    def __init__(self, req: dict):
        super().__init__(req["id"])
        self.req = req


class NavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests = [request(r) for r in strict_json(options["requests"].encode())]
        self.online = str(options.get("online", "false")).lower() == "true"
        self.teaching = str(options.get("teaching", "false")).lower() == "true"
        if not 1 <= len(self.requests) <= 12:
            raise InputError("1 to 12 requests")
        if not self.online and not self.teaching:
            raise InputError("collecting goes online only when it is asked to")

    def partitions(self) -> list[InputPartition]:
        return [_Part(r) for r in self.requests]

    def read(self, partition: _Part) -> Iterator[tuple]:
        req = partition.req
        got = fetched(req, True, (lambda _: teaching_response(req["fundCode"])) if self.teaching else None)
        if got["status"] == "failed":
            yield (req["id"], "failed", None, None, None, got["raw_sha256"], got["failure"])
        for r in got["data"]:
            yield (req["id"], "success", r["date"], r["unit_nav"], r["distribution_text"], got["raw_sha256"], None)


class NavSource(DataSource):
    """``spark.dataSource.register(NavSource)``, then ``spark.read.format("fund_nav")`` with options requests (JSON), online or teaching: a partition for each request, a row for
    each value, and a row that says why for each request that failed."""

    @classmethod
    def name(cls) -> str:
        return "fund_nav"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: object) -> NavReader:
        return NavReader(dict(self.options))


def records_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    """(id, code, date, nav) of validated records."""
    rows = [(r["request"]["id"], r["request"]["fundCode"], x["date"], x["unit_nav"]) for r in map(validate, records) for x in r["data"]]
    told = spark.createDataFrame(rows, "id string, code string, date string, nav string")
    return told.select("id", "code", evidence.strict_day("date").alias("date"), F.col("nav").cast("double").alias("nav"))


def dated_rows(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """``rows`` (keys, date, value) if dates are unique and values finite and above zero."""
    from ..operators.returns import require

    require(rows, value=~evidence.finite(value) | (F.col(value) <= 0), date=F.col("date").isNull())
    if not rows.groupBy(*keys, "date").count().where("count > 1").isEmpty():
        raise InputError("a date is repeated")
    return rows


def adapted(rows: DataFrame, declarations: DataFrame, basis: str = "nav-with-distributions") -> DataFrame:
    """Fund rows (code, kind, basis, date, nav) with what is declared of their assets (code, currency): quotes and other kinds raise, and so does a fund without a declaration."""
    from ..operators.returns import require

    require(rows, kind=F.col("kind") != "fund", basis=F.col("basis") != basis)
    if not rows.join(declarations, "code", "left_anti").isEmpty():
        raise InputError("a fund has no declaration")
    return dated_rows(rows, "nav", "code").join(declarations, "code").select("code", "currency", "date", "nav")
