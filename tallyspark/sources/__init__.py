"""Files in and out: wide tables of numbers, strict JSON, published folders and their manifests."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import os
import uuid
from decimal import Decimal
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.returns import InputError, calendar_gaps, pct_change, require

#: Bytes of the largest JSON input.
LARGEST = 16 << 20


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a CSV file, whose byte-order mark is skipped; names that repeat or are blank raise, as a reader would rename them silently."""
    first = spark.read.text(path).limit(1).collect()
    names = next(csv.reader(io.StringIO(first[0]["value"].lstrip("﻿")))) if first else []
    if len(set(names)) != len(names) or not all(n.strip() for n in names):
        raise InputError("column names must be there once each")
    return names


def read_wide(spark: SparkSession, path: str, kind: str = "returns") -> DataFrame:
    """(date, asset, r) from a CSV file with a column ``date`` and one for each asset. ``prices`` must be positive and become returns."""
    names = header_of(spark, path)
    assets = [n for n in names if n != "date"]
    if "date" not in names or not assets:
        raise InputError("a wide table needs date and one asset at least")
    schema = ", ".join(f"`{n}` {'date' if n == 'date' else 'double'}" for n in names)
    wide = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    if not wide.groupBy("date").count().where("count > 1 OR date IS NULL").isEmpty():
        raise InputError("a date is repeated or missing")
    value = "px" if kind == "prices" else "r"
    long = wide.unpivot("date", assets, "asset", value)
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if kind == "prices":
        return pct_change(require(long, not_positive=bad | (F.col("px") <= 0)))
    return require(long, not_finite=bad)


def local_input(path: str) -> bytes:
    """The bytes of a regular local file of at most LARGEST bytes; links and other files raise."""
    p = Path(path)
    if p.is_symlink() or not p.is_file() or p.stat().st_size > LARGEST:
        raise InputError(f"{path} is no regular file of up to {LARGEST} bytes")
    return p.read_bytes()


def strict_json(raw: bytes, exact: bool = False) -> object:
    """A JSON value; repeated keys, NaN, infinite and overflowing numbers and inputs over LARGEST bytes raise. ``exact`` keeps fractions as decimals."""
    if len(raw) > LARGEST:
        raise InputError("the input is too large")

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise InputError("a key is repeated")
        return dict(pairs)

    def finite(text: str) -> float:
        if not math.isfinite(x := float(text)):
            raise InputError(f"{text} is not finite")
        return Decimal(text) if exact else x

    def refuse(text: str) -> None:
        raise InputError(f"{text} is not a number")

    try:
        return json.loads(raw.decode("utf-8-sig"), object_pairs_hook=unique, parse_float=finite, parse_constant=refuse)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise InputError(str(e)) from e


def mapped_columns(rows: DataFrame, columns: dict[str, str], constants: dict[str, str | None], fields: list[str]) -> DataFrame:
    """``fields`` from columns of ``rows`` or constants; every field must come from exactly one of them."""
    if set(columns) & set(constants) or set(columns) | set(constants) != set(fields):
        raise InputError("each field needs one column or one constant")
    return rows.select(*(F.col(columns[f]).cast("string").alias(f) if f in columns else F.lit(constants[f]).cast("string").alias(f) for f in fields))


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def digest(value: object) -> str:
    return sha256(canonical(value).encode())


def read_factors(spark: SparkSession, path: str, panel: DataFrame) -> DataFrame:
    """(date, asset, r) of factors in a wide CSV file, whose dates must be the panel's exactly."""
    factors = read_wide(spark, path)
    if not calendar_gaps(factors.select("date").distinct(), panel.select("date")).isEmpty():
        raise InputError("factor dates must be the panel's dates exactly")
    return factors


def read_orders(spark: SparkSession, path: str, assets: list[str]) -> DataFrame:
    """(date, asset, notional) of signed amounts in a wide CSV file with exactly the columns date and ``assets``, each date once."""
    names = header_of(spark, path)
    if sorted(names) != sorted(["date", *assets]):
        raise InputError("orders need a column for each asset and no other")
    schema = ", ".join(f"`{n}` {'date' if n == 'date' else 'double'}" for n in names)
    wide = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    if not wide.groupBy("date").count().where("count > 1 OR date IS NULL").isEmpty():
        raise InputError("a date is repeated or missing")
    return require(wide.unpivot("date", list(assets), "asset", "notional"), not_finite=F.col("notional").isNull() | F.isnan("notional") | (F.abs("notional") == float("inf")))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of one file or of the files that a pattern names."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, length) of all files below ``folder``, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    name = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    return files.select(F.expr("1").alias("one"), name.alias("full"), F.sha2("content", 256).alias("sha256"),
        "length").select(F.substring(F.col("full"), F.lit(len(root) + 2), F.length("full")).alias("path"), "sha256", "length")


def verify(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of files that are missing, changed, extra, or outside the folder by their name."""
    j = recorded.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("got")), "path", "full")
    escapes = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")
    status = F.when(escapes, "path_escape").when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("got"), "changed")
    return j.select("path", status.alias("status")).where("status is not null")


def fresh_name(spark: SparkSession, target: str) -> str:
    """``target``, or the first of target-2, target-3 and so on that isn't there."""
    name, k = target, 2
    while exists(spark, name):
        name, k = f"{target.rstrip('/')}-{k}", k + 1
    return name


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file in whatever store the path names."""
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if at.toUri().getScheme() in (None, "file"):  # a local store's checksum file would tell of later changes before a digest does
        Path(at.toUri().getPath()).with_name(f".{at.getName()}.crc").unlink(missing_ok=True)


def get_text(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.text(path, wholetext=True).first()["value"]
    except (Py4JJavaError, PySparkException) as e:  # missing, or the store's own checksum doesn't fit
        raise InputError(f"{path} can't be read whole") from e


def publish(tables: dict[str, DataFrame], receipt: dict, target: str, texts: dict[str, str] | None = None, formats: dict[str, str] | None = None) -> str:
    """Tables and texts with a receipt in a new folder, which appears whole or not at all by one rename in its own store; one that exists is never written over.

    ``target`` is a path of any store that Spark writes to, and must be one that driver and executors share. Tables are Parquet unless ``formats`` says csv or json; texts are files
    by name. The receipt has the digest of each text and of itself.
    """
    if not tables and not texts:
        raise InputError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    target = target.rstrip("/")
    target = target if "://" in target or target.startswith("file:") else f"file://{os.path.abspath(target)}"
    if exists(spark, target):
        raise InputError(f"{target} exists")
    part = f"{target}.{uuid.uuid4().hex}.part"
    fs, staged = _fs(spark, part)
    try:
        for name, df in tables.items():
            kind = (formats or {}).get(name, "parquet")
            writer = df.write.format(kind)
            (writer.option("header", "true") if kind == "csv" else writer).save(f"{part}/{name}")
        for name, text in (texts or {}).items():
            put_text(spark, f"{part}/{name}", text)
        told = {**receipt, "files": {n: sha256(t.encode()) for n, t in sorted((texts or {}).items())}, "tables": sorted(tables)}
        put_text(spark, f"{part}/receipt.json", canonical({**told, "digest": digest(told)}))
        if exists(spark, target) or not fs.rename(staged, _fs(spark, target)[1]):
            raise InputError(f"{target} exists")
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
    return target


def frozen(spark: SparkSession, target: str, expected: str | None = None) -> dict:
    """The receipt of a published folder whose texts and digest agree, else an error."""
    receipt = strict_json(get_text(spark, f"{target}/receipt.json").encode())
    body = {k: v for k, v in receipt.items() if k != "digest"}
    if receipt.get("digest") != digest(body) or (expected is not None and receipt["digest"] != expected):
        raise InputError("the receipt's digest is another one")
    for name, want in receipt["files"].items():
        if not exists(spark, f"{target}/{name}") or sha256(get_text(spark, f"{target}/{name}").encode()) != want:
            raise InputError(f"{name} is missing or changed")
    return receipt
