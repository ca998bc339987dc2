"""Operator 3: quality rules as learned decision lists, in DataFrame expressions only.

Sequential covering: a rule, a conjunction of thresholds on text statistics, is grown on one part of the labelled rows by
information gain and pruned on the other; what it covers is set aside, and the next rule is learnt, until no rule is sure
enough. The list becomes one conditional expression, whose first rule that fits decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, texts

#: Labelled rows that rules are learnt from.
SAMPLE = 20_000
#: Thresholds tried for each statistic, conditions in a rule, rules in a list.
THRESHOLDS, CONDITIONS, RULES = 48, 4, 12
#: Share of bad rows among those that a rule covers, on the rows kept for pruning.
SURE = 0.9
WINDOW = 5

#: Statistics that conditions may use, as (numerator, denominator).
RATES = {
    "n_words": ("n_words", None),
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "digit_rate": ("n_digits", "word_chars"),
    "bang_rate": ("n_bangs", "n_words"),
}


def _count(text: Column, kind: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]+", ""))).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_digits, n_bangs (long). Null text has none of any.

    Repeated windows are found by the 64-bit hash of their words within a text, so two different windows of a text count as one with a chance
    of about its squared length / 2^65.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.withColumns({"__words": words, "__lines": lines, "n_symbols": _count(t, "#*$%&|<>"), "n_upper": _count(t, "A-Z"), "n_digits": _count(t, "0-9"), "n_bangs": _count(t, "!")})
    n = F.size("__words")
    hashed = F.when(n >= WINDOW, F.transform(F.slice("__words", 1, n - (WINDOW - 1)), lambda w,
        i: F.xxhash64(w, *(F.get("__words", i + k) for k in range(1, WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    counted = counted.withColumns({"__hashed": hashed, "n_words": n.cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"), "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    # Hashes with their places in order: equal ones are neighbours.
    placed = F.when(F.size(F.array_distinct("__hashed")) < F.size("__hashed"),
        F.sort_array(F.transform("__hashed", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    counted = counted.withColumn("__placed", placed)
    same = lambda s, k: F.coalesce(F.get("__placed", k)["h"] == s["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("__placed", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(again, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return counted.withColumn("n_repeat_words", covered).drop("__words", "__lines", "__hashed", "__placed")


def rate(name: str) -> Column:
    top, bottom = RATES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return rate(self.statistic) > self.threshold if self.above else rate(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        v = x[:, names.index(c.statistic)]
        out &= (v > c.threshold) if c.above else (v <= c.threshold)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for k, name in enumerate(names):
            v = x[inside, k]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, THRESHOLDS + 1)[:-1], method="lower"))
            order = np.argsort(v, kind="stable")
            bads = np.concatenate(([0], np.cumsum(bad[inside][order])))
            at = np.searchsorted(v[order], cuts, side="right")
            for above in (True, False):
                p = p0 - bads[at] if above else bads[at]
                n = (len(v) - at if above else at) - p
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - before), 0.0)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (float(gain[j]), Condition(name, above, float(cuts[j])))
        if best[1] is None:
            break
        # A tighter condition on the same side takes the place of the earlier one.
        rule = (*(c for c in rule if (c.statistic, c.above) != (best[1].statistic, best[1].above)), best[1])
        inside &= _holds((best[1],), x, names)
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, int, int]:
    hit = _holds(rule, x, names)
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / max(1, p + n), p, n


def learn(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, names: list[str]) -> list[Rule]:
    """An ordered list of rules for ``bad`` rows; ``prune`` marks the rows that rules are cut back on."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < RULES:
        grow, cut = left & ~prune, left & prune
        if not bad[grow].any():
            break
        rule = _grow(x[grow], bad[grow], names)
        best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, x[cut], bad[cut], names)[0], -len(r)), default=())
        _, p, n = _worth(best, x[cut], bad[cut], names)
        if not best or p < 2 or p < SURE * (p + n):
            break
        rules.append(best)
        left &= ~_holds(best, x, names)
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the first ``sample`` labelled documents by hash. Null labels and labels of unknown documents are left out; without bad rows there is no rule."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # small enough to broadcast
    names = list(RATES)
    rows = with_statistics(texts(docs).join(F.broadcast(few), "doc_id")).select("doc_id", "quality", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).alias("prune"),
        *(rate(n).alias(n) for n in names))
    rows = [r["r"] for r in rows.groupBy("doc_id").agg(F.min(F.struct(*rows.columns)).alias("r")).collect()]  # a document that rows repeat is taken once
    rows.sort(key=lambda r: r["doc_id"])
    x = np.asarray([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names))
    return learn(x, np.asarray([r["quality"] == 0 for r in rows], dtype=bool), np.asarray([r["prune"] for r in rows], dtype=bool), names)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the statistics: false for rows that a rule rejects."""
    out = F
    for rule in rules:
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row; null and empty texts have no word and fail."""
    return with_statistics(texts(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, with their columns, that neither the base rules nor the list rejects."""
    names = docs.columns
    spare = docs.select(*(F.col(f"`{n}`").alias(f"__c{k}") for k, n in enumerate(names)), F.col("text").alias("__text"))
    # The row number is not deterministic, which keeps the filter from being pushed down and its statistics from being worked out for each array element.
    judged = with_statistics(spare, "__text").withColumns({"__kept": ~base_failed() & verdict(rules), "__row": F.monotonically_increasing_id()})
    return judged.where(F.col("__kept") & (F.col("__row") >= 0)).select(*(F.col(f"__c{k}").alias(n) for k, n in enumerate(names)))
