"""What an account holds through funds and directly, security by security, with what stays unknown kept as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .returns import InputError, require
from .select import counted_up
from .stage import written

DIRECT = ("stock", "bond", "cash", "other")


#: Levels that a walk may be asked for, and what a fund may leave undisclosed without a row that says so.
DEPTHS, TINY_WEIGHT = (1, 20), 1e-12
#: What a row of walks has beside the nodes, edges and weights along it.
_WALK = ("start", "end", "kind", "reason", "open", "path", "ids", "ws")


def _first_walks(edges: DataFrame, sums: DataFrame) -> DataFrame:
    """Walks of one edge from every fund. A walk is open if it ends at a fund with holdings that it hasn't met; what a fund doesn't disclose is a walk that ends there."""
    nodes = sums.select(F.col("node").alias("child"), F.lit(True).alias("has"))
    is_fund = F.col("kind") == "fund"
    stop = F.when(F.col("child") == F.col("node"), "cycle").when(F.col("has").isNull(), "missing_child")
    reason = F.when(is_fund, stop).when(F.col("kind") == "unknown", "unknown_kind")
    step = edges.where("weight > 0").join(nodes, "child", "left").select(
        F.col("node").alias("start"), F.col("child").alias("end"), "kind", reason.alias("reason"), (is_fund & reason.isNull()).alias("open"),
        F.array("node", "child").alias("path"), F.array("id").alias("ids"), F.array("weight").alias("ws"),
    )
    short = sums.where(1 - F.col("total") > TINY_WEIGHT).select(
        F.col("node").alias("start"), F.lit("unknown").alias("end"), F.lit("unknown").alias("kind"), F.lit("undisclosed").alias("reason"), F.lit(False).alias("open"),
        F.array("node").alias("path"), F.array(F.lit(-1).cast("long")).alias("ids"), F.array(1 - F.col("total")).alias("ws"),
    )
    return step.unionByName(short)


def _extended(walks: DataFrame, by: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``walks`` that are open, each with all of ``by`` that begin where it ends; the others as they are; and how many are open, as the write has seen. A walk that comes back to a fund that it has met ends there as a cycle,
    once, whatever would follow."""
    ahead = by.select(*(F.col(c).alias(f"n_{c}") for c in _WALK))
    both = walks.where("open").join(ahead, F.col("end") == F.col("n_start"))
    tail = F.slice("n_path", F.lit(2), F.size("n_path"))
    funds = F.when((F.col("n_kind") == "fund") | (F.col("n_reason") == "undisclosed"), tail).otherwise(F.slice("n_path", F.lit(2), F.greatest(F.size("n_path") - 2, F.lit(0))))
    met = F.when(F.arrays_overlap("path", funds), F.array_position(F.transform(funds, lambda x: F.array_contains("path", x)), F.lit(True))).otherwise(0)
    both = both.withColumn("met", met.cast("int"))
    upto = lambda c, n: F.concat(c, F.slice(f"n_{c}", F.lit(1), n))
    whole, cut = F.size("n_ids"), F.when(F.col("met") > 0, F.col("met")).otherwise(F.size("n_ids"))
    is_met = F.col("met") > 0
    step = both.select(
        "start", F.when(is_met, F.get(tail, F.col("met") - 1)).otherwise(F.col("n_end")).alias("end"),
        F.when(is_met, "fund").otherwise(F.col("n_kind")).alias("kind"), F.when(is_met, "cycle").otherwise(F.col("n_reason")).alias("reason"), (F.col("n_open") & ~is_met).alias("open"),
        F.concat("path", F.when(is_met, F.slice(tail, F.lit(1), cut)).otherwise(tail)).alias("path"), upto("ids", cut).alias("ids"), upto("ws", cut).alias("ws"),
            (is_met & (cut < whole)).alias("shortened"),
    )
    seen = Observation()
    step = written(step.observe(seen, F.count_if("open").alias("n")), name)
    once = step.where("shortened").select(*_WALK).dropDuplicates(["start", "ids"])
    return walks.where("NOT open").unionByName(step.where("NOT shortened").select(*_WALK)).unionByName(once), seen.get["n"]


def paths(holdings: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """(root, leaf, kind, w, reason, path): what each of ``roots`` (root) holds through the fund edges ``holdings`` (node, child, kind, weight).

    A path stops, in this order, at a cycle, at ``depth``, at a fund without holdings; what stops so, what is of kind unknown, and what a fund doesn't
    disclose, is unknown with its reason. Weights of a fund that sum to more than 1, or a child of two kinds, raise.

    Walks from all funds are joined with themselves, so each round doubles their length: a depth of 20 takes five doublings, and two joins that add up to 20 from the roots. Doubling
    ends early once no walk is open. Edges that repeat are paths of their own.
    """
    if not DEPTHS[0] <= depth <= DEPTHS[1]:
        raise InputError(f"depth goes from {DEPTHS[0]} to {DEPTHS[1]}")
    edges = written(holdings.select("node", "child", "kind", "weight", F.monotonically_increasing_id().alias("id")), "edges")
    sums = edges.groupBy("node").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    kinds = edges.where("kind <> 'unknown'").groupBy("child").agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    broken = {"above_one": F.col("total") > 1 + 1e-10, "negative": F.col("least") < 0}
    told = sums.select(*(c.alias(n) for n, c in broken.items()), F.lit(False).alias("two_kinds"))
    require(told.unionByName(kinds.select(*(F.lit(False).alias(n) for n in broken), (F.col("a") != F.col("b")).alias("two_kinds"))), **{n: F.col(n) for n in (*broken, "two_kinds")})
    powers = [_first_walks(edges, sums)]
    while 2 ** len(powers) <= depth:
        longer, n_open = _extended(powers[-1], powers[-1], "walks")
        powers.append(longer)
        if not n_open:
            break
    none = lambda kind: F.array().cast(f"array<{kind}>")
    found = roots.select(
        F.col("root").alias("start"), F.col("root").alias("end"), F.lit("fund").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("open"),
        F.array("root").alias("path"), none("bigint").alias("ids"), none("double").alias("ws"),
    ).distinct()
    done = 2 ** (len(powers) - 1)
    bits = [k for k in reversed(range(len(powers))) if depth & 2**k] if 2 * done > depth else [len(powers) - 1]
    for k in bits:
        found, _ = _extended(found, powers[k], "paths")
    # at the depth nobody looks whether a fund has holdings
    reason = F.when(F.col("open") | (F.col("reason") == "missing_child") & (F.size("ids") == depth), "depth_limit").otherwise(F.col("reason"))
    known = reason.isNull()
    w = F.aggregate("ws", F.lit(1.0), lambda a, x: a * x)
    return found.where("size(ids) > 0").select(
        F.col("start").alias("root"), F.when(known, F.col("end")).otherwise("unknown").alias("leaf"), F.when(known, F.col("kind")).otherwise("unknown").alias("kind"), w.alias("w"),
            reason.alias("reason"), "path",
    )


def issuers(leaves: DataFrame, mapping: DataFrame) -> DataFrame:
    """(root, issuer, w) of stocks: an issuer counts if its mapping (security, issuer, source) states a source, else the weight is unmapped (null issuer)."""
    sure = mapping.where("issuer IS NOT NULL AND length(trim(source)) > 0").select(F.col("security").alias("leaf"), "issuer")
    return leaves.where("kind = 'stock'").join(sure, "leaf", "left").groupBy("root", "issuer").agg(F.sum("w").alias("w"))


def checked_positions(positions: DataFrame) -> DataFrame:
    """Positions (position_id, economic_lot_id, kind, amount, frozen_amount, node, security) whose ids and lots are unique, whose amounts are finite and not negative, and of
    which only cash is frozen, up to its amount."""
    frozen = F.coalesce("frozen_amount", F.lit(0.0))
    require(
        positions,
        amount=F.isnan("amount") | (F.abs("amount") == float("inf")) | (F.col("amount") < 0),
        kind=~F.col("kind").isin("fund", "unknown", *DIRECT),
        frozen=(frozen < 0) | (frozen > F.when(F.col("kind") == "cash", F.col("amount")).otherwise(0.0)),
        unnamed=F.col("kind").isin(*DIRECT) & F.col("security").isNull(),
    )
    for key in ("position_id", "economic_lot_id"):
        if not positions.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
            raise InputError(f"{key} is missing or repeated: a lot is entered once")
    return positions


def account_exposure(positions: DataFrame, holdings: DataFrame, master: DataFrame, depth: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exposures, unknown, cash) of an account.

    ``master`` has security, kind, issuer, industry, duration and source, the evidence for all of them. A fund's amount goes to its leaves by path weight; direct lots stand for
    themselves. What the master doesn't know, funds without disclosure and positions of unknown kind are unknown with a reason, and known and unknown amounts must sum to the
    account. ``cash`` keeps apart what is available, frozen, and cash inside funds, which nobody can withdraw.
    """
    checked_positions(positions)
    master = master.where("length(trim(source)) > 0")
    funds = positions.where("kind = 'fund'")
    known = holdings.select(F.col("node")).distinct()
    walked = paths(holdings, funds.select(F.col("node").alias("root")).join(known, F.col("root") == F.col("node"), "left_semi"), depth)
    through = funds.select("position_id", F.col("node").alias("root"), "amount").join(walked, "root").select("position_id", F.col("leaf").alias("security"), "kind",
        (F.col("amount") * F.col("w")).alias("amount"), "reason", F.lit("fund_disclosure").alias("origin"))
    blind = funds.join(known, "node", "left_anti").select("position_id", F.lit(None).cast("string").alias("security"), F.lit("unknown").alias("kind"), "amount",
        F.lit("missing_fund_disclosure").alias("reason"), F.lit("fund_disclosure").alias("origin"))
    own = positions.where(F.col("kind") != "fund").select("position_id", "security", "kind", "amount", F.when(F.col("kind") == "unknown", "root_classification_unknown").alias("reason"),
        F.lit("direct_account").alias("origin"))
    rows = through.unionByName(blind).unionByName(own)
    told = rows.join(master.select("security", F.col("kind").alias("told"), "issuer", "industry", "duration"), "security", "left")
    told = told.withColumn("reason", F.coalesce("reason", F.when(F.col("told").isNull(), "missing_security_identity_or_kind_evidence")))
    told = written(told, "exposure")
    require(told, kind_conflict=F.col("reason").isNull() & (F.col("told") != F.col("kind")))
    exposures = told.where("reason IS NULL").drop("told", "reason")
    unknown = told.where("reason IS NOT NULL").select("position_id", "security", "amount", "reason")
    sums = told.agg(F.sum("amount").alias("parts")).crossJoin(positions.agg(F.sum("amount").alias("total"))).first()
    if not sums["total"] or sums["total"] <= 0 or abs(sums["parts"] - sums["total"]) > max(1e-7, 1e-10 * sums["total"]):
        raise InputError("known and unknown amounts must sum to a positive account")
    is_cash = F.col("kind") == "cash"
    frozen = F.coalesce("frozen_amount", F.lit(0.0))
    cash = positions.agg(F.coalesce(F.sum(F.when(is_cash, F.col("amount") - frozen)), F.lit(0.0)).alias("available"), F.coalesce(F.sum(F.when(is_cash, frozen)), F.lit(0.0)).alias("frozen"))
    inside = exposures.agg(F.coalesce(F.sum(F.when(is_cash & (F.col("origin") == "fund_disclosure"), F.col("amount"))), F.lit(0.0)).alias("fund_cash"))
    return exposures, unknown, cash.crossJoin(inside)


def root_kinds(positions: DataFrame) -> DataFrame:
    """(level, key, amount) of the account's positions as they are, beside what they hold."""
    return positions.groupBy(F.col("kind").alias("key")).agg(F.sum("amount").alias("amount")).select(F.lit("root_kind").alias("level"), "key", "amount")


def fund_input(holdings: DataFrame, master: DataFrame, weights: DataFrame, account: str = "account") -> DataFrame:
    """Edges (node, child, kind, weight) from rows that may repeat a holding (node, kind, ident, weight): repeats are summed, identities that ``master`` (ident, security)
    doesn't map become unknown, and ``weights`` (node, weight) of an account are edges from a node of its own name, which no fund may have."""
    if not holdings.where(F.col("node") == account).isEmpty() or not weights.where(F.col("node") == account).isEmpty():
        raise InputError("a fund has the account's name")
    summed = holdings.groupBy("node", "kind", "ident").agg(F.sum("weight").alias("weight"))
    named = summed.join(master.select("ident", "security"), "ident", "left")
    is_fund = F.col("kind") == "fund"
    child = F.when(is_fund, F.col("ident")).otherwise(F.coalesce("security", F.concat(F.lit("unmapped:"), F.col("ident"))))
    kind = F.when(is_fund | F.col("security").isNotNull(), F.col("kind")).otherwise("unknown")
    edges = named.select("node", child.alias("child"), kind.alias("kind"), "weight").groupBy("node", "child", "kind").agg(F.sum("weight").alias("weight"))
    top = weights.groupBy("node").agg(F.sum("weight").alias("weight")).select(F.lit(account).alias("node"), F.col("node").alias("child"), F.lit("fund").alias("kind"), "weight")
    return top.unionByName(edges)


def complete_universe(members: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """(keys, complete): whether every member of a reference universe (keys, security) has a value (keys, security, value)."""
    joined = members.join(values, [*keys, "security"], "left")
    return joined.groupBy(*keys).agg((F.count_if(F.col("value").isNull()) == 0).alias("complete"))


def percentile_in(targets: DataFrame, members: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, target, percentile): 100 times the share of the universe below a target and half of what equals it; null for a universe with a member without value.
    Targets take their place among the values in one running count, so no target is put beside each value below it."""
    u = members.join(values, [key, "security"], "left").groupBy(key, "value").agg(F.count("*").alias("n"))
    u = written(u, "universe")
    whole = u.groupBy(key).agg((F.count_if(F.col("value").isNull()) == 0).alias("complete"), F.sum("n").alias("all"))
    asked = targets.where("target is not null").select(key, F.col("target").alias("value"), F.lit(0).cast("long").alias("n"))
    each = u.where("value is not null").unionByName(asked).groupBy(key, "value").agg(F.sum("n").alias("n"))
    at = counted_up(each, "value", "n", "upto", key).withColumnRenamed("value", "target")
    place = F.col("upto") - F.col("n") / 2
    out = targets.select(key, "target").join(at, [key, "target"], "left").join(whole, key)
    return out.select(key, "target", F.when(F.col("complete"), F.coalesce(100 * place / F.col("all"), F.lit(0.0))).alias("percentile"))
