r"""Operator 13: conversations as formatted training windows under a token budget.

Prefix sums of turn tokens place every turn on its conversation's token line. A window is a run of whole turns: it takes new turns while
they fit in what the budget leaves beside the system turn and the history, repeats the system turn and as many whole turns before it as
the history allows, and has a loss mask over the assistant texts that are new in it, so each is a target exactly once. A turn that is
longer than the room is a window's only new turn, whole.

Tokens are counted by rule, as no tokenizer runs in built-in functions: one for each run of letters, digits and characters beyond ASCII,
one for each other printable sign, two for a turn's marks. Marks are the control strings below. In texts and roles a backslash becomes
two, and a control string gets one after its first character, so no text can hold a mark and reading back is exact.

Built-in functions only. Prefix sums are taken in blocks of ``BLOCK`` turn numbers whose totals are then summed for each conversation;
windows are chosen in cells of ``CELL`` budgets of the token line, and a window never crosses a cell's border. So the turns of one
conversation spread over tasks however many it has; only rows that share one conversation and one run of turn numbers are sorted together.

Cases: null text is empty text, null role the empty role. Turns go by number, those without one last, ties by role and then by a hash of
the text; repeated rows are turns of their own. Rows without conv_id can't be named in a result and are left out. A conversation of a
system turn alone is one window. An empty table gives an empty result. Extra columns aren't read. :func:`digests` needs a conversation's
whole text in one row, as a digest goes over it in order; windows don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings that open and close the turns of known roles, those of other roles, and what ends such a role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, SAYS = ("[TURN]", "[/TURN]"), "[SAYS]"
#: A first character of a control string, and what closes a turn.
_CONTROL = r"(<(?=<SYS>>|</SYS>>|/?s>)|\[(?=/?INST\]|/?TURN\]|SAYS\]))"
_CLOSE = r"<</SYS>>|\[/INST\]|</s>|\[/TURN\]"
#: What counts as a token.
_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"
#: Tokens of a window and of the history in it; turn numbers of a block of prefix sums; budgets in a cell.
BUDGET, HISTORY, BLOCK, CELL = 512, 128, 256, 16


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(_TOKEN)) + 2).cast("long")


def _of_role(role: Column, known: dict[str, Column], other: Column) -> Column:
    """``known[role]``, or ``other``."""
    out = None
    for name, value in known.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def positions(turns: DataFrame) -> DataFrame:
    """Each turn with ``pos`` (from 0), ``system`` (a leading system turn), ``start`` (tokens of the turns before it, without such a turn) and ``total``, the
    conversation's tokens without it."""
    text, role, block = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit("")), F.floor(F.col("turn") / BLOCK).cast("long")
    rows = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # a block may be null: -1 in a column of its own keeps joins simple
    rows = rows.select("*", F.xxhash64("text").alias("h"), tokens(F.col("text")).alias("n"), F.col("turn").isNull().alias("late"), F.coalesce(block, F.lit(0)).alias("block"))
    key = ["conv_id", "late", "block"]
    order = ["late", "turn", "role", "h"]
    totals = rows.groupBy(*key).agg(F.sum("n").alias("tokens"), F.count("*").alias("turns"), F.min(F.struct(*order, "n")).alias("lead"))
    line = Window.partitionBy("conv_id").orderBy("late", "block")
    before, every = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first("lead").over(every)
    own = F.when(lead["role"] == "system", lead["n"]).otherwise(0)
    sums = totals.select(
        *key,
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("token_base"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turn_base"),
        (F.sum("tokens").over(every) - own).alias("total"),
        own.alias("own"),
        (lead["role"] == "system").alias("led"),
    )
    inside = Window.partitionBy(*key).orderBy("turn", "role", "h")
    local = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = rows.select("*", local.alias("local"), (F.row_number().over(inside) - 1).alias("nth")).join(sums, key)
    return placed.select(
        "conv_id",
        (F.col("turn_base") + F.col("nth")).alias("pos"),
        "role",
        "text",
        "n",
        "total",
        (F.col("led") & (F.col("turn_base") + F.col("nth") == 0)).alias("system"),
        (F.col("token_base") + F.col("local") - F.col("own")).alias("start"),
    )


def _rendered(rows: DataFrame) -> DataFrame:
    """``open`` (characters before the text), ``body`` (characters of the escaped text), ``shown`` (the whole turn)."""
    opening = _of_role(F.col("role"), {r: F.lit(m[0]) for r, m in MARKS.items()}, F.concat(F.lit(OTHER[0]), escaped(F.col("role")), F.lit(SAYS)))
    closing = _of_role(F.col("role"), {r: F.lit(m[1]) for r, m in MARKS.items()}, F.lit(OTHER[1]))
    rows = rows.select("*", opening.alias("opening"), closing.alias("closing"), escaped(F.col("text")).alias("safe"))
    return rows.select("*", F.length("opening").alias("open"), F.length("safe").alias("body"), F.concat("opening", "safe", "closing").alias("shown"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, first (position of the first new turn), text, loss (array of start and length in characters), n_turns in the text, n_repeated of them at its
    beginning, n_tokens."""
    if not 0 <= history < budget:
        raise ValueError("the history must be smaller than the budget")
    size = CELL * budget
    rows = _rendered(positions(conversations))
    cell = F.floor(F.col("start") / size).cast("long")
    place = lambda c, kind: F.struct(c.cast("long").alias("cell"), F.lit(kind).alias("kind"))
    # a system turn goes to every cell, the last turns of a cell also to the next one, as history
    last = F.greatest(F.floor((F.col("total") - 1) / size).cast("long"), F.lit(0).cast("long"))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: place(c, 0))
    both = F.when(F.col("start") >= (cell + 1) * size - history, F.array(place(cell, 2), place(cell + 1, 1))).otherwise(F.array(place(cell, 2)))
    spread = rows.select("*", F.inline(F.when(F.col("system"), everywhere).otherwise(both)))
    turn = F.struct("pos", "kind", "start", "n", "open", "body", (F.col("role") == "assistant").alias("target"), "shown")
    cells = spread.groupBy("conv_id", "cell").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    new = F.filter("turns", lambda t: t["kind"] == 2)
    own = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + F.when(t["kind"] == 0, t["n"]).otherwise(0))
    room = F.greatest(F.lit(budget - history) - own, F.lit(1))
    cells = cells.select("*", new.alias("new"), room.alias("room")).where("size(new) > 0 or cell = 0")
    opened = lambda acc, t: F.when((F.size(acc) > 0) & (t["start"] + t["n"] - F.element_at(acc, -1) <= F.col("room")), acc).otherwise(F.concat(acc, F.array(t["start"])))
    starts = F.aggregate(F.transform("new", lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n"))), F.array().cast("array<bigint>"), opened)
    cells = cells.select("*", F.when(F.size("new") == 0, F.array(F.lit(0).cast("long"))).otherwise(starts).alias("starts"))

    def window(start: Column, k: Column) -> Column:
        until = F.coalesce(F.get("starts", k + 1), F.lit(2**62))
        held = F.filter("turns", lambda t: (t["kind"] == 0) | (t["start"] >= start - history) & (t["start"] < until))
        fresh = lambda t: F.when(t["kind"] == 0, (F.col("cell") == 0) & (k == 0)).otherwise((t["kind"] == 2) & (t["start"] >= start))
        return F.transform(held, lambda t: F.struct(t["pos"].alias("pos"), t["n"].alias("n"), t["open"].alias("open"), t["body"].alias("body"), t["shown"].alias("shown"),
            t["target"].alias("target"), fresh(t).alias("new")))

    out = cells.select("conv_id", F.explode(F.transform("starts", window)).alias("w"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def masked(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["open"]).alias("start"), t["body"].cast("long").alias("length"))
        return F.struct((acc["at"] + F.length(t["shown"])).alias("at"), F.when(t["new"] & t["target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return out.select(
        "conv_id",
        F.filter("w", lambda t: t["new"])[0]["pos"].alias("first"),
        F.array_join(F.transform("w", lambda t: t["shown"]), "").alias("text"),
        F.aggregate("w", nothing, masked)["spans"].alias("loss"),
        F.size("w").alias("n_turns"),
        F.size(F.filter("w", lambda t: ~t["new"])).alias("n_repeated"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, t: acc + t["n"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, first, turns (role, text) that are new in each window, targets (texts under the mask) and n_chars, from the windows' texts and masks alone."""
    cut = F.split("text", _CLOSE)
    shown = F.slice(cut, F.col("n_repeated") + 1, F.size(cut) - 1 - F.col("n_repeated"))

    def turn(part: Column) -> Column:
        at = F.instr(part, SAYS)
        role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, (opening, _) in MARKS.items():
            is_it = F.startswith(part, F.lit(opening))
            role, text = F.when(is_it, F.lit(name)).otherwise(role), F.when(is_it, F.substr(part, F.lit(len(opening) + 1))).otherwise(text)
        other = F.substr(part, F.lit(len(OTHER[0]) + 1), at - 1 - len(OTHER[0]))
        role, text = F.coalesce(role, unescaped(other)), F.coalesce(text, F.substr(part, at + len(SAYS)))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "first", F.transform(shown, turn).alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation: n_turns, turns_sha256 (role, line end, text, line end of each turn in order), loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("first", said.alias("said"), F.array_join("targets", "").alias("loss"))
    rows = read_back(formatted).select("conv_id", "n_chars", F.size("turns").alias("k"), part.alias("part"))
    whole = rows.groupBy("conv_id").agg(F.sum("k").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.select("*", F.array_join("parts.said", "").alias("said"), F.array_join("parts.loss", "").alias("loss"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
