import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, first string, cell string"
BITS = ["<", "[", "\\", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "[SAYS]", "s>", "/INST]", "a", " ", "\n", "é"]
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}


def frame(spark, turns):
    return spark.createDataFrame([(*t, "x", "y") for t in turns], SCHEMA).repartition(5)


def cost(text):
    return 2 + len(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]", text))


def safe(text):
    return re.sub(r"<(?=<SYS>>|</SYS>>|/?s>)|\[(?=/?INST\]|/?TURN\]|SAYS\])", lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def brute(turns, budget, history, size):
    """{conv_id: [(text, loss spans, repeated, texts in the mask)]} turn by turn."""
    out = {}
    for conv in sorted({t[0] for t in turns if t[0] is not None}):
        rows = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        rows = [r[2:] for r in rows]
        lead = rows[0] if rows[0][0] == "system" else None
        body = rows[1:] if lead else rows
        room = max(1, budget - history - (cost(lead[1]) if lead else 0))
        starts, at, begin = [], 0, []
        for role, text in body:
            begin.append(at)
            n = cost(text)
            if not starts or at // size != starts[-1] // size or at + n - starts[-1] > room:
                starts.append(at)
            at += n
        found = []
        for k, s in enumerate(starts or [0]):
            until = starts[k + 1] if k + 1 < len(starts) else 1 << 60
            old = [(r, False) for r, b in zip(body, begin) if s - history <= b < s]
            new = [(r, True) for r, b in zip(body, begin) if s <= b < until]
            held = ([(lead, k == 0)] if lead else []) + old + new
            text, spans, texts = "", [], []
            for (role, said), fresh in held:
                opening, closing = ROLES.get(role) or ("[TURN]" + safe(role) + "[SAYS]", "[/TURN]")
                if role == "assistant" and fresh:
                    spans.append((len(text) + len(opening), len(safe(said))))
                    texts.append(said)
                text += opening + safe(said) + closing
            found.append((text, spans, sum(not f for _, f in held), texts, [r for r, f in held if f]))
        out[conv] = found
    return out


def conversations():
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))
    turns = []
    for conv in range(25):
        lead = [("system", text(20))] if conv % 3 == 0 else []
        rows = lead + [(rng.choice(["user", "assistant", "assistant", "tool", "", "[SAYS]", "system"]), text(30)) for _ in range(rng.randint(0 if lead else 1, 60))]
        turns += [(conv, k, role, said) for k, (role, said) in enumerate(rows)]
    turns += [(50, k, ("user", "assistant")[k % 2], f"turn {k} of one long talk") for k in range(900)]  # more than one block of turns, many cells
    turns += [(60, 0, "system", "alone"), (61, 0, None, None), (61, None, "assistant", "late"), (61, 1, "assistant", ""), (62, 0, "assistant", "word " * 900), (None, 0, "user", "nobody's")]
    turns += [(63, 0, "user", "same")] * 3 + [(64, -5, "user", "first"), (64, 3, "assistant", "then")]
    return turns


@pytest.mark.parametrize("budget,history", [(60, 20), (40, 0), (512, 128)])
def test_windows(spark, budget, history):
    turns = conversations()
    got = {}
    for r in chat.windows(frame(spark, turns), budget, history).collect():
        got.setdefault(r["conv_id"], []).append((r["first"], r["text"], [tuple(s) for s in r["loss"]], r["n_repeated"]))
    want = brute(turns, budget, history, chat.CELL * budget)
    assert set(got) == set(want)
    for conv, rows in want.items():
        assert [x[1:] for x in sorted(got[conv])] == [(t, s, k) for t, s, k, *_ in rows], conv


def test_read_back(spark):
    turns = conversations()
    want = brute(turns, 60, 20, chat.CELL * 60)
    rows = {r["conv_id"]: r for r in chat.digests(chat.windows(frame(spark, turns), 60, 20)).collect()}
    assert set(rows) == set(want)
    for conv, found in want.items():
        every = [t for *_, new in found for t in new]
        loss = "".join(x for _, _, _, texts, _ in found for x in texts)
        r = rows[conv]
        assert every == [x[2:] for x in sorted((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv)]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(every), len(loss), sum(len(t) for t, *_ in found))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in every).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() == hashlib.sha256("".join(b for a, b in every if a == "assistant").encode()).hexdigest()


def test_no_turns(spark):
    assert chat.digests(chat.windows(frame(spark, []))).collect() == []
    with pytest.raises(ValueError):
        chat.windows(frame(spark, []), 10, 10)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=40, max_size=120))
def test_escapes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back")).collect()
    marks = [m for pair in ROLES.values() for m in pair] + ["[TURN]", "[/TURN]", "[SAYS]"]
    assert all(r["t"] == r["back"] and r["e"] == safe(r["t"]) and not any(m in r["e"] for m in marks) for r in rows)
