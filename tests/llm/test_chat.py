"""Snapshot collapse against brute force."""

import random

import pytest

from storelake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    key = lambda x: tuple((v is not None, v) for v in x)  # noqa: E731  nulls first
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role if role is not None else "unknown", text if text is not None else ""))
    convs = {c: sorted(t, key=key) for c, t in convs.items()}
    said = {c: [x[1:] for x in t] for c, t in convs.items()}
    kept = {}
    for c, s in said.items():
        same = [d for d, o in said.items() if o == s]
        if any(len(o) > len(s) and o[: len(s)] == s for o in said.values()):
            continue
        named = [d for d in same if d is not None]
        if c == (min(named) if named else None):
            kept[c] = (len(s), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s))
    return kept


def _got(df):
    out = {}
    for r in chat.format_chats(df).orderBy("conv_id", "part").collect():
        n, copies, text = out.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        out[r.conv_id] = (n, copies, text + r.text)
    return out


@pytest.mark.parametrize("segment", [2, 512])
def test_collapse_matches_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = []
    for conv in range(300):
        n = rng.randint(1, 9)
        rows += [(conv, t, ("user", "assistant")[t % 2], rng.choice(["hi", "yes", "no"]) if t else "hi") for t in range(n)]
    rng.shuffle(rows)
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _brute(rows)


def test_edges(spark):
    rows = [
        (1, 0, "user", "a"),
        (2, 0, "user", "a"),
        (2, 1, None, None),
        (3, 0, "user", "a"),
        (3, 1, "unknown", ""),
        (None, 0, "user", "q"),
        (4, None, "user", "b"),
        (5, 0, "user", "dup"),
        (5, 0, "user", "dup"),
        (6, 0, "user", "dup"),
        (7, 0, "user", "x" * 200_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS n", "3 AS pos", "4 AS p1")
    assert _got(df) == _brute(rows)
    assert chat.format_chats(df.where("1 = 0")).count() == 0
