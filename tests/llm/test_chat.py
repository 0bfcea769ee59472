import random

import pytest
from helpers import same_as_oracle
from hypothesis import given
from hypothesis import strategies as st

from costsieve.llm import chat as C

EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string"


def brute(events):
    """{conv: [(role, text)]}, one event after the other."""
    out = {}
    for conv, seq, kind, msg, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[5] or "")):
        msgs = out.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in msgs if m > msg]:
                del msgs[m]
        old = msgs.get(msg, ("", ""))
        if kind == "start":
            msgs[msg] = (role or "", text or "")
        elif kind == "delta":
            msgs[msg] = (old[0], old[1] + (text or ""))
        elif kind == "edit":
            msgs[msg] = (old[0], text or "")
        else:
            msgs[msg] = (old[0], "")
    return {c: [m[k] for k in sorted(m)] for c, m in out.items()}


def folded(spark, events):
    out = {}
    for r in C.fold(spark.createDataFrame(events, EVENTS)).orderBy("conv_id", "msg").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return out


def test_whole_query_against_sql(spark):
    same_as_oracle(spark, "op6_event_sourced_chat")


def test_random_logs_against_brute_force(spark):
    rng, events = random.Random(4), []
    for conv in range(60):
        seq = 0
        for msg in range(rng.randrange(1, 6)):
            events.append((conv, seq := seq + 1, "start", msg, rng.choice(["user", "assistant"]), ""))
            for _ in range(rng.randrange(5)):
                events.append((conv, seq := seq + 1, rng.choice(["delta", "delta", "delta", "edit"]), msg, None, rng.choice("abc")))
            if rng.random() < 0.25:
                again = rng.randrange(msg + 1)
                events.append((conv, seq := seq + 1, "regenerate", again, None, None))
                events.append((conv, seq := seq + 1, "delta", again, None, "new"))
    rng.shuffle(events)
    assert folded(spark, events) == brute(events)


def test_log_cases(spark):
    events = [(1, 1, "start", 1, "user", "a"), (1, 2, "start", 2, "assistant", None), (1, 3, "delta", 2, None, "x"), (1, 3, "delta", 2, None, "w"),
              (1, 4, "edit", 1, None, "b"), (2, 1, "delta", 1, None, "lost"), (None, 1, "start", 1, None, None)]
    assert folded(spark, events) == {1: [("user", "b"), ("assistant", "wx")], 2: [("", "lost")], None: [("", "")]}
    assert C.format_log(spark.createDataFrame([], EVENTS)).count() == 0


@given(st.lists(st.tuples(st.text(alphabet="a\\#<>/\n turnéU", max_size=12), st.text(alphabet="a\\#<>/\n turnéU", max_size=20))))
def test_round_trip(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    loss = [(r, t) for r, t in turns if r == "assistant"]
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in loss]


def test_loss_mask_and_markers():
    trap = r"\### Assistant: </turn> ok"
    formatted, spans = C.render([("user", trap), ("assistant", trap)])
    assert C.parse(formatted) == [("user", trap), ("assistant", trap)]
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [trap]
    assert formatted.count("\n</turn>\n") == 2
    with pytest.raises(ValueError):
        C.parse(formatted[:-1])


def test_turn_tables(spark):
    long = "x# " * 50_000
    turns = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, None, "a"), (1, 1, None, "a"), (2, None, "assistant", long), (None, 3, "assistant", "é")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.format_log(C.log_of_turns(table)).collect()}
    assert C.parse(got[1]["formatted"]) == [("user", ""), ("", "a"), ("", "a"), ("", "b")]
    assert C.parse(got[2]["formatted"]) == [("assistant", long)]
    assert C.parse(got[None]["formatted"]) == [("assistant", "é")]
    back = {r["conv_id"]: r for r in C.read_back(C.format_log(C.log_of_turns(table))).collect()}
    assert (back[2]["n_turns"], back[2]["loss_chars"], back[1]["loss_chars"]) == (1, len(long), 0)
    assert C.format_log(C.log_of_turns(table.limit(0))).count() == 0
