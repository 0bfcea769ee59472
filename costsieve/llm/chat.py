"""Chat formatting by event-sourced reconstruction.

The log has one row per event: conversation, sequence number, kind, message number, role, text.

* ``start`` opens a message with its role and first text;
* ``delta`` appends streamed text to it;
* ``edit`` replaces its text;
* ``regenerate`` empties its text and takes back all messages of larger numbers.

The fold is by message first: its events are gathered, those before a later regeneration of an
earlier message are dropped, and of the rest the last opening, edit or regeneration counts with
the deltas after it. Only then do a conversation's messages come together, in order of their
numbers, and are rendered. The only group that is ever gathered is thus one message's events and
one conversation's final messages, which are one output row.

Rendered turn: ``### role\\n text \\n</turn>\\n`` (blanks here for reading only). In texts and roles every
backslash, # and < is escaped by a backslash, in roles a line break as well, so neither marker can
come from a text, and reading back is exact. The loss mask is the list of spans (code points) of
the texts of assistant turns.

Defined cases: null texts and roles are empty; events of one sequence number are taken in order
of kind, then text; events of a message that was never opened have an empty role; a null
conversation is one conversation; an empty log has no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("start", "delta", "edit", "regenerate")
LOSS_ROLE = "assistant"
PIECE = 256
_SPECIAL = re.compile(r"[\\#<]")
_ROLE_SPECIAL = re.compile(r"[\\#<\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\\n]*(?:\\.[^\\\n]*)*)\n([^\\#<]*(?:\\.[^\\#<]*)*)\n</turn>\n", re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = "### " + _ROLE_SPECIAL.sub(r"\\\g<0>", role) + "\n"
        body = _SPECIAL.sub(r"\\\g<0>", text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(parts), spans


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again. A text that the template can't have made is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a rendered conversation at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): the final messages of a log (conv_id, seq, kind, msg, role, text)."""
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = events.groupBy("conv_id", "msg").agg(
        F.collect_list(event).alias("events"),
        F.max(F.when(F.col("kind") == "start", F.struct("seq", F.coalesce("role", F.lit("")).alias("role")))).alias("opened"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    taken_back = by_message.withColumn("back", F.max("again").over(earlier))
    alive = F.array_sort(F.filter("events", lambda e: F.col("back").isNull() | (e["seq"] > F.col("back"))))
    kept = taken_back.withColumn("events", alive).where(F.size("events") > 0)
    # the place of the last event that sets the text; events before it don't count
    resets = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(0)))
    kept = kept.withColumn("from", F.greatest(resets, F.lit(1)))
    texts = F.transform(F.slice("events", F.col("from"), F.size("events")),
                        lambda e: F.when(e["kind"] == "regenerate", "").otherwise(e["text"]))
    return kept.select("conv_id", "msg", F.coalesce("opened.role", F.lit("")).alias("role"),
                       F.array_join(texts, "").alias("text"))


def _render(batches):
    for batch in batches:
        names = batch.schema.names
        out, spans, counts = [], [], []
        for turns in batch.column(names.index("turns")).to_pylist():
            text, where = render([(t["role"], t["text"]) for t in turns])
            out.append(text)
            spans.append([{"start": a, "end": b} for a, b in where])
            counts.append(len(turns))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index("conv_id")), pa.array(out, pa.string()), pa.array(spans, kind), pa.array(counts, pa.int64())],
            names=["conv_id", "formatted", "loss", "n_turns"])


def format_log(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start,end>>, n_turns) for each conversation of a log."""
    chats = fold(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "role", "text"))).alias("turns"))
    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(_render, f"conv_id {kind}, formatted string, loss array<struct<start:bigint,end:bigint>>, n_turns long")


def log_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The event log of a table of finished turns: each opens a message and streams its text in
    deltas of ``piece`` characters. Rows of one turn number are messages in order of role, text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    n = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        i.alias("i"), F.when(i == 0, "").otherwise(F.substring(F.col("text"), (i - 1) * piece + 1, F.lit(piece))).alias("text")))
    steps = rows.select("conv_id", "msg", "role", F.explode(pieces).alias("p"))
    return steps.select("conv_id", (F.shiftleft("msg", 32) + F.col("p.i")).alias("seq"),
                        F.when(F.col("p.i") == 0, "start").otherwise("delta").alias("kind"), "msg", "role",
                        F.col("p.text").alias("text"))


def _digest(batches):
    for batch in batches:
        rows = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
        for text, loss in zip(rows["formatted"], rows["loss"]):
            turns = parse(text)
            masked = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(masked))
            out["loss_sha256"].append(hashlib.sha256(masked.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("conv_id")), *[pa.array(x) for x in out.values()]],
                                         names=["conv_id", *out])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks hold."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        _digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
