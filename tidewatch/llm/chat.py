"""Chat formatting from event logs.

A conversation is the fold of its log. Events have conv_id, turn (the message's place), seq, kind, role and text:
``message`` sets a message, ``delta`` adds to its text, ``edit`` replaces its text, ``regenerate`` empties it for the
deltas that follow, ``delete`` removes it. Logs are partitioned by conversation and message, sorted by sequence and
folded as a stream, one message in memory at a time; a message is then rendered on its own. So a hot conversation is
spread over tasks; only a digest over a whole conversation reads its rendered messages in order, again as a stream.

Template: a message is ``<s>``, its role, a newline, its text, a newline, ``</s>``; messages that the model isn't to
learn stand in ``[INST]`` and ``[/INST]``. The loss mask is a character range of each rendered message: an
assistant's text. Control strings inside texts and roles get a backslash before them, after any backslashes that
stand there, so that reading back takes exactly one away; backslashes and newlines in roles are written as in Python.

Defined results: null texts are empty; null roles are empty; events of equal seq keep the order message, regenerate,
edit, delta, delete, then of their text; deltas without a message make one; a conversation whose messages are all
deleted, and an empty log, give no rows. Repeated messages of one turn (equal seq) fold into the last; in the query each
row is a message of its own, those of one turn in the order of role and text, and rows without a turn come last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED = "assistant"
_PLAIN = re.compile(r"(\\*)(<s>|</s>|\[INST\]|\[/INST\])")
_ESCAPED = re.compile(r"\\(\\*)(<s>|</s>|\[INST\]|\[/INST\])")
KINDS = ("message", "regenerate", "edit", "delta", "delete")
EVENTS = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered message and its loss range (equal ends: none)."""
    head = "<s>" + ("" if role == LEARNED else "[INST]") + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    out = head + body + "\n" + ("" if role == LEARNED else "[/INST]") + "</s>"
    return out, *((len(head), len(head) + len(body)) if role == LEARNED else (0, 0))


def parse(rendered: str) -> tuple[str, str]:
    """(role, text) of one rendered message."""
    learned = not rendered.startswith("<s>[INST]")
    head, _, rest = rendered[3 if learned else 9 :].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(rest[: -5 if learned else -12])


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the final messages, each with its place.

    Events may have ``copy``, which tells messages of one turn apart.
    """
    copy = F.col("copy").cast("bigint") if "copy" in events.columns else F.lit(0).cast("bigint")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = events.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("seq").cast("bigint"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), copy.alias("copy"))
    log = log.repartition("conv_id", "turn", "copy").sortWithinPartitions("conv_id", "turn", "copy", F.col("seq").asc_nulls_first(), rank, "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, dead = None, "", [], False

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["conv_id", "turn", "role", "text", "copy"])

        for b in batches:
            out = []
            for conv, turn, _, kind, who, text, copy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, turn, copy) != key:
                    if key is not None and not dead:
                        out.append((*key[:2], role, "".join(parts), key[2]))
                    key, role, parts, dead = (conv, turn, copy), who, [], False
                if kind == "delta":
                    parts.append(text)
                    role = role or who
                elif kind == "delete":
                    dead = True
                elif kind == "regenerate":
                    parts = []
                else:
                    parts, dead, role = [text], False, who or role
            if out:
                yield batch(out)
        if key is not None and not dead:
            yield batch([(*key[:2], role, "".join(parts), key[2])])

    return log.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, copy bigint")


def formatted(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end, copy): a conversation's output is its rows' ``rendered`` in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), b.column(4)], names=["conv_id", "turn", "rendered", "loss_start", "loss_end", "copy"])

    return messages.mapInArrow(run, "conv_id bigint, turn bigint, rendered string, loss_start bigint, loss_end bigint, copy bigint")


def read_back(output: DataFrame) -> DataFrame:
    """Digests of each conversation, from the rendered output alone, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, turns, loss, n_loss, chars, begun = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, False
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            out = []
            for c, _, rendered, start, end, _ in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv or not begun:
                    if begun:
                        out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
                    conv, n, turns, loss, n_loss, chars, begun = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True
                role, text = parse(rendered)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(rendered[start:end])
                loss.update(learned.encode("utf-8", "surrogatepass"))
                n, n_loss, chars = n + 1, n_loss + len(learned), chars + len(rendered)
            if out:
                yield batch(out)
        if begun:
            yield batch([(conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars)])

    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "copy")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log of one message for each row of (conv_id, turn, role, text)."""
    of_turn = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = conversations.withColumn("copy", F.row_number().over(of_turn).cast("bigint"))
    return numbered.select("conv_id", "turn", F.lit(0).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text", "copy")


def query(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(own)
    return read_back(formatted(fold(events_of(rows))))
