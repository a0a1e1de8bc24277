"""Chat formatting through a template that is only called, never looked into.

Successive prefixes of a conversation are rendered; where the output for k + 1
turns begins with that for k turns, the rest is the span of turn k, and where it
doesn't, the template rewrites history. Rendering the last turn once more with a
marker for its text tells how much of the span stands before and after the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.stores import Workspace

Turns = list[tuple[str, str]]
#: A text that no escaping changes and that no conversation holds by chance.
MARKER = "turntext"


@dataclass
class Located:
    """The rendered conversation; spans are (start, end) in code points."""

    output: str
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    #: First turn whose rendering changed what stood before it; None if there is none.
    rewritten_at: int | None = None


def locate(render: Callable[[Turns], str], turns: Turns) -> Located:
    """Spans of all turns and of their texts.

    Once a template has rewritten history, spans of a prefix don't hold in the
    final output, so there are none and ``rewritten_at`` says where it happened.
    """
    before, spans, texts = render([]), [], []
    head = len(before)
    for k, (role, text) in enumerate(turns):
        after = render(turns[: k + 1])
        if not after.startswith(before):
            return Located(render(turns), rewritten_at=k)
        marked = render([*turns[:k], (role, MARKER)])
        at = marked.find(MARKER, len(before)) if marked.startswith(before) else -1
        spans.append((head, len(after)))
        if at >= 0:
            texts.append((at, len(after) - (len(marked) - at - len(MARKER))))
        else:  # a template that doesn't show this turn's text
            texts.append((len(after), len(after)))
        before, head = after, len(after)
    return Located(before, spans, texts)


# --- the own template ---------------------------------------------------------------

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_OPEN = re.compile(r"[\\<\[]")
_CLOSED = re.compile(r"([\\<\[])\\")


def escape(text: str) -> str:
    """Put a backslash behind each backslash, < and [: no control string is left, and it can be undone."""
    return _OPEN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"\1", text)


def render(turns: Turns) -> str:
    """Users stand in [INST], assistants end with </s>, any other role is named in [ROLE]."""
    parts = []
    for role, text in turns:
        text = escape(text)
        if role == "user":
            parts.append(f"<s>[INST] {text} [/INST]")
        elif role == "assistant":
            parts.append(f" {text} </s>")
        else:  # "<n" can't occur in an escaped text
            parts.append(f"<s>[ROLE] {escape(role).replace(chr(10), '<n')}\n{text} [/ROLE]")
    return "".join(parts)


def parse(span: str) -> tuple[str, str]:
    """(role, text) of one turn's span."""
    if span.startswith("<s>[INST] "):
        return "user", unescape(span[10:-8])
    if span.startswith("<s>[ROLE] "):
        role, _, text = span[10:-8].partition("\n")
        return unescape(role.replace("<n", "\n")), unescape(text)
    return "assistant", unescape(span[1:-5])


# --- on Spark -------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("turns", SPANS), T.StructField("loss", SPANS), T.StructField("rewritten_at", T.LongType())])
#: Characters of finished conversations in one Arrow batch.
BATCH_CHARS = 8 << 20


def _formatter(template: Callable[[Turns], str], learned: str):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", spans), ("loss", spans),
                        ("rewritten_at", pa.int64())])

    def row(conv_id, turns):
        found = locate(template, turns)
        as_rows = [{"start": a, "end": b} for a, b in found.turns]
        loss = [{"start": a, "end": b} for (a, b), (role, _) in zip(found.texts, turns) if role == learned]
        return {"conv_id": conv_id, "formatted": found.output, "turns": as_rows, "loss": loss,
                "rewritten_at": found.rewritten_at}

    def form(batches):
        now, turns, done, held = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv_id != now:
                    done.append(row(now, turns))
                    held += len(done[-1]["formatted"])
                    turns = []
                    if held > BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, held = [], 0
                now = conv_id
                turns.append((role, text))
        if turns:
            done.append(row(now, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return form


def formatted(conversations: DataFrame, template: Callable[[Turns], str] = render, learned: str = "assistant") -> DataFrame:
    """One row per conversation: the output, the span of each turn and the loss mask.

    The mask holds the text of each turn of role ``learned``. Turns are ordered by
    (turn, role, text), null first, and rows that repeat stay; null role and text
    are empty strings, a null conv_id is a conversation of its own; other columns
    are not looked at and an empty table gives no rows. Conversations stream
    through sorted partitions, so a task holds one of them at a time. Rendering
    prefixes costs the square of a conversation's own turns; that is the method.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(template, learned), FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text, whole = r["formatted"], hashlib.sha256()
            for s in r["turns"]:
                role, said = parse(text[s["start"]:s["end"]])
                whole.update(f"{role}\n{said}\n".encode())
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in r["loss"])
            out.append({"conv_id": r["conv_id"], "n_turns": len(r["turns"]), "turns_sha256": whole.hexdigest(),
                        "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(text)})
        yield pa.RecordBatch.from_pylist(out).select(names) if out else pa.RecordBatch.from_pylist(
            [], pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))


def read_back(conversations: DataFrame) -> DataFrame:
    """Write the formatted conversations of the own template, read them again and parse them."""
    ws = Workspace(conversations.sparkSession, "chat")
    return ws.write(formatted(conversations), "formatted").select("conv_id", "formatted", "turns", "loss").mapInArrow(
        _digests, DIGESTS)
