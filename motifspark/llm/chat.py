"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that
reply is trainable. Rendered turns read ``### Role:\\n`` text ``</turn>\\n``; a backslash in a role or
text is doubled and a control string gets a backslash inside it, so the output parses back exactly.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ":\n", "</turn>\n"
EXAMPLES = "conv_id long, example_no int, n_turns int, text string, loss_start int, loss_end int"
_TURN = re.compile(r"### (.*?):\n(.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    """No output holds ``###``, ``</`` or ``:`` + newline; ``\\`` is doubled first, so this is reversible."""
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</", "\\e").replace(":\n", "\\c")


_BACK = {"\\\\": "\\", "\\h": "###", "\\e": "</", "\\c": ":\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hec]", lambda m: _BACK[m[0]], text)


def render(role: str, text: str) -> tuple[str, str, str]:
    return HEAD + escape(role) + SEP, escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _expanded(batches, most: int = 4 << 20):
    """Examples of rows sorted by conversation and turn; a conversation's prefix is kept while its rows pass."""
    out: list[tuple] = []
    size = 0
    state = {"id": None, "parts": [], "n": 0, "k": 0, "tail": False, "chars": 0, "seen": False}

    def close():
        if state["seen"] and state["tail"]:
            return [(state["id"], state["k"], state["n"], "".join(state["parts"]), 0, 0)]
        return []

    def batch(rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        names = ("conv_id", "example_no", "n_turns", "text", "loss_start", "loss_end")
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], list(names))

    for b in batches:
        for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if not state["seen"] or conv != state["id"]:
                out += close()
                state.update(id=conv, parts=[], n=0, k=0, tail=False, chars=0, seen=True)
            head, body, end = render(role, text)
            state["n"] += 1
            state["parts"].append(head + body + end)
            start = state["chars"] + len(head)
            state["chars"] = start + len(body) + len(end)
            state["tail"] = role != "assistant"
            if role == "assistant":
                state["parts"] = ["".join(state["parts"])]
                out.append((conv, state["k"], state["n"], state["parts"][0], start, start + len(body)))
                state["k"] += 1
                size += state["chars"]
            if size >= most or len(out) >= 4096:
                yield batch(out)
                out, size = [], 0
    out += close()
    if out:
        yield batch(out)


def expand(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Examples (conv_id, example_no, n_turns, text, loss_start, loss_end) of ``turns`` (conv_id, turn, role, text).

    One example for each assistant turn, in turn order; loss_start and loss_end are code points of its text.
    A conversation that does not end with an assistant turn gets one more example without a trainable part
    (loss_start = loss_end = 0), so no turn is lost. Null text or role: empty. Rows with an equal turn are
    ordered by role, then text; repeated rows stay. Null conv_id is one conversation. Empty table: no rows.
    A conversation is held while its rows pass, as each of its examples contains all turns before.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_expanded, EXAMPLES)


def _digested(batches):
    """Digests of examples in order, read back from the formatted texts alone."""
    state: dict = {"id": None, "seen": False}

    def close():
        if not state["seen"]:
            return []
        turns = hashlib.sha256()
        found = parse(state["last"])
        for role, text in found:
            turns.update(f"{role}\n{text}\n".encode())
        return [(state["id"], len(found), turns.hexdigest(), state["loss"], state["sha"].hexdigest(), state["chars"])]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    out: list[tuple] = []
    for b in batches:
        for conv, text, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
            if not state["seen"] or conv != state["id"]:
                out += close()
                state = {"id": conv, "seen": True, "sha": hashlib.sha256(), "loss": 0, "chars": 0}
            state["last"] = text
            own = unescape(text[lo:hi])
            state["loss"] += len(own)
            state["sha"].update(own.encode())
            state["chars"] += len(text)
        if len(out) >= 4096:
            yield batch(out)
            out = []
    out += close()
    if out:
        yield batch(out)


def digest(examples: DataFrame) -> DataFrame:
    """One row for each conversation of ``expand``'s rows, in the order it made them."""
    return examples.mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
