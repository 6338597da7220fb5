"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once as a whole, encoded once with character offsets, and its sorted turn spans are intersected with the token
spans by binary search. A token is under the loss mask when it shares a character with a span of a loss role; the character intervals kept
beside the mask are the exact intersections, so a token that straddles a boundary adds nothing from outside.

Template: ``### role: text</turn>`` and a line end for each turn. Inside texts and roles ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h`` and
``</turn>`` becomes ``\\t``; in roles also ``:`` becomes ``\\c``. No control string is left, and ``unescape`` restores every text.

Defined results: null role or text counts as empty; turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of
their own; rows of a null conversation id form one conversation. A conversation is one text by nature, so it is rendered in one task. Only conv_id, turn, role and
text are read: further columns may have any name; an empty table gives an empty result.
"""

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, small_batches

OUTPUT = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, loss_starts array<int>, loss_ends array<int>"
_CODES = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
_HEAD, _END = "### ", "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: _CODES[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the loss roles' texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', chr(92) + 'c')}: ", escape(text)
        at += len(head)
        if role in loss_roles and body:
            spans.append((at, at + len(body)))
        at += len(body) + 8
        parts += [head, body, "</turn>\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the formatted text; anything else than whole turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        # No colon is left in an escaped role and no end mark in an escaped text, so the first of each is the template's own.
        colon = formatted.find(": ", at)
        end = formatted.find(_END, colon)
        if not formatted.startswith(_HEAD, at) or colon < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : end])))
        at = end + len(_END)
    return out


def intersect(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of tokens that meet a span, and the merged character intervals they share, for sorted spans. Both arrays have rows (start, end)."""
    first = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")
    last = np.searchsorted(spans[:, 0], tokens[:, 1], side="left")
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(tokens)), n)
    span = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]] if len(n) else first, n) + np.arange(n.sum())
    start = np.maximum(tokens[token, 0], spans[span, 0])
    end = np.minimum(tokens[token, 1], spans[span, 1])
    # Several byte tokens can share one character, so intervals may repeat; they are cut at span borders.
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.r_[True, (start[1:] > reach[:-1]) | (span[1:] != span[:-1])] if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return n > 0, np.stack([start[at], np.maximum.reduceat(end, at)], 1) if len(at) else np.zeros((0, 2), np.int64)


@lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # special strings in a text are ordinary text
    return t


def format_conversations(rows: DataFrame, path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id and OUTPUT. ``rows``: conv_id, turn, role, text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    roles = frozenset(loss_roles)

    def run(batches):
        t = tokenizer(path)
        for batch in small_batches(batches):
            cols = [[] for _ in range(7)]
            for turns in batch.column(1).to_pylist():
                text, spans = render([(x["role"], x["text"]) for x in turns], roles)
                e = t.encode(text, add_special_tokens=False)
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                mask, kept = intersect(offsets, np.array(spans, np.int64).reshape(-1, 2))
                for c, v in zip(cols, (text, e.ids, offsets[:, 0], offsets[:, 1], mask, kept[:, 0], kept[:, 1]), strict=True):
                    c.append(v)
            ints = pa.list_(pa.int32())
            types = (pa.string(), ints, ints, ints, pa.list_(pa.bool_()), ints, ints)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["conv_id", *(x.split()[0] for x in OUTPUT.split(", "))])

    return in_batches(whole, run, f"conv_id {kind}, {OUTPUT}")


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def run(batches):
        for batch in small_batches(batches):
            out = [[] for _ in names]
            field = {name: batch.column(name) for name in batch.schema.names}
            marks = field["loss_mask"]
            for i in range(batch.num_rows):
                text = field["formatted"][i].as_py()
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(field["loss_starts"][i].as_py(), field["loss_ends"][i].as_py(), strict=True))
                sha = hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in turns).encode()).hexdigest()
                n_tokens, n_loss = len(field["token_ids"][i]), marks[i].values.true_count
                for c, v in zip(out, (field["conv_id"][i].as_py(), len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), n_tokens, n_loss), strict=True):
                    c.append(v)
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names)

    return in_batches(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    schema = rows.select("conv_id", "turn", "role", "text").schema
    return rows.select("conv_id", "turn", "role", "text").unionByName(rows.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], schema))
