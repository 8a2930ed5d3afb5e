r"""Chat transcripts by columnar byte assembly.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``.  Texts are escaped so that ``<|`` never occurs in
them: a ``<`` with any number of backslashes before a ``|`` gets one more.  Roles escape
backslash, newline and ``|`` with a backslash.  Both can be undone exactly.

Rows are dealt by conversation and sorted, then every Arrow batch is assembled at once: the lengths
of headers and contents give cumulative offsets, and each kind of segment is scattered into one
preallocated buffer.  The conversations of the batch are slices of that buffer.  A conversation that
goes on in the next batch continues as another ``part``, so no conversation is held as a whole; its
turns must meet in one task in order because its digests run over all of them.

The loss mask is a list of byte spans per row: the texts of the turns whose role is ``assistant``.

Null texts and roles are empty.  Turns with equal numbers are ordered by role, then text; a null
turn comes first; rows without conv_id are one conversation.  Repeated rows are turns of their own.
An empty table gives no rows.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

START, END, LEARNED = b"<|im_start|>", b"<|im_end|>\n", "assistant"

FORMATTED = (
    "conv_id bigint, part int, n_turns bigint, formatted binary, "
    "mask_start array<bigint>, mask_length array<bigint>"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)
_ROWS_OUT = 4096


def escape_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape_text(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text)


def escape_roles(roles: pa.Array) -> pa.Array:
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("|", "\\|")):
        roles = pc.replace_substring(roles, plain, escaped)
    return roles


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role, flags=re.DOTALL)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data of a string column: its bytes, and where each value starts and how long it is."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns in one buffer: bytes, the turns' ends, and where each text starts and how long it is."""
    role_data, role_from, role_len = _bytes_of(escape_roles(roles))
    text_data, text_from, text_len = _bytes_of(escape_texts(texts))
    ends = np.cumsum(len(START) + role_len + 1 + text_len + len(END))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    role_to = begins + len(START)
    text_to = role_to + role_len + 1

    def scatter(data, at_from, at_to, lengths):
        total = int(lengths.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(at_to, lengths) + inside] = data[np.repeat(at_from, lengths) + inside]

    def stamp(mark: bytes, at_to):
        out[at_to[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)

    stamp(START, begins)
    scatter(role_data, role_from, role_to, role_len)
    stamp(b"\n", role_to + role_len)
    scatter(text_data, text_from, text_to, text_len)
    stamp(END, text_to + text_len)
    return out, ends, text_to, text_len


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, _, role, text = batch.columns
        role, text = role.fill_null(""), text.fill_null("")
        out, ends, text_at, text_len = assemble(role, text)
        keys = conv.fill_null(0).to_numpy()
        nulls = conv.is_null().to_numpy(zero_copy_only=False)
        change = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        until = np.append(first[1:], batch.num_rows)
        byte_from = np.concatenate([[0], ends])[first]
        learned = pc.equal(role, LEARNED).to_numpy(zero_copy_only=False)
        learned_before = np.concatenate([[0], np.cumsum(learned)])
        cuts = pa.array(np.append(learned_before[first], learned_before[-1]).astype(np.int32))
        owner = np.repeat(np.arange(len(first)), until - first)
        starts = (text_at - byte_from[owner])[learned]
        ids = conv.take(pa.array(first)).to_pylist()
        parts = [0] * len(first)
        parts[0] = part + 1 if ids[0] == last else 0
        last, part = ids[-1], parts[-1]
        offsets = pa.py_buffer(np.append(byte_from, len(out)).astype(np.int32))
        formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(out)])
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array(parts, pa.int32()),
                pa.array(until - first),
                formatted,
                pa.ListArray.from_arrays(cuts, pa.array(starts)),
                pa.ListArray.from_arrays(cuts, pa.array(text_len[learned])),
            ],
            [c.split()[0] for c in FORMATTED.split(", ")],
        )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, and the mask's spans in bytes of ``formatted``."""
    turns = rows.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role"), F.col("text")
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, FORMATTED)


def parse_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn, unescaped."""
    found = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition(b"\n")
        if not text.endswith(END):
            raise ValueError("a turn has no end mark")
        found.append((unescape_role(role), unescape_text(text[: -len(END)])))
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    key, state = object(), None

    def close():
        n, turns, chars, loss, size = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def flush():
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        batch = pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
        done.clear()
        return batch

    for batch in batches:
        for conv, _, _, formatted, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != key:
                if state is not None:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse_turns(formatted):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for at, length in zip(starts, lengths, strict=True):
                text = unescape_text(formatted[at : at + length])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted.decode())
        if len(done) >= _ROWS_OUT:
            yield flush()
    if state is not None:
        close()
    yield flush()


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts say: turns, masked text, length."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.mapInArrow(_digest, DIGESTS)
