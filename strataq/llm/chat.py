"""Chat formatting by token-level assembly.

Each turn is a row and becomes a row of segments: reserved ids that mark roles, and the ids of the
text, encoded by itself with a byte-level vocabulary, which any text survives. Reserved ids lie above the
vocabulary, so no text can yield one. The turn's ids are the segments spliced together; the loss mask is the
running sum of +1 where a trained segment begins and -1 where it ends. A conversation stays many rows, with
each turn's place in the token stream and in the written-out string as running sums over the turns before, so no
conversation is ever held whole by a task.

Written out, the reserved ids are strings. A text that contains such a string is escaped: a backslash is
put behind the first character of ``<s>``, ``[INST]`` and so on, and of their escaped forms with more
backslashes, so taking one away restores every text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm import bpe
from strataq.llm.common import arrow_map, by_key, small_batches

#: The control strings; their ids follow upon the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BOS, EOS, USER, USER_END, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROLS))
ESCAPE = re.compile("|".join(rf"(?:(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])}))" for c in CONTROLS))
UNESCAPE = re.compile("|".join(rf"(?:(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])}))" for c in CONTROLS))


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("", text)


def segments(role: str, text: str) -> list[int | tuple[str, bool]]:
    """A turn as control numbers and (escaped text, trained) pairs."""
    body = escape(text)
    if role == "user":
        return [BOS, USER, (body, False), USER_END]
    if role == "assistant":
        return [(body, True), EOS]
    if role == "system":
        return [SYS, (body, False), SYS_END]
    return [ROLE, (escape(role), False), ROLE_END, (body, False), EOS]


def assemble(parts: list, encode, first_id: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, loss mask, characters written out) of a turn's segments; ``encode`` gives packed u32 ids of a text."""
    ids = [struct.pack("<I", first_id + p) if isinstance(p, int) else encode(p[0]) for p in parts]
    ends = np.cumsum([len(x) // 4 for x in ids])
    step = np.zeros(ends[-1] + 1, np.int8)
    for p, hi, x in zip(parts, ends, ids):
        if not isinstance(p, int) and p[1]:
            step[hi - len(x) // 4] += 1
            step[hi] -= 1
    chars = sum(len(CONTROLS[p]) if isinstance(p, int) else len(p[0]) for p in parts)
    return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(step[:-1]).astype(bool), chars


def format_turns(turns: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """(conv_id, turn, seq, ids, loss_mask, chars, token_start, char_start) for each row of ``turns``.

    Turns of a conversation stand in the order of turn, nulls first; of one turn by a digest of role and text, which repeated rows
    share; seq numbers them from 0. A null text or role is empty, and told no otherwise than an empty one; a null conv_id is a conversation of its own; repeated rows are
    repeated turns; an empty table gives none; further columns are not read.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder = bpe.worker_encoder(tokenizer, "packed", True)
        encode = lambda t: b"".join(encoder(t))
        made = [assemble(segments(r or "", t or ""), encode, vocabulary) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        cols = [
            pa.array([x[0].astype(np.int32) for x in made], pa.list_(pa.int32())),
            pa.array([x[1] for x in made], pa.list_(pa.bool_())),
            pa.array([x[2] for x in made], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *cols], ["conv_id", "turn", "tie", "ids", "loss_mask", "chars"])

    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).withColumn("tie", F.sha2(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256))
    made = arrow_map(slim, run, "conv_id long, turn long, tie string, ids array<int>, loss_mask array<boolean>, chars long")
    order = W.partitionBy("conv_id").orderBy("turn", "tie")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return made.select(
        "conv_id", "turn", (F.row_number().over(order) - 1).alias("seq"), "ids", "loss_mask", "chars",
        F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0)).alias("token_start"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_start"),
    )


def read_back(formatted: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """Per conversation, from ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows pass in order and only running digests are kept, however long a conversation is.
    """

    def parse(ids: np.ndarray, mask: np.ndarray, decode) -> tuple[str, str, str, int]:
        cuts = np.flatnonzero(ids >= vocabulary)
        marks = (ids[cuts] - vocabulary).tolist()
        texts = [decode(x.tolist()) for x in np.split(ids, np.stack((cuts, cuts + 1), 1).ravel())[::2]]
        trained = decode(ids[mask].tolist())
        chars = sum(map(len, texts)) + sum(len(CONTROLS[m]) for m in marks)
        if marks[0] == ROLE:
            return unescape(texts[1]), unescape(texts[2]), unescape(trained), chars
        role, at = {BOS: ("user", 2), SYS: ("system", 1), EOS: ("assistant", 0)}[marks[0]]
        return role, unescape(texts[at]), unescape(trained), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer)
        decode = lambda ids: tok.decode(ids, skip_special_tokens=False) if ids else ""
        at, row = None, None

        def out(rows):
            cols = zip(*[(c, n, t.hexdigest(), lc, lh.hexdigest(), fc) for c, n, t, lc, lh, fc in rows])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], NAMES)

        for b in batches:
            done = []
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if row is None or conv != at:
                    if row is not None:
                        done.append(row)
                    at, row = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, trained, chars = parse(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False), decode)
                row[1] += 1
                row[2].update(f"{role}\n{text}\n".encode())
                row[3] += len(trained)
                row[4].update(trained.encode())
                row[5] += chars
            if done:
                yield out(done)
        if row is not None:
            yield out([row])

    small_batches(formatted.sparkSession)
    ordered = by_key(formatted.select("conv_id", "seq", "ids", "loss_mask"), "conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
