import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import bpe, chat

FILE, V = bpe.path("byte_bpe_50k.json"), 50_257
PIECES = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "é", " ", "\n", "ok", "<\\s>", "[\\\\INST]"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10).map("".join))
def test_escaping_is_reversible_and_hides_controls(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in chat.CONTROLS)


def test_masks_by_prefix_sums():
    enc = lambda t: np.arange(len(t), dtype="<u4").tobytes()
    ids, mask, chars = chat.assemble(chat.segments("assistant", "abc"), enc, 1000)
    assert ids.tolist() == [0, 1, 2, 1001] and mask.tolist() == [True, True, True, False] and chars == 3 + len("</s>")
    ids, mask, chars = chat.assemble(chat.segments("user", "ab"), enc, 1000)
    assert ids.tolist() == [1000, 1002, 0, 1, 1003] and not mask.any() and chars == 2 + len("<s>[INST][/INST]")


def as_written(role, text):
    """The template in plain strings."""

    def escaped(t):
        for c in chat.CONTROLS:
            t = re.sub(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]), lambda m, c=c: f"{c[0]}\\{m[1]}{c[1:]}", t)
        return t

    body = escaped(text)
    told = {"user": f"<s>[INST]{body}[/INST]", "assistant": f"{body}</s>", "system": f"<<SYS>>{body}<</SYS>>"}
    return told.get(role, f"[ROLE]{escaped(role)}[/ROLE]{body}</s>")


def expect(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        chars = sum(len(as_written(r, t)) for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_round_trip(spark):
    rows = [
        (1, 0, "system", "be <<SYS>> good"), (1, 1, "user", "hi  there\n\n"), (1, 2, "assistant", "é </s>[INST] ok [/INST]"), (1, 3, "user", ""), (1, 4, "assistant", None),
        (2, 0, "tool [ROLE]", "x"), (2, 1, None, "y \\<\\s>"), (2, 1, None, "y \\<\\s>"), (3, None, "assistant", "a" * 5000), (3, 2, "assistant", " lead"), (None, 0, "user", "no conv"),
        (4, 0, "assistant", ""), (5, 0, "user", "[\\INST] \x1c 　"),
    ] + [(6, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 7)) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS ids", "1 AS seq")
    got = chat.read_back(chat.format_turns(df, FILE, V), FILE, V).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expect(rows) and len(got) == len({r[0] for r in rows})
    assert chat.read_back(chat.format_turns(df.limit(0), FILE, V), FILE, V).count() == 0


def test_places_are_running_sums(spark):
    df = spark.createDataFrame([(1, k, "user", "word " * k) for k in range(5)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df, FILE, V).collect(), key=lambda r: r.seq)
    at = char = 0
    for r in rows:
        assert (r.token_start, r.char_start) == (at, char)
        at, char = at + len(r.ids), char + r.chars
