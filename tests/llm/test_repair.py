import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from strataq.llm import repair

RULE = re.compile(r"(s?(ua)+)?")
COLUMNS = ["n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spoilt(rows):
    """The damage of the contract, in plain Python; also the ids of all conversations."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text, mine = " " if role is None else role, " " if text is None else text, out[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """(cost, audit, repaired) by trying all edits at every turn, with what is written so far as a string of initials."""
    n = len(turns)
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(k, so_far, inserts):
        # only the end of what is written matters, and whether anything is
        options = []
        if k == n and RULE.fullmatch(so_far):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if legal(so_far + role[0]):
                    c, a, r = best(k, short(so_far + role[0]), inserts + 1)
                    options.append((c + 3, "I" + a, ((role, ""), *r)))
        if k < n:
            _, role, text = turns[k]
            c, a, r = best(k + 1, so_far, 0)
            options.append((c + 4, "D" + a, r))
            if found[k] in ("", "truncated"):
                more = 3 if found[k] else 0
                if role and legal(so_far + role[0]):
                    c, a, r = best(k + 1, short(so_far + role[0]), 0)
                    options.append((c + more, "K" + a, ((role, text), *r)))
                for to in ("user", "assistant"):
                    if legal(so_far + to[0]):
                        c, a, r = best(k + 1, short(so_far + to[0]), 0)
                        options.append((c + 3 + more, "R" + a, ((to, text), *r)))
        return min(options, default=(10**9, "", ()))

    def legal(s):
        return any(RULE.fullmatch(s + t) for t in ("", "a", "ua"))

    def short(s):
        return s if len(s) < 5 else s[-4:] if s[-1] == "a" else s[-3:]

    return best(0, "", 0)


def expect(rows, damage=True):
    convs = spoilt(rows) if damage else defaultdict(list)
    if not damage:
        for conv, turn, role, text in rows:
            convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        found = faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        n = Counter(found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, made = cheapest(tuple(turns), tuple(found))
        told = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (len(turns), gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS audit", "1 AS first", "2 AS slice")
    got = repair.digest(repair.repair(repair.damaged(df) if damage else df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def made_up(n, seed, turns=9):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unicorn"]
    texts = ["Hi.", "Hi.", "So be it!", "cut off", "Why? ", " \n", "", None, "a ", "é!\t\n", "two\nlines?", *[f"text {k}." for k in range(9)]]
    return [
        (c, r.choice([None, *range(t, t + 2)]) if r.random() < 0.2 else t, r.choice(roles), r.choice(texts)) for c in range(n) for t in range(r.randrange(turns))
    ]


@pytest.mark.parametrize("damage", [True, False])
def test_all_edits_tried(spark, damage):
    rows = [*made_up(300, 1), (None, None, None, None), (None, 3, "user", "x."), (7000, 0, "system", "only."), (7001, 5, "assistant", "y" * 200_000)]
    rows += rows[-2:]
    assert repaired(spark, rows, damage) == expect(rows, damage)


def test_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repaired(spark, [(conv, 0, "user", "gone.")])
    assert got == {conv: (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.digest(repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_cut_conversations_are_pieced_together(spark, monkeypatch):
    rows = made_up(40, 2, 60) + [(99, t, ("user", "assistant", "tool")[t % 3], f"{t % 50} says{'.' * (t % 2)}") for t in range(500)]
    rows += [(98, 1, "user", "the same.")] * 300 + [(98, t, "assistant", "the same.") for t in range(300)]
    want = {k: v for k, v in expect(rows).items()}
    assert repaired(spark, rows) == want
    whole = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(1))
    assert whole.where("not whole").count() > 1


def test_slices_of_any_size_agree(spark):
    rows = made_up(60, 3, 40)
    want = expect(rows)
    source = repair._slices

    def small(batches):
        at, repair.SLICE_TURNS = repair.SLICE_TURNS, 3
        yield from source(batches)
        repair.SLICE_TURNS = at

    before, repair._slices = repair._slices, small
    try:
        assert repaired(spark, rows) == want
    finally:
        repair._slices = before


def test_the_automaton_is_small():
    auto = repair.Determinised()
    assert auto.closure() < 60
    assert all(max(v) <= 10 for v in auto.vectors)
