"""Conversation structure repair by a weighted automaton that is determinised as it is used.

Roles of a conversation should read: perhaps a system turn, then user and assistant in turn, ending with the assistant. The cheapest
edits that make them so are paths of a small weighted automaton: its states say what has been written (nothing, system, user,
assistant), an arc reads a turn (keep, rerole, delete) or writes an empty one (insert). A turn is one of nine symbols: how its role
begins and whether it must go or is truncated.

For a rest of a conversation the vector of the least cost from each state to the end decides all that comes before it. Such vectors,
less their smallest component, are the states of the determinised automaton; there are few, as no two components differ by more than a few
edits. They are found when first met and kept in a transition table, so a scan from the last turn to the first is one look-up a turn and
gives the cost. The trace then runs back over the scan, from the first turn to the last, along tight arcs (cost of the arc plus cost
beyond it is the cost here), the least initial first; these choices are cached as well.

Turns are dealt by ranges of (conversation, turn, role, text), so a conversation of any length is spread over tasks. One that lies within
a task's range and a slice is repaired there. Of the others each slice is reduced to what it does to every state, these are composed
by conversation, and the slices are then traced side by side from the states where they begin and end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import by_key, cut, join_by_share, small_batches

INSERT = REROLE = TRUNCATED = 3
DELETE = 4
#: States: nothing written yet, a system turn, a user turn, an assistant turn; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What may be written next from each state, by initial.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: Symbols: an initial's place plus 4 if the turn is truncated, or GONE for a turn that must go.
GONE = 8
#: Turns and characters of a slice at most, but for a single longer turn.
SLICE_TURNS, SLICE_CHARS = 4096, 1 << 22

WORD_CHAR = re.compile(r"[^\x20\x09-\x0D]")
LAST_CHAR = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")

Vector = tuple[int, ...]


def written(state: int) -> int | None:
    """The state after an insert or rerole: only user and assistant turns are made, so there is one at most."""
    return next((to for to in NEXT[state].values() if to in ROLES), None)


class Determinised:
    """The automaton's cost-to-go vectors as states, found when first met."""

    def __init__(self) -> None:
        self.numbers: dict[Vector, int] = {}
        self.vectors: list[Vector] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int, tuple[int, ...]]] = {}
        #: The state behind the last turn.
        self.end = self.number(self.inserted([0 if q in ENDS else 99 for q in range(4)]))[0]

    @staticmethod
    def inserted(costs: list[int]) -> list[int]:
        for _ in range(3):  # no cheapest path inserts more than two turns running
            costs = [min(c, INSERT + costs[written(q)]) for q, c in enumerate(costs)]
        return costs

    def number(self, costs: list[int]) -> tuple[int, int]:
        """(state, its least cost) of a vector."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (GONE + 1))
        return self.numbers[vector], least

    @staticmethod
    def arcs(state: int, symbol: int) -> list[tuple[str, int, int]]:
        """(initial, cost, state after it) of the edits that read ``symbol``, in order of initials."""
        out = [("D", DELETE, state)]
        if symbol != GONE:
            more = TRUNCATED if symbol & 4 else 0
            kept = NEXT[state].get(INITIALS[symbol & 3] if symbol & 3 < 3 else "")
            out += [("K", more, kept)] * (kept is not None) + [("R", REROLE + more, written(state))]
        return out

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(state, added cost) before a turn of ``symbol``, out of the state behind it."""
        known = self.table[state][symbol]
        if known is None:
            beyond = self.vectors[state]
            costs = [min(c + beyond[to] for _, c, to in self.arcs(q, symbol)) for q in range(4)]
            known = self.table[state][symbol] = self.number(self.inserted(costs))
        return known

    def scan(self, symbols: list[int], state: int) -> tuple[list[int], int]:
        """States before each turn, from the first, and ``state`` last; and the cost added on the way."""
        states, cost, table = [state], 0, self.table
        for s in reversed(symbols):
            state, c = table[state][s] or self.step(state, s)
            states.append(state)
            cost += c
        return states[::-1], cost

    def move(self, state: int, symbol: int, at: int) -> tuple[str, int, tuple[int, ...]]:
        """The tight arcs from ``at`` over a turn of ``symbol``, ``state`` being the one behind it: (initials, state after them, states after inserts)."""
        known = self.moves.get((state, symbol, at))
        if known is None:
            before, least = self.step(state, symbol)
            cost = lambda q: self.vectors[before][q] + least
            initials, q, made = "", at, ()
            while not initials or initials[-1] == "I":
                tight = [(i, to) for i, c, to in self.arcs(q, symbol) if cost(q) == c + self.vectors[state][to]]
                tight += [("I", written(q))] * (cost(q) == INSERT + cost(written(q)))
                i, q = min(tight)
                initials, made = initials + i, made + (q,) * (i == "I")
            known = self.moves[state, symbol, at] = (initials, q, made)
        return known

    def closing(self, at: int) -> tuple[int, ...]:
        """The states after the inserts behind the last turn."""
        made = ()
        while self.vectors[self.end][at]:
            at = written(at)
            made += (at,)
        return made

    def closure(self) -> int:
        """Finds all states, in an order that is the same everywhere; gives their number."""
        k = 0
        while k < len(self.vectors):
            for s in range(GONE + 1):
                self.step(k, s)
            k += 1
        return k


def symbol_of(role: str, text: str, first: bool) -> tuple[int, int]:
    """(symbol, fault) of a turn; fault 0: none, 1: blank, 2: duplicate, 3: truncated."""
    last = LAST_CHAR.search(text)
    if last is None:
        return GONE, 1
    if not first:
        return GONE, 2
    initial = INITIALS.find(role[0]) if role else -1
    whole = last[0] in ".!?"
    return (initial if initial >= 0 else 3) + (0 if whole else 4), 0 if whole else 3


class Slice:
    """Successive turns of one conversation: each distinct (turn, role, text) with its number of copies, and whether its text is new."""

    def __init__(self) -> None:
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.copies: list[int] = []
        self.first: list[bool] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.first.append(first)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.turns) >= SLICE_TURNS or self.chars >= SLICE_CHARS

    def read(self) -> tuple[list[int], list[int], dict]:
        """Symbols of the turns, how often each stands, and the slice's counts; what has no copies is left out."""
        symbols, times, kept = [], [], []
        counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        initials = []
        for k, (role, text, n, first) in enumerate(zip(self.roles, self.texts, self.copies, self.first)):
            if not n:
                continue
            symbol, fault = symbol_of(role, text, first)
            counts["blank"] += n * (fault == 1)
            counts["duplicate"] += n * (fault == 2) + (n - 1) * (fault in (0, 3))
            counts["truncated"] += fault == 3
            counts["illegal"] += n - 1
            initials.append(role[:1])
            kept.append(k)
            symbols.append(symbol)
            times.append(n)
        counts["illegal"] += sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [self.turns[k] for k in kept if self.turns[k] is not None]
        counts |= {
            "n_turns": sum(times), "least": known[0] if known else None, "most": known[-1] if known else None, "n_known": len(set(known)),
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
        }
        self.kept = kept
        return symbols, times, counts

    @staticmethod
    def spelled(symbols: list[int], times: list[int]) -> list[int]:
        """Every copy's symbol: behind the first, copies must go."""
        return symbols if max(times, default=1) == 1 else [x for s, n in zip(symbols, times) for x in (s, *[GONE] * (n - 1))]

    def trace(self, auto: Determinised, symbols: list[int], times: list[int], states: list[int], at: int, last: bool) -> tuple[str, list[str], list[str]]:
        """(audit, roles, texts) of the slice from state ``at`` on; the inserts at a conversation's end with the ``last`` one."""
        audit, roles, texts = [], [], []
        i = 0

        def write(made: tuple[int, ...]) -> None:
            roles.extend(ROLES[m] for m in made)
            texts.extend("" for _ in made)

        for k, s, n in zip(self.kept, symbols, times):
            initials, at, made = auto.move(states[i + 1], s, at)
            i += n
            audit.append(initials + "D" * (n - 1))
            write(made)
            if initials[-1] != "D":
                roles.append(self.roles[k] if initials[-1] == "K" else ROLES[at])
                texts.append(self.texts[k])
        if last:
            made = auto.closing(at)
            audit.append("I" * len(made))
            write(made)
        return "".join(audit), roles, texts


def passed(auto: Determinised, spelled: list[int], states: list[int], at: int) -> int:
    """The state after a slice that is begun in ``at``."""
    for k, s in enumerate(spelled):
        at = auto.move(states[k + 1], s, at)[1]
    return at


COUNTS = "n_turns long, blank long, duplicate long, truncated long, illegal long, least long, most long, n_known long, first_initial string, last_initial string"
PIECE = f"conv_id long, slice long, whole boolean, cost long, audit string, roles array<string>, texts array<string>, {COUNTS}"
CUT = "turns array<long>, cut_roles array<string>, cut_texts array<string>, copies array<long>, first array<boolean>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_schema(ddl))


def prepared(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, first): equal rows as one with their number, and whether role and text are new in the conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), copies.cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))
    rows = rows.withColumn("same", same)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("of"))
    keys = rows.groupBy("same").agg(F.count("*").alias("n"), F.min(F.when(F.col("copies") > 0, place)).alias("place"))
    marked = join_by_share(rows, keys, ["same"], "n")
    first = F.coalesce((F.col("place.known") == F.col("turn").isNotNull()) & F.col("place.of").eqNullSafe(F.col("turn")), F.lit(False))
    return marked.select("conv_id", "turn", "role", "text", "copies", first.alias("first"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to conversations repaired whole, and slices of those that a task's edges or their length cut."""
    auto, part = Determinised(), TaskContext.get().partitionId() << 32
    conv, piece, edge, made, out, chars = None, None, True, 0, [], 0

    def put(cut_off: bool) -> None:
        nonlocal made, chars
        row = {"conv_id": conv, "slice": part + made, "whole": not cut_off}
        made += 1
        chars += piece.chars
        if cut_off:
            row |= {"turns": piece.turns, "cut_roles": piece.roles, "cut_texts": piece.texts, "copies": piece.copies, "first": piece.first}
        else:
            symbols, times, counts = piece.read()
            states, cost = auto.scan(piece.spelled(symbols, times), auto.end)
            audit, roles, texts = piece.trace(auto, symbols, times, states, START, True)
            row |= counts | {"cost": cost + auto.vectors[states[0]][START], "audit": audit, "roles": roles, "texts": texts}
        out.append(row)

    for b in batches:
        for c, turn, role, text, copies, first in zip(*(x.to_pylist() for x in b.columns)):
            if piece is None or c != conv:
                if piece is not None:
                    put(edge)
                    edge = False  # what begins later begins within this task
                conv, piece = c, Slice()
            elif piece.full():
                put(True)
                edge, piece = True, Slice()
            piece.add(turn, role, text, copies, first)
            if len(out) >= 1024 or chars >= SLICE_CHARS:
                yield _batch(out, f"{PIECE}, {CUT}")
                out, chars = [], 0
    if piece is not None:
        put(True)
    if out:
        yield _batch(out, f"{PIECE}, {CUT}")


def _cut(columns: dict[str, list], k: int) -> Slice:
    s = Slice()
    s.turns, s.roles, s.texts, s.copies, s.first = (columns[c][k] for c in ("turns", "cut_roles", "cut_texts", "copies", "first"))
    return s


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a slice does: by state behind it the state before it and the cost, and by that and the state it begins in the one it ends in."""
    auto = Determinised()
    n = auto.closure()
    for b in batches:
        columns, rows = b.to_pydict(), []
        for k in range(b.num_rows):
            piece = _cut(columns, k)
            spelled = piece.spelled(*piece.read()[:2])
            scans = [auto.scan(spelled, s) for s in range(n)]
            ends = [passed(auto, spelled, states, at) for states, _ in scans for at in range(4)]
            rows.append({"conv_id": columns["conv_id"][k], "slice": columns["slice"][k], "before": [s[0][0] for s in scans], "added": [s[1] for s in scans], "ends": ends})
        yield _batch(rows, "conv_id long, slice long, before array<long>, added array<long>, ends array<long>")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a conversation in order, reduced, to the states each has behind it and begins in. One conversation's are held at a time."""
    auto = Determinised()
    auto.closure()

    def done(held: list[tuple]) -> pa.RecordBatch:
        state, cost, behind, at, rows = auto.end, 0, [], START, []
        for _, before, added, _ in reversed(held):
            behind.append(state)
            state, cost = before[state], cost + added[state]
        cost += auto.vectors[state][START]
        for k, ((number, _, _, ends), s) in enumerate(zip(held, reversed(behind))):
            rows.append({"slice": number, "behind": s, "at": at, "last": k == len(held) - 1, "cost": cost if k == 0 else 0})
            at = ends[4 * s + at]
        return _batch(rows, "slice long, behind long, at long, last boolean, cost long")

    conv, held = None, []
    for b in batches:
        for c, *row in zip(*(x.to_pylist() for x in b.columns)):
            if held and c != conv:
                yield done(held)
                held = []
            conv = c
            held.append(row)
    if held:
        yield done(held)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = Determinised()
    auto.closure()
    for b in batches:
        columns, rows = b.to_pydict(), []
        for k in range(b.num_rows):
            piece = _cut(columns, k)
            symbols, times, counts = piece.read()
            states, _ = auto.scan(piece.spelled(symbols, times), columns["behind"][k])
            audit, roles, texts = piece.trace(auto, symbols, times, states, columns["at"][k], columns["last"][k])
            rows.append(counts | {"conv_id": columns["conv_id"][k], "slice": columns["slice"][k], "whole": False, "cost": columns["cost"][k], "audit": audit, "roles": roles, "texts": texts})
        yield _batch(rows, PIECE)


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations as rows (conv_id, slice, whole, cost, audit, roles, texts, counts), in order of slice within a conversation.

    ``turns`` has conv_id, turn, role, text and perhaps copies, how often a row stands (0: the conversation is there, the row isn't). Nearly
    all conversations are one row (``whole``); one that is cut has a row a slice, and its cost stands with the first of them.

    Turns stand by turn, nulls first, then role, then text. A null text or role is one space; an empty one stays so, and a role without
    an initial s, u or a can't be kept. A null conv_id is a conversation of its own, equal rows are repeated turns, further columns are
    not read, and an empty table gives none. A text of any length is one turn.
    """
    spark = turns.sparkSession
    small_batches(spark)
    # A prefix of the text orders as the text does, and keeps the sample small from which Spark takes its ranges.
    ranged = prepared(turns).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64))
    ordered = ranged.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    made = cut(ordered.mapInArrow(_slices, f"{PIECE}, {CUT}"))
    pieces = made.where("not whole").select("conv_id", "slice", *[c.split()[0] for c in CUT.split(", ")])
    reduced = pieces.mapInArrow(_reduced, "conv_id long, slice long, before array<long>, added array<long>, ends array<long>")
    places = by_key(reduced, "conv_id").sortWithinPartitions("conv_id", "slice").mapInArrow(_composed, "slice long, behind long, at long, last boolean, cost long")
    traced = pieces.join(places, "slice").mapInArrow(_traced, PIECE)
    return made.where("whole").select(*[c.split()[0] for c in PIECE.split(", ")]).unionByName(traced)


DIGEST = "conv_id long, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a conversation in order to its row; digests run on, so no conversation's texts are held."""
    row, sha, audit = None, None, []

    def done() -> pa.RecordBatch:
        known = row.pop("n_known")
        row["gaps"] = row.pop("most") - row.pop("least") + 1 - known if known else 0
        return _batch([{c.split()[0]: row.get(c.split()[0]) for c in DIGEST.split(", ")} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], DIGEST)

    for b in batches:
        for p in b.to_pylist():
            if row is None or p["conv_id"] != row["conv_id"]:
                if row is not None:
                    yield done()
                row, sha, audit, any_yet = {"conv_id": p["conv_id"], "least": None, "most": None, "n_known": 0, "last": None, "cost": 0}, hashlib.sha256(), [], False
                row |= dict.fromkeys(("n_turns", "blank", "duplicate", "truncated", "illegal"), 0)
            for c in ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost"):
                row[c] += p[c]
            if p["first_initial"] is not None:
                row["illegal"] += row["last"] is not None and row["last"] + p["first_initial"] not in ("su", "ua", "au")
                row["last"] = p["last_initial"]
            if p["n_known"]:
                row["n_known"] += p["n_known"] - (row["most"] == p["least"])
                row["least"], row["most"] = p["least"] if row["least"] is None else row["least"], p["most"]
            audit.append(p["audit"])
            for role, text in zip(p["roles"], p["texts"]):
                sha.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                any_yet = True
    if row is not None:
        yield done()


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, cost, audit and the digest of the repaired turns.

    A digest runs over a conversation from its first turn to its last, so that of one that is cut is one task's work; it streams the slices and
    holds one at a time, and the audit, which is one value of the result.
    """
    whole = repaired.where("whole")
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n_known"), F.lit(0))
    rows = whole.select("conv_id", "n_turns", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(told, 256).alias("repaired_sha256"))
    parts = by_key(repaired.where("not whole"), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "slice")
    return rows.unionByName(parts.mapInArrow(_joined, DIGEST))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with a fifth of its rows spoilt by crc32(conv_id:turn) % 20: dropped, emptied, without its full stops, repeated, or made the user's.

    Nulls are one space, in the digest too, but a null turn stays null. A dropped row stands with no copies, so that its conversation is not forgotten.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(spaced("role"))
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", F.when(kind != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
