"""Cheapest repair of conversations to the form "system, then user and assistant in turns".

A conversation is a row of symbols: what the first letter of a row's role is, and its first fault. Keeping a row,
giving it another role, deleting it, and inserting an empty row have costs, and the roles that remain must read
`(s?(ua)+)?`. For each of the four places in that form (at the start, after a system row, after a user row, after an
assistant row) a cost vector holds the least cost of what is still to come. A symbol turns the vector behind it
into the one before it. Up to a common amount there are few vectors, so the step of every block of `BLOCK` symbols
for every vector is worked out once (Four-Russians tables: next vector, amount, and the place that each place leads to).
A conversation is read from its end, block by block, by look-up. Then each block is opened backward from the vector
behind it, and the letters of the edits are read off from the front: the least letter that keeps the cost least, so
that of equally cheap repairs the one with the least audit is taken.

Rows are ordered by a range sort of the whole table over conversation, turn, role, text, so a conversation of any size
is spread over as many tasks as its rows need. Sorted rows are packed in pieces of bounded size. A piece that is a
whole conversation is repaired by itself. Conversations cut by a task or piece boundary are put together from what
their pieces do to each vector and place (a few hundred numbers a piece), then each piece is repaired on its own. Only
the checksum over a whole repaired conversation reads it through one task, as a stream.

Rules for odd rows: nulls of role and text count as one space; rows without a conversation id are one conversation;
rows without a turn come first; rows with the same turn are taken by role and text; empty texts are blank;
repeated rows are duplicates, however many; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import checked_broadcast

# costs
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
# places: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = 4
LETTERS = "sua-"
# symbols: letter of the role, twice (whole, cut off), and a row that has to go
GONE = 2 * len(LETTERS)
SYMBOLS = GONE + 1
BLOCK = 4
# A piece ends at so many rows or bytes.
PIECE_ROWS = 16_384
PIECE_BYTES = 8 << 20

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"

PIECE = (
    "conv_id {id}, part int, number int, whole boolean, turns array<bigint>, faults array<tinyint>, "
    "roles array<string>, texts array<string>"
)
REPORT = "turn_min bigint, turn_max bigint, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


# --- tables -----------------------------------------------------------------


def _inserted(place: int) -> int:
    """Where an inserted row leads."""
    return ASSISTANT if place == USER else USER


def _kept(place: int, letter: str) -> int | None:
    """Where a kept row leads; None if its role does not fit."""
    if letter == "s":
        return SYSTEM if place == START else None
    if letter == "u":
        return None if place == USER else USER
    return ASSISTANT if letter == "a" and place == USER else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Least costs when rows may be inserted first; two in a row are enough, as a third leads nowhere new."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_inserted(p)]) for p, c in enumerate(costs)]
    return tuple(costs)


def _options(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next place) of the edits of a row."""
    edits = [("D", DELETE, place)]
    if symbol != GONE:
        extra = CUT_OFF if symbol >= len(LETTERS) else 0
        kept = _kept(place, LETTERS[symbol % len(LETTERS)])
        if kept is not None:
            edits.append(("K", extra, kept))
        edits.append(("R", REROLE + extra, _inserted(place)))
    return edits


class Tables:
    """Steps of all symbols and of all blocks of symbols, for every vector that can occur."""

    def __init__(self, block: int = BLOCK):
        end = _with_inserts([0, 10 ** 6, 10 ** 6, 0])
        self.vectors = [self._plain(end)[0]]
        self.end = 0
        known, step, amount = {self.vectors[0]: 0}, [], []
        at = 0
        while at < len(self.vectors):
            steps, amounts = [], []
            for symbol in range(SYMBOLS):
                vector, least = self._plain(self._before(symbol, self.vectors[at]))
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                steps.append(known[vector])
                amounts.append(least)
            step.append(steps)
            amount.append(amounts)
            at += 1
        self.size = len(self.vectors)
        # one symbol: [vector behind, symbol]
        self.steps, self.step, self.amount = step, np.array(step, np.int16), np.array(amount, np.int64)
        edits = [[[self._edits(s, v, p) for p in range(PLACES)] for s in range(SYMBOLS)] for v in range(self.size)]
        self.edits = [[[e[0] for e in row] for row in rows] for rows in edits]
        self.leads = [[[e[1] for e in row] for row in rows] for rows in edits]
        self.closing = [self._closing(p) for p in range(PLACES)]

        # a block: [block, vector behind], the first symbol of a block counts most
        lead = np.array(self.leads, np.int8)
        blocks = np.array(list(product(range(SYMBOLS), repeat=block)), np.int64)
        vector = np.tile(np.arange(self.size), (len(blocks), 1))
        total = np.zeros_like(vector)
        place = np.tile(np.arange(PLACES, dtype=np.int8), (len(blocks), self.size, 1))
        for k in range(block - 1, -1, -1):
            symbol = blocks[:, k, None]
            # the places before the symbol lead to places behind it, and those on as known
            place = np.take_along_axis(place, lead[vector, symbol].astype(np.int64), axis=2)
            total = total + self.amount[vector, symbol]
            vector = self.step[vector, symbol].astype(np.int64)
        self.block = block
        self.block_step, self.block_amount, self.block_place = vector.astype(np.int16), total, place
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)

    @staticmethod
    def _plain(costs) -> tuple[tuple[int, ...], int]:
        least = min(costs)
        return tuple(c - least for c in costs), least

    @staticmethod
    def _before(symbol: int, behind) -> tuple[int, ...]:
        return _with_inserts([min(cost + behind[to] for _, cost, to in _options(symbol, p)) for p in range(PLACES)])

    def _edits(self, symbol: int, vector: int, place: int) -> tuple[str, int]:
        """Letters up to the edit of the row, and where they lead: at each step the least letter of least cost."""
        behind = self.vectors[vector]
        before = self._before(symbol, behind)
        letters = ""
        while True:
            options = [(letter, to) for letter, cost, to in _options(symbol, place) if cost + behind[to] == before[place]]
            if INSERT + before[_inserted(place)] == before[place]:
                options.append(("I", _inserted(place)))
            letter, to = min(options)
            letters, place = letters + letter, to
            if letter != "I":
                return letters, place

    @staticmethod
    def _closing(place: int) -> str:
        """Rows inserted at the end."""
        return {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[place]

    def vectors_behind(self, symbols: np.ndarray, vector: int) -> tuple[list[tuple[int, int]], int, int]:
        """(first symbol, vector behind it) of every block from the end, the vector before all, and the cost so far."""
        n = len(symbols)
        head = n % self.block
        codes = (symbols[head:].reshape(-1, self.block) @ self.weights).tolist()
        total, behind = 0, []
        for k in range(len(codes) - 1, -1, -1):
            behind.append((head + k * self.block, vector))
            total += int(self.block_amount[codes[k], vector])
            vector = int(self.block_step[codes[k], vector])
        if head:
            behind.append((0, vector))
            for k in range(head - 1, -1, -1):
                total += int(self.amount[vector, symbols[k]])
                vector = int(self.step[vector, symbols[k]])
        return behind, vector, total

    def trace(self, symbols: np.ndarray, vector: int, place: int) -> tuple[list[str], int, int]:
        """Letters up to and with each symbol, the place behind them, and the cost; `vector` is what follows."""
        behind, before, total = self.vectors_behind(symbols, vector)
        total += self.vectors[before][place]
        plain, n = symbols.tolist(), len(symbols)
        ends = [start for start, _ in behind[-2::-1]] + [n]
        letters = []
        for (start, vector), end in zip(behind[::-1], ends):
            opened = [vector]  # the block from its end
            for k in range(end - 1, start, -1):
                opened.append(self.steps[opened[-1]][plain[k]])
            for k, v in zip(range(start, end), opened[::-1]):
                letters.append(self.edits[v][plain[k]][place])
                place = self.leads[v][plain[k]][place]
        return letters, place, total

    def effect(self, symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """For every vector that may follow: the vector before the symbols, the amount, and where each place leads."""
        n = len(symbols)
        head = n % self.block
        codes = (symbols[head:].reshape(-1, self.block) @ self.weights).tolist()
        vector, total = np.arange(self.size), np.zeros(self.size, np.int64)
        place = np.tile(np.arange(PLACES), (self.size, 1))
        for code in reversed(codes):
            place = np.take_along_axis(place, self.block_place[code][vector].astype(np.int64), axis=1)
            total = total + self.block_amount[code][vector]
            vector = self.block_step[code][vector].astype(np.int64)
        lead = np.array(self.leads)
        for k in range(head - 1, -1, -1):
            place = np.take_along_axis(place, lead[vector, symbols[k]], axis=1)
            total = total + self.amount[vector, symbols[k]]
            vector = self.step[vector, symbols[k]].astype(np.int64)
        return vector.tolist(), total.tolist(), place.ravel().tolist()


@cache
def tables() -> Tables:
    return Tables()


# --- rows -------------------------------------------------------------------


def judged_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row, fault, dropped) of `rows` (conv_id, turn, role, text, dropped boolean).

    The duplicates of a role and text are all its rows but the first. What is shuffled for them is one narrow row
    for each text (equal texts are counted before), and the few that occur more than once are joined back. Dropped rows
    stay, without a fault, so that their conversation is known.
    """
    there = ~F.col("dropped")
    numbered = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.when(there, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"), "dropped",
    ).withColumn("row", F.monotonically_increasing_id())  # of scanned files: the same numbers whenever it is computed
    id_text = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    numbered = numbered.withColumn(
        "key", F.md5(F.concat(F.md5(id_text), F.col("conv_id").isNull().cast("string"), F.md5("role"), F.md5("text")))
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    first = numbered.filter(there).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    repeated = cut_lineage(first.filter("n > 1").select("key", F.col("first.row").alias("first_row")))
    found = numbered.join(checked_broadcast(repeated), "key", "left")
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(~there, 0).when(trimmed == "", BLANK).when(F.col("first_row") != F.col("row"), DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    return found.select("conv_id", "turn", "role", "text", "row", fault.cast("tinyint").alias("fault"), "dropped")


def symbols_of(roles: list[str], faults: np.ndarray) -> np.ndarray:
    letters = np.fromiter((LETTERS.find(r[:1]) if r[:1] in ("s", "u", "a") else 3 for r in roles), np.int64, len(roles))
    out = letters + np.where(faults == TRUNCATED, len(LETTERS), 0)
    return np.where((faults == BLANK) | (faults == DUPLICATE), GONE, out)


def packed(judged: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of the sorted conversations, as a written table; dropped rows leave no more than their conversation."""
    # the number of the row parts equal rows, and its first one comes first
    order = ["conv_id", "turn", "role", "text", "row"]
    ordered = judged.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    kind = judged.schema["conv_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def pieces(table: pa.Table, bounds: list[int], whole: list[bool]) -> pa.RecordBatch:
            nonlocal number
            kept = ~table["dropped"].to_numpy()
            offsets = np.concatenate(([0], np.cumsum(kept)))[bounds].astype(np.int32)
            left = table.filter(pa.array(kept))
            lists = [
                pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(left[c].chunks) if left[c].num_chunks else pa.array([], left[c].type))
                for c in ("turn", "fault", "role", "text")
            ]
            ids = table["conv_id"].take(pa.array(bounds[:-1])).combine_chunks()
            numbers = list(range(number, number + len(whole)))
            number += len(whole)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([part] * len(whole), pa.int32()), pa.array(numbers, pa.int32()), pa.array(whole), *lists],
                names=["conv_id", "part", "number", "whole", "turns", "faults", "roles", "texts"],
            )

        # the rows read of the last conversation, and whether others of it may have gone out before
        carried, cut, last_id, begun = None, True, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            ids = table["conv_id"].to_pylist()
            if begun and carried is None and ids[0] != last_id:
                cut = False
            begun, last_id = True, ids[-1]
            bounds = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            if len(bounds) > 1:
                yield pieces(table.slice(0, bounds[-1]), bounds, [not cut] + [True] * (len(bounds) - 2))
                cut = False
            carried = table.slice(bounds[-1])
            if carried.num_rows >= piece_rows or carried.nbytes >= piece_bytes:
                yield pieces(carried, [0, carried.num_rows], [False])
                carried, cut = None, True
        if carried is not None:
            yield pieces(carried, [0, carried.num_rows], [False])

    return cut_lineage(ordered.mapInArrow(pack, PIECE.format(id=kind)))


# --- repair -----------------------------------------------------------------


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _report(turns: list, faults: np.ndarray, roles: list[str]) -> tuple:
    known = [t for t in turns if t is not None]
    counts = np.bincount(faults, minlength=4).tolist()
    return (min(known, default=None), max(known, default=None), len(set(known)), counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], _illegal(roles))


def _lines(letters: list[str], closing: str, place: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows."""
    out_roles, out_texts = [], []

    def insert() -> None:
        nonlocal place
        place = _inserted(place)
        out_roles.append("assistant" if place == ASSISTANT else "user")

    for edits, role, text in zip(letters, roles, texts):
        for _ in edits[:-1]:
            insert()
            out_texts.append("")
        if edits[-1] == "R":
            insert()
            out_texts.append(text)
        elif edits[-1] == "K":
            place = _kept(place, role[:1])
            out_roles.append(role)
            out_texts.append(text)
    for _ in closing:
        insert()
        out_texts.append("")
    return out_roles, out_texts


def _repair_whole(pieces: DataFrame) -> DataFrame:
    """Repaired conversations that are one piece each."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {REPORT}, cost bigint, audit string, roles array<string>, texts array<string>"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            rows = []
            for r in batch.select(["conv_id", "turns", "faults", "roles", "texts"]).to_pylist():
                faults = np.array(r["faults"], np.int64)
                symbols = symbols_of(r["roles"], faults)
                letters, place, cost = t.trace(symbols, t.end, START)
                roles, texts = _lines(letters, t.closing[place], START, r["roles"], r["texts"])
                rows.append((r["conv_id"], *_report(r["turns"], faults, r["roles"]), cost, "".join(letters) + t.closing[place], roles, texts))
            yield from _batches(rows, schema_of)

    schema_of = _arrow(pieces.sparkSession, schema)
    return pieces.mapInArrow(repair, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _effects(pieces: DataFrame) -> DataFrame:
    """What each piece does to every vector and place, and what it adds to the report."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, part int, number int, n bigint, vector array<int>, amount array<bigint>, place array<int>, "
        f"{REPORT}, first_turn bigint, last_turn bigint, first_role string, last_role string"
    )
    arrow = _arrow(pieces.sparkSession, schema)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            rows = []
            for r in batch.select(["conv_id", "part", "number", "turns", "faults", "roles"]).to_pylist():
                faults, roles, turns = np.array(r["faults"], np.int64), r["roles"], r["turns"]
                rows.append((
                    r["conv_id"], r["part"], r["number"], len(roles), *t.effect(symbols_of(roles, faults)),
                    *_report(turns, faults, roles), turns[0] if turns else None, turns[-1] if turns else None,
                    roles[0][:1] if roles else None, roles[-1][:1] if roles else None,
                ))
            yield from _batches(rows, arrow)

    return pieces.mapInArrow(effects, schema)


def _folded(effects: DataFrame) -> DataFrame:
    """Per conversation its report and cost, and for each piece (part, number) what follows it and where it starts."""
    kind = effects.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {REPORT}, cost bigint, steps array<struct<part:int,number:int,vector:int,place:int,last:boolean>>"
    arrow = _arrow(effects.sparkSession, schema)
    rest = [c for c in effects.columns if c not in ("conv_id", "part", "number")]
    # a few hundred numbers for each piece of some 16,000 rows
    lists = effects.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "number", F.struct(*rest).alias("e")))).alias("pieces"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pieces = [p["e"] for p in r["pieces"]]
                behind, vector, cost = [], t.end, 0
                for e in reversed(pieces):
                    behind.append(vector)
                    cost += e["amount"][vector]
                    vector = e["vector"][vector]
                behind.reverse()
                cost += t.vectors[vector][START]
                steps, place = [], START
                for i, (p, v) in enumerate(zip(r["pieces"], behind)):
                    steps.append({"part": p["part"], "number": p["number"], "vector": v, "place": place, "last": i == len(pieces) - 1})
                    place = p["e"]["place"][v * PLACES + place]
                full = [e for e in pieces if e["n"]]
                known = [e for e in full if e["turn_min"] is not None]
                # sorted turns: two pieces share at most the turn at their border
                shared = sum(a["turn_max"] == b["turn_min"] for a, b in zip(known, known[1:]))
                borders = sum((a["last_role"] + b["first_role"]) not in ("su", "ua", "au") for a, b in zip(full, full[1:]))
                rows.append((
                    r["conv_id"], min((e["turn_min"] for e in known), default=None), max((e["turn_max"] for e in known), default=None),
                    sum(e["n_turns"] for e in known) - shared, *(sum(e[c] for e in full) for c in ("blank", "duplicate", "truncated")),
                    sum(e["illegal"] for e in full) + borders, cost, steps,
                ))
            yield from _batches(rows, arrow)

    return lists.mapInArrow(fold, schema)


def _repair_pieces(pieces: DataFrame, steps: DataFrame) -> DataFrame:
    """(conv_id, part, number, audit, roles, texts) of pieces, each with its step."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, number int, audit string, roles array<string>, texts array<string>"
    arrow = _arrow(pieces.sparkSession, schema)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            for r in batch.to_pylist():
                letters, place, _ = t.trace(symbols_of(r["roles"], np.array(r["faults"], np.int64)), r["vector"], r["place"])
                closing = t.closing[place] if r["last"] else ""
                roles, texts = _lines(letters, closing, r["place"], r["roles"], r["texts"])
                yield from _batches([(r["conv_id"], r["part"], r["number"], "".join(letters) + closing, roles, texts)], arrow)

    return pieces.join(checked_broadcast(steps), ["part", "number"]).select(
        "conv_id", "part", "number", "faults", "roles", "texts", "vector", "place", "last"
    ).mapInArrow(repair, schema)


def line_digest(roles: Column, texts: Column) -> Column:
    """Checksum of the repaired rows as lines `role:text`."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.concat(x.r, F.lit(":"), x.t)), "\n"), 256)


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of conversations in several pieces, read as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, audit string, repaired_sha256 string"
    arrow = _arrow(repaired.sparkSession, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, audit, started = None, None, [], False
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != current:
                    if state is not None:
                        yield from _batches([(current, "".join(audit), state.hexdigest())], arrow)
                    current, state, audit, started = r["conv_id"], hashlib.sha256(), [], False
                audit.append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    state.update((("\n" if started else "") + role + ":" + text).encode())
                    started = True
        if state is not None:
            yield from _batches([(current, "".join(audit), state.hexdigest())], arrow)

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.mapInArrow(digest, schema)


class Repair:
    """Repaired conversations of `rows` (conv_id, turn, role, text, and optionally `dropped`)."""

    def __init__(self, rows: DataFrame, piece_rows: int = PIECE_ROWS):
        if "dropped" not in rows.columns:
            rows = rows.select("conv_id", "turn", "role", "text").withColumn("dropped", F.lit(False))
        pieces = packed(judged_rows(rows), piece_rows)
        self.whole = _repair_whole(pieces.filter("whole"))
        parts = pieces.filter(~F.col("whole"))
        self.folded = cut_lineage(_folded(_effects(parts)))
        steps = self.folded.select(F.explode("steps").alias("s")).select("s.*")
        self.parts = cut_lineage(_repair_pieces(parts, steps))

    def rows(self) -> DataFrame:
        """(conv_id, piece, at, role, text): the repaired rows; `piece` and `at` give their order."""
        no = F.lit(0).cast("long")
        both = self.whole.select("conv_id", no.alias("piece"), "roles", "texts").unionByName(
            self.parts.select("conv_id", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("number")).alias("piece"), "roles", "texts"))
        return both.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r")).select(
            "conv_id", "piece", "at", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))

    def report(self) -> DataFrame:
        """Per conversation what was wrong, the cost of the repair, its audit, and the checksum of the repaired rows."""
        counts = ["conv_id", "turn_min", "turn_max", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost"]
        one = self.whole.select(*counts, "audit", line_digest(F.col("roles"), F.col("texts")).alias("repaired_sha256"))
        # few: conversations at the ends of sorted parts, and very long ones
        name = self.folded.select(*counts)
        digests = _digests(self.parts).withColumnRenamed("conv_id", "_id")
        several = name.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).select(*one.columns)
        gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
        return one.unionByName(several).select(
            "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
