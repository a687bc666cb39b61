"""Repair of conversations whose turns are damaged: the cheapest edits that give a legal order of roles.

A conversation is legal when its role initials are ``(s?(ua)+)?``: four states tell what may follow. The cost
from a row on, for each state, follows from that of the next row. These vectors are computed backward and
stored only at checkpoints, about as many as a block between two of them has rows; the walk forward computes
a block's vectors again and takes at each step the least letter among the edits that lose nothing.

Rows are sorted by conversation and turn over ranges, so one conversation may lie in many tasks. Those that
a task holds whole it repairs at once. Longer ones, and those at the edges of a range, leave it as blocks: each
block is a map from the costs behind it to those before it, four by four; the maps of a conversation give the
vectors at its checkpoints, with which every block is walked by itself, once for each state that may enter it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.sources.scratch import store

# Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States: nothing kept yet, behind s, behind u, behind a. Where a user or assistant row leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
TO = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
# A block holds at most so many rows, and ends when its texts have so many characters.
BLOCK_ROWS = 20_000
BLOCK_CHARS = 8_000_000

Vector = tuple[int, int, int, int]


# ---- the edits ------------------------------------------------------------------------------------


def with_inserts(v: list[int]) -> Vector:
    """The costs when empty turns may be put in first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return (min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant)


# A conversation may end where nothing is kept, and behind an assistant.
AT_END: Vector = with_inserts([0, NEVER, NEVER, 0])


def edits(row: tuple[str, str], state: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in a state, in the order of their letters: ``letter, cost, next state``.

    A row is its role's initial and its fault. An empty turn put in before it is among them.
    """
    initial, fault = row
    yield "D", DELETE, state
    yield "I", INSERT, TO[state]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial == "s" and state == START:
            yield "K", more, SYSTEM
        if initial == ("a" if TO[state] == ASSISTANT else "u"):
            yield "K", more, TO[state]
        yield "R", RENAME + more, TO[state]


def before(row: tuple[str, str], after: Vector) -> Vector:
    """The costs before a row, from those behind it."""
    return with_inserts([min(cost + after[to] for letter, cost, to in edits(row, q) if letter != "I") for q in range(4)])


def walk(rows: list[tuple[str, str]], after: Vector, state: int, last: bool) -> tuple[str, int]:
    """The least letters among the cheapest edits of ``rows``, and the state behind them.

    ``after`` holds the costs behind the rows; turns missing there are put in only if the rows are the ``last``.
    """
    every = math.isqrt(len(rows)) + 1
    marks, costs = {len(rows): after}, after
    for i in range(len(rows) - 1, -1, -1):
        costs = before(rows[i], costs)
        if i % every == 0:
            marks[i] = costs
    letters = []
    for start in range(0, len(rows), every):
        stop = min(start + every, len(rows))
        block = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(before(rows[i], block[-1]))
        block.reverse()
        for i, (here, then) in enumerate(zip(block, block[1:], strict=False), start):
            letter = "I"
            while letter == "I":
                letter, state = next(
                    (name, to) for name, cost, to in edits(rows[i], state)
                    if cost + (here if name == "I" else then)[to] == here[state]
                )
                letters.append(letter)
    while last and AT_END[state]:
        letters.append("I")
        state = TO[state]
    return "".join(letters), state


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """The rows that the letters make, from the state before them."""
    at = iter(zip(roles, texts, strict=True))
    for letter in letters:
        if letter == "I":
            state = TO[state]
            yield ROLES[state], ""
            continue
        role, text = next(at)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else TO[state]
        yield (role if letter == "K" else ROLES[state]), text


def cost_map(rows: list[tuple[str, str]]) -> list[int]:
    """The costs before the rows for each state before, and each state behind: 16 numbers."""
    columns = []
    for behind in range(4):
        costs = tuple(0 if q == behind else NEVER for q in range(4))
        for row in reversed(rows):
            costs = before(row, costs)
        columns.append(costs)
    return [min(columns[behind][q], NEVER) for q in range(4) for behind in range(4)]


# ---- what a run of rows says ----------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")


def tally(rows: list[tuple[str, str]], turns: list[int | None]) -> dict:
    """Faults, illegal neighbours and turns of a run of rows, such that those of two runs can be put together."""
    known = [t for t in turns if t is not None]
    out = {name: sum(fault == name for _, fault in rows) for name in COUNTS[:3]}
    out["illegal"] = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    out |= {"low": known[0] if known else None, "high": known[-1] if known else None}
    out["turns"] = 1 + sum(a != b for a, b in zip(known, known[1:], strict=False)) if known else 0
    return out | {"front": rows[0][0] if rows else None, "back": rows[-1][0] if rows else None}


def both(a: dict, b: dict) -> dict:
    """The tally of two runs of which the second follows the first."""
    if a["front"] is None or b["front"] is None:
        return b if a["front"] is None else a
    out = {name: a[name] + b[name] for name in COUNTS}
    out["illegal"] += a["back"] + b["front"] not in LEGAL
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"front": a["front"], "back": b["back"]}


def gaps(t: dict) -> int:
    return 0 if t["low"] is None else t["high"] - t["low"] + 1 - t["turns"]


# ---- damage ---------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` of each row, damaged by a hash of its conversation and turn.

    Dropped rows have no copies, repeated ones two. A null conversation or turn counts as a space in the hash; a
    null role or text becomes one. Other columns are not read.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced(conv), spaced(turn))) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(spaced(role)).alias("role"),
        said.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _faults(text: Column) -> Column:
    """``blank``, ``truncated`` or ``''``, by the text alone."""
    trimmed = F.rtrim(text, F.lit(SPACE))
    return F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


# ---- the jobs -------------------------------------------------------------------------------------

TALLY = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint, front string, back string"
TALLY_NAMES = tuple(column.split()[0] for column in TALLY.split(", "))
BLOCKS = f"part bigint, number bigint, whole boolean, faults array<string>, kept array<struct<role:string,text:string>>, map array<bigint>, cost bigint, audit string, {TALLY}"
KEPT = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
BLOCK_KINDS = {
    "part": pa.int64(), "number": pa.int64(), "whole": pa.bool_(), "faults": pa.list_(pa.string()), "kept": KEPT,
    "map": pa.list_(pa.int64()), "cost": pa.int64(), "audit": pa.string(),
    **{name: pa.string() if name in ("front", "back") else pa.int64() for name in TALLY_NAMES},
}


def _as_rows(pairs) -> list[dict]:
    return [{"role": r, "text": t} for r, t in pairs]


def _collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one, so that rows repeated without end reach the shuffle as few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                keys = [c for c in table.column_names if c != "copies"]
                summed = table.group_by(keys).aggregate([("copies", "sum")]).rename_columns([*keys, "copies"])
                yield from summed.select(table.column_names).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def _blocks(sorted_rows: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """Whole conversations repaired, and blocks of the others, from rows in order.

    A mark, which has no ``copies``, stands before the first row of a conversation with that role and text.
    """
    conv_type = sorted_rows.schema["conv"].dataType.simpleString()
    wanted = ("conv", "turn", "role", "name", "text", "fault", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out, waiting = TaskContext.get().partitionId(), 0, [], 0
        conv, conv_kind, mark, begun, cut, first = None, None, None, False, False, True
        rows, turns, said, chars = [], [], [], 0

        def put(whole: bool) -> None:
            nonlocal number, waiting, chars
            found = {"conv": conv, "part": part, "number": number, "whole": whole} | tally(rows, turns)
            roles, texts = [r for r, _ in said], [t for _, t in said]
            if whole:
                costs = AT_END
                for row in reversed(rows):
                    costs = before(row, costs)
                letters, _ = walk(rows, AT_END, START, True)
                found |= {"cost": costs[START], "audit": letters, "kept": _as_rows(repaired(roles, texts, letters, START))}
            else:
                found |= {"faults": [f"{fault}:{initial}" for initial, fault in rows], "map": cost_map(rows), "kept": _as_rows(said)}
            out.append(found)
            number += 1
            waiting += len(rows) * 100 + chars
            chars = 0
            for held in (rows, turns, said):
                held.clear()

        def table() -> pa.RecordBatch:
            nonlocal waiting
            kinds = {"conv": conv_kind} | BLOCK_KINDS
            arrays = [pa.array([f.get(name) for f in out], kind) for name, kind in kinds.items()]
            out.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(arrays, list(kinds))

        for batch in batches:
            conv_kind = batch.schema.field("conv").type
            for c, turn, role, name, text, fault, copies in zip(*(batch.column(x).to_pylist() for x in wanted), strict=True):
                if not begun or c != conv:
                    if begun:
                        put(not first and not cut)
                        cut, first = False, False
                    begun, conv, mark = True, c, None
                if copies is None:
                    mark = (turn, role, name)
                for _ in range(copies or 0):
                    mine = fault
                    if fault != "blank":
                        mine, mark = (fault, None) if (turn, role, name) == mark else ("duplicate", mark)
                    rows.append((role[:1], mine))
                    turns.append(turn)
                    said.append((role, text))
                    chars += len(text)
                    if len(rows) >= block_rows or chars >= block_chars:
                        cut = True
                        put(False)
                    if waiting > block_chars:
                        yield table()
                if waiting > block_chars or len(out) > 2_000:
                    yield table()
        if begun:
            put(False)
        if out:
            yield table()

    return sorted_rows.mapInArrow(run, f"conv {conv_type}, {BLOCKS}")


def _checkpoints(maps: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each block of one conversation, and the tally of all in the row of the last."""
    maps = maps.sort_values(["part", "number"], ignore_index=True)
    after, total, costs = [], None, AT_END
    for row in reversed(maps["map"].tolist()):
        after.append(list(costs))
        costs = tuple(min(int(row[4 * q + to]) + costs[to] for to in range(4)) for q in range(4))
    for values in zip(*(maps[name] for name in TALLY_NAMES), strict=True):
        one = {n: None if pd.isna(v) else v if isinstance(v, str) else int(v) for n, v in zip(TALLY_NAMES, values, strict=True)}
        total = one if total is None else both(total, one)
    last = [False] * (len(maps) - 1) + [True]
    out = pd.DataFrame({"part": maps["part"], "number": maps["number"], "segment": range(len(maps)), "last": last, "after": after[::-1]})
    sums = {"cost": costs[START], "gaps": gaps(total)} | {name: total[name] for name in COUNTS}
    for name, value in sums.items():
        out[name] = pd.array([None] * (len(maps) - 1) + [value], "Int64")
    return out


SUMS = ("cost", "gaps", *COUNTS)
SUM_TYPES = ", ".join(f"{name} bigint" for name in SUMS)


def _walked(blocks: DataFrame) -> DataFrame:
    """Each block walked from each state that may enter it: the letters, and the states behind it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            walks = []
            for faults, after, last in zip(batch["faults"], batch["after"], batch["last"], strict=True):
                rows = [(initial, fault) for fault, _, initial in (f.partition(":") for f in faults)]
                after = tuple(int(x) for x in after)
                walks.append([walk(rows, after, q, last) for q in range(4)])
            yield batch[["part", "number"]].assign(audits=[[w[0] for w in ws] for ws in walks], exits=[[w[1] for w in ws] for ws in walks])

    named = blocks.select("part", "number", "faults", "after", "last")
    return named.mapInPandas(run, "part bigint, number bigint, audits array<string>, exits array<bigint>")


def _entered(exits: pd.DataFrame) -> pd.DataFrame:
    """The state in which the walk enters each block of one conversation."""
    exits = exits.sort_values("segment", ignore_index=True)
    states, state = [], START
    for row in exits["exits"]:
        states.append(state)
        state = int(row[state])
    return pd.DataFrame({"part": exits["part"], "number": exits["number"], "state": states})


def _kept(blocks: DataFrame) -> DataFrame:
    """The repaired rows of blocks whose letters are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, letters, states = (batch.column(c).to_pylist() for c in ("kept", "audit", "state"))
            kept = [
                _as_rows(repaired([r["role"] for r in rows], [r["text"] for r in rows], audit, state))
                for rows, audit, state in zip(said, letters, states, strict=True)
            ]
            at = batch.schema.get_field_index("kept")
            yield batch.set_column(at, "kept", pa.array(kept, KEPT)).select([c for c in batch.schema.names if c != "state"])

    out = blocks.drop("state")
    return blocks.mapInArrow(run, out.schema)


def repair(
    rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The repaired conversations, as segments: ``conv, segment, last, audit, kept`` and, in the last one, sums.

    ``rows`` has ``conv, turn, role, text, copies``; a row without copies only says that the conversation exists.
    ``kept`` are the repaired rows in order, ``audit`` the letters of the edits: Delete, Insert, Keep, Rerole. The
    sums are ``cost, gaps, blank, duplicate, truncated, illegal``. Rows are ordered by turn, null first, then role,
    then a hash of the text. A null conversation is a conversation like any other. Conversations of any length come
    in as many segments as they have blocks; most have one. A conversation without rows has one segment without rows.
    An empty role has no initial and cannot be kept as it is. Texts may be of any length, and columns of the table
    that ``damaged`` read have no bearing. An empty table gives no segments.
    """
    rows = rows.withColumn("text", F.when(F.col("copies") == 0, "").otherwise(F.col("text")))
    named = _collapsed(rows).select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("name"), "text", _faults(F.col("text")).alias("fault"), "copies"
    )
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")
    marks = named.where("copies > 0 and fault <> 'blank'").groupBy("conv", "role", "name").agg(first)
    nothing = F.lit(None).cast("string")
    marks = marks.select("conv", "first.turn", "role", "name", nothing.alias("text"), nothing.alias("fault"), F.lit(None).cast("bigint").alias("copies"))
    order = ["conv", "turn", "role", "name"]
    in_order = named.union(marks).repartitionByRange(*order).sortWithinPartitions(*order, "copies")
    blocks = store(_blocks(in_order, block_rows, block_chars), "blocks")

    spread = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = blocks.where("whole").select(
        "conv", F.lit(0).cast("bigint").alias("segment"), F.lit(True).alias("last"), "audit", "kept",
        "cost", spread.cast("bigint").alias("gaps"), *COUNTS,
    )
    edge = blocks.where("not whole")
    marked = edge.select("conv", "part", "number", "map", *TALLY_NAMES).groupBy("conv").applyInPandas(
        _checkpoints, f"part bigint, number bigint, segment bigint, last boolean, after array<bigint>, {SUM_TYPES}"
    )
    marked = store(marked, "checkpoints")
    at = ["part", "number"]
    walked = store(_walked(edge.join(marked, at)), "walks")
    convs = edge.select("conv", *at).join(marked.select(*at, "segment"), at).join(walked.select(*at, "exits"), at)
    entered = convs.groupBy("conv").applyInPandas(_entered, "part bigint, number bigint, state bigint")
    known = edge.select("conv", *at, "kept").join(marked.drop("after"), at).join(walked.select(*at, "audits"), at).join(entered, at)
    known = known.select(
        "conv", "segment", "last", F.element_at("audits", F.col("state").cast("int") + 1).alias("audit"), "kept", *SUMS, "state"
    )
    return whole.union(_kept(known))


def _streamed(segments: DataFrame) -> DataFrame:
    """Audit and digest of conversations with several segments, which pass through a task one after another."""
    conv_type = segments.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, begun = [], hashlib.sha256(), False
        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in batch.to_pylist():
                audit.append(row["audit"])
                for r in row["kept"]:
                    sha.update(f"{chr(10) if begun else ''}{r['role']}:{r['text']}".encode())
                    begun = True
                if row["last"]:
                    out = {"conv": row["conv"]} | {name: row[name] for name in SUMS} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    kinds = {"conv": kind} | dict.fromkeys(SUMS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
                    yield pa.RecordBatch.from_arrays([pa.array([out[n]], k) for n, k in kinds.items()], list(kinds))
                    audit, sha, begun = [], hashlib.sha256(), False

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "segment")
    return ordered.mapInArrow(run, f"conv {conv_type}, {SUM_TYPES}, audit string, repaired_sha256 string")


def report(segments: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``, one row a conversation.

    The digest runs over all repaired rows in order, so the segments of one conversation pass through one task,
    which holds one at a time.
    """
    lines = F.transform("kept", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    single = (F.col("segment") == 0) & F.col("last")
    short = segments.where(single).select("conv", *SUMS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    named = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    return short.union(_streamed(segments.where(~single))).select(F.col("conv").alias("conv_id"), *named)
