"""Damaged conversations and their cheapest repair, against every edit sequence tried."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from weekwatch.llm import conversations
from weekwatch.llm.conversations import AT_END, START, before, both, cost_map, damaged, repair, report, tally, walk

SCHEMA = "conv_id long, turn long, role string, text string, copies long, segment string, kept string"


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    name = lambda r: hashlib.sha256(r[2].encode()).digest()
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), name(r))) for c, v in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def brute_repair(rows, faults, longest):
    """The least of the cheapest edit sequences, by Dijkstra's order over all of them."""
    best = {}
    todo = [(0, "", 0, "", ())]
    while todo:
        todo.sort()
        cost, letters, i, initials, kept = todo.pop(0)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, "\n".join(kept)
        key = (i, re.sub("(ua)+", "ua", initials))
        if key in best:
            continue
        best[key] = 1
        if len(initials) < longest:
            for role in ("user", "assistant"):
                todo.append((cost + 5, letters + "I", i, initials + role[0], (*kept, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            todo.append((cost + 2, letters + "D", i + 1, initials, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                choices = [("K", role, more), ("R", "user", 1 + more), ("R", "assistant", 1 + more)]
                for letter, new, price in choices:
                    todo.append((cost + price, letters + letter, i + 1, initials + (new[:1] or '?'), (*kept, f"{new}:{text}")))
        todo = [t for t in todo if re.match("(s?(ua)*u?)?$", t[3])]
    raise AssertionError


def brute(rows):
    out = set()
    for conv, kept in brute_damage(rows).items():
        faults = brute_faults(kept)
        cost, letters, text = brute_repair(kept, faults, 2 * len(kept) + 2)
        turns = {t for t, _, _ in kept if t is not None}
        gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.add((conv, gap, *counts, illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return out


TEXTS = ["Yes.", "No!", "Well", " ", "", None, "same?", "same?", "é ", "a\n.\n"]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None]


def some_rows(seed, convs, most):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(pick.randint(1, most)):
            turn = pick.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, pick.choice(ROLES), pick.choice(TEXTS)))
    return rows


def found(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, 1, "s", "k") for r in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in report(repair(damaged(table), **sizes)).collect()}


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 2}, {"block_chars": 1}])
def test_against_every_edit_sequence(spark, sizes):
    rows = some_rows(3, 60, 7)
    assert found(spark, rows, **sizes) == brute(rows)


def test_ordinary_conversations(spark):
    rows = [
        (conv, turn, ("system", *["user", "assistant"] * 4)[turn], f"Turn {turn} of {conv}{'.' * (turn % 3 > 0)}")
        for conv in range(40) for turn in range(1 + conv % 8)
    ]
    assert found(spark, rows) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    """Its rows lie in several ranges, and the same row comes again without end."""
    pick = random.Random(5)
    rows = [(7, turn, pick.choice(ROLES[:4]), pick.choice(TEXTS) or f"Number {turn}.") for turn in range(400)]
    rows += [(7, 11, "user", "again.")] * 500 + some_rows(4, 5, 5)
    blocks = found(spark, rows, block_rows=50)
    assert blocks == found(spark, rows)
    hot = next(r for r in blocks if r[0] == 7)
    kept = brute_damage(rows)[7]
    assert sum(letter != "I" for letter in hot[7]) == len(kept)
    edits = [(role[:1], fault) for (_, role, _), fault in zip(kept, brute_faults(kept), strict=True)]
    costs = AT_END
    for row in reversed(edits):
        costs = before(row, costs)
    assert (hot[6], hot[7]) == (costs[START], walk(edits, AT_END, START, True)[0])


def test_blocks_put_together_say_the_same():
    pick = random.Random(1)
    rows = [(pick.choice("suat "), pick.choice(["", "blank", "duplicate", "truncated"])) for _ in range(60)]
    turns = sorted(pick.randint(0, 40) for _ in rows)
    cut = [0, 7, 7, 30, 60]
    parts = [(rows[a:b], turns[a:b]) for a, b in itertools.pairwise(cut)]
    whole = tally(*parts[0])
    for part in parts[1:]:
        whole = both(whole, tally(*part))
    assert whole == tally(rows, turns)
    costs, one = AT_END, AT_END
    for part, _ in reversed(parts):
        table = cost_map(part)
        costs = tuple(min(table[4 * q + to] + costs[to] for to in range(4)) for q in range(4))
    for row in reversed(rows):
        one = before(row, one)
    assert costs == one


def test_long_text_and_no_rows(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "ok."), (2, 0, "user", long), (2, 1, "user", long)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, block_chars=conversations.BLOCK_CHARS // 16) == brute(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert report(repair(damaged(none))).collect() == []
