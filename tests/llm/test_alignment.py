"""Alignment of two tokenizers: the lockstep, words against whole texts, and counts over a table."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwatch.llm import alignment
from weekwatch.llm.alignment import A_FILE, B_FILE, VOCABULARIES, Words, align, cross_tokenizer, lockstep


@pytest.fixture(scope="module")
def words():
    return Words(*((Path(VOCABULARIES) / f).read_bytes() for f in (A_FILE, B_FILE)))


def brute(words, text):
    """``a ids, b ids, links, groups`` of a text encoded whole; None without tokens."""
    if not text:
        return None
    raw = f" {text}".encode()
    a, b = words.a.encode(f" {text}", add_special_tokens=False).ids, words.b.encode(text)
    if b"".join(words.bytes_a[i] for i in a) != raw or b"".join(words.bytes_b[i] for i in b) != raw:
        return None
    ends_a, ends_b = np.cumsum(words.size_a[a]).tolist(), np.cumsum(words.size_b[b]).tolist()
    links, groups, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end), ends_b.index(end)
        links.append((a[k], b[m]))
        groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
        i, j = k + 1, m + 1
    return a, b, links, ";".join(groups)


def expected(words, texts):
    every = [brute(words, t) for t in texts]
    counts = Counter(link for one in every if one for link in one[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for one in every:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = one
        top = sum(counts[x] == best[x[1]] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest()
        out.append((len(a), len(b), len(links), len(links), top, sum(counts[x] for x in links), digest))
    return out


TEXTS = [
    "The cat sat.", "The  cat sat.", " leading", "trailing ", "", None, " ", "  ", "\n", "a\tb\nc d\r\ne", "▁ mark", "a▁b",
    "<s> <0x41> <unk></s> <|endoftext|> x", "it's don't 'll 's x 's", "naïve café über straße", "日本語 の 文章 です。", "🙂 🙃👍🏽 ok",
    "é á b", "\x00 nul", "x y   z", "1234 5678, 12.5% (a) [b]", "ab " * 3000, "x" * 5000, "The cat sat.",
    "a ́b", "A ­b", "﻿bom first", "-- --- ----", "line one\n\nline two\n  indented",
]


def test_words_give_the_tokens_of_whole_texts(words):
    assert words.separable
    for text, got in zip(TEXTS, align([t or "" for t in TEXTS], words), strict=True):
        one = brute(words, text)
        if one is None:
            assert (got.n_a, got.n_b, got.n_groups, got.digest) == (0, 0, 0, ""), text
        else:
            digest = hashlib.sha256(one[3].encode()).hexdigest()
            assert (got.n_a, got.n_b, got.n_groups, got.digest) == (len(one[0]), len(one[1]), len(one[2]), digest), text


def test_any_order_of_texts(words):
    import random

    files = [(Path(VOCABULARIES) / f).read_bytes() for f in (A_FILE, B_FILE)]
    texts = [t or "" for t in TEXTS]
    digests = [a.digest for a in align(texts, words)]
    for size in (1, 2, 5):
        fresh, order = Words(*files), random.Random(size).sample(range(len(texts)), len(texts))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            assert [a.digest for a in align([texts[k] for k in some], fresh)] == [digests[k] for k in some]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZé ß.,'s\n\t 0ſ▁́ 日🙂-<>|x")) | st.text())
def test_any_text(words, text):
    (got,) = align([text], words)
    one = brute(words, text)
    assert got.digest == ("" if one is None else hashlib.sha256(one[3].encode()).hexdigest())


LANES = st.lists(st.tuples(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30))), max_size=8)


@given(LANES)
def test_lockstep(lanes):
    ends = [[sorted(side | {31}) for side in lane] for lane in lanes]
    flat = [np.array([e for lane in ends for e in lane[k]], np.int64) for k in (0, 1)]
    starts = [np.cumsum([0, *(len(lane[k]) for lane in ends)]) for k in (0, 1)]
    a, b = lockstep(flat[0], starts[0], flat[1], starts[1])
    lane_of = np.searchsorted(starts[0], a, side="right") - 1
    got = [(int(n), int(e)) for n, e in zip(lane_of, flat[0][a], strict=True)]
    assert got == [(n, e) for n, lane in enumerate(ends) for e in lane[0] if e in lane[1]]
    assert flat[0][a].tolist() == flat[1][b].tolist()


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 3, 1])
def test_counts_over_a_table(spark, words, monkeypatch, hot):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 500)
    texts = TEXTS + ["the of the and the", "The cat sat. The dog"] * 5
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, 1, "p") for i, t in enumerate(texts)], "doc_id long, text string, row int, pairs string")
    rows = cross_tokenizer(docs.repartition(3), hot_pairs=hot).collect()
    ids = [None if i == 3 else i // 2 for i in range(len(texts))]
    assert Counter(tuple(r) for r in rows) == Counter((i, *e) for i, e in zip(ids, expected(words, texts), strict=True))


def test_forgets_and_starts_afresh(words, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    first = [a.digest for a in align(["one two three four five"], words)]
    assert [a.digest for a in align(["one two three four five"], words)] == first


def test_no_rows(spark):
    assert cross_tokenizer(spark.createDataFrame([], "doc_id long, text string")).collect() == []
