"""The Jaccard join against all pairs."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekwatch.llm import near_dedup
from weekwatch.llm.components import components
from weekwatch.llm.near_dedup import keep_one, near_groups, shingles, similar_sets


def plain_set(text, words):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not parts:
        return frozenset()
    return frozenset(tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1)))


def all_pairs(rows, words, num, den):
    """``(doc_id, size, component, links)`` of each row."""
    sets = [plain_set(t, words) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and b and den * len(a & b) >= num * len(a | b):
                links[x] += 1
                links[y] += 1
                label[top(x)] = top(y)
    smallest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[top(k)] = min(doc_id, smallest.get(top(k), doc_id))
    return sorted(
        ((d, len(sets[k]), smallest.get(top(k)), links[k]) for k, (d, _) in enumerate(rows)), key=str
    )


def answers(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()), key=str)


def rows_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = "one two three four five six seven eight nine ten " * 3
    words = [f"w{i}" for i in range(60)]
    near = []
    for k in range(25):  # a star around doc 9000: copies differ from it more than allowed among themselves
        changed = list(words)
        changed[2 * k] = f"x{k}"
        near.append((9000 + k, " ".join(changed)))
    rows += [
        (8001, None), (8002, ""), (8003, " \n\t"), (8004, "Alone"), (8005, "alone"), (8006, "two words"),
        (8007, "TWO\x0bwords"), (8008, "two words"), (None, "two words"), (None, "no id but words here"),
        (8009, base), (8010, base.upper()), (8010, base.upper()), (8010, "another text of the same id"),
        (8011, base + "eleven"), (8012, "É" + base), (8999, " ".join(words)), *near,
    ]
    return rows


@pytest.mark.parametrize(("words", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_all_pairs(spark, sf_dir, words, num, den):
    rows = rows_of(spark, sf_dir)
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, size int, node string")
    assert answers(near_groups(docs, words, num, den)) == all_pairs(rows, words, num, den)


def test_blocks_give_the_same(spark, sf_dir, monkeypatch):
    rows = rows_of(spark, sf_dir)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(near_groups(docs, 3, 9, 10)) == all_pairs(rows, 3, 9, 10)


def test_texts_are_cut_once_for_links_and_signatures(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(30)]  # all pairs are similar
    docs = spark.createDataFrame([(t,) for t in [*near, near[0], "apart from all others"]], "text string")
    links = near_dedup.candidate_links(docs.repartition(4), 3, 4, 5, 48, 40)
    assert links._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    found = {r["node"]: r["component"] for r in components(links).collect()}

    def name(text):
        tokens = shingles(text, 3)
        return near_dedup.member_names(near_dedup.set_name(tokens), near_dedup.parts_of(len(tokens), 4, 5))[0]

    assert len({found[name(t)] for t in near}) == 1
    assert name("apart from all others") not in found


def test_texts_alike_in_single_shingles_meet_nothing(spark, monkeypatch):
    """A chain of texts, each with a few words of the next, and one pair of near copies."""
    texts = [" ".join(f"w{k + j}x{j if j < 4 else k}" for j in range(8)) + f" common words of all {k} " * 3 for k in range(40)]
    texts += [" ".join(f"own{k}w{i}" for i in range(30)) + " common words of all" + f" link {k // 2}" for k in range(40)]
    pair = [f"p{i}" for i in range(60)]
    texts += [" ".join(pair), " ".join([*pair[:30], "other", *pair[31:]])]
    joined = []
    candidate_links = near_dedup.candidate_links
    monkeypatch.setattr(near_dedup, "candidate_links", lambda held, *a: joined.append(held) or candidate_links(held, *a))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answers(near_groups(docs, 3, 4, 5)) == all_pairs(rows, 3, 4, 5)
    assert {r["text"] for r in joined[0].collect()} == set(texts[-2:])


@pytest.mark.parametrize(("bits", "at_once"), [(6, 1_000_000), (17, 1_000_000), (7, 40)])
def test_lone_shingles(spark, monkeypatch, bits, at_once):
    monkeypatch.setattr(near_dedup, "NAMED_SHINGLES", at_once)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9, n)) for n in rng.integers(0, 30, 90)]
    texts += [texts[0], texts[0], "a text of words that no other has", None, " "]
    sets = [plain_set(t, 2) for t in texts]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["node"]: r["lone"] for r in near_dedup.lone_shingles(docs, 2, bits).collect()}
    for k, (text, own) in enumerate(zip(texts, sets)):
        if own:
            alone = len(own.difference(*(s for j, s in enumerate(sets) if j != k)))
            assert got.get(near_dedup.set_name(shingles(text, 2)), 0) == alone


def test_one_row_of_each_group_stays(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, th string")
    kept = keep_one(docs, 3, 9, 10)
    assert kept.columns == ["doc_id", "text", "th"]
    groups = {c for _, n, c, _ in all_pairs(rows, 3, 9, 10) if n}
    with_words = [r["doc_id"] for r in kept.collect() if (r["text"] or "").split()]
    assert sorted(with_words, key=str) == sorted(groups, key=str)
    assert {r["doc_id"] for r in kept.collect()} >= {8001, 8002, 8003}


def test_no_rows(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=25))
def test_overlaps_are_exact(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for x, alike in similar_sets(arrays, 4, 5):
        expected = [y for y in range(len(sets)) if y != x and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
        assert alike.tolist() == expected


@settings(max_examples=50, deadline=None)
@given(st.text("aA é \n\t\x0b", max_size=30), st.integers(1, 4))
def test_shingles_count(text, words):
    assert len(shingles(text, words)) == len(plain_set(text, words))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    linked = {n for u, v in links if u != v for n in (u, v)}
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((n, label[n]) for n in linked)


@settings(max_examples=150, deadline=None)
@given(st.data(), st.integers(1, 300), st.sampled_from([(4, 5), (9, 10)]))
def test_similar_sets_share_a_signature(data, size, similarity):
    num, den = similarity
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    tokens = np.unique(rng.integers(0, 2**64, size + 100, dtype=np.uint64, endpoint=False))
    rng.shuffle(tokens)
    base, spare = tokens[:size], tokens[size:]
    gone = data.draw(st.integers(0, max(0, size // 4)))
    new = data.draw(st.integers(0, min(100, size // 4)))
    other = np.concatenate([base[gone:], spare[:new]])
    if len(other) and den * (size - gone) >= num * (size + new):
        both = [near_dedup.signatures(np.sort(x), near_dedup.parts_of(len(x), num, den)) for x in (base, other)]
        named = [{(r, h) for r, hashes in s for h in hashes.tolist()} for s in both]
        assert named[0] & named[1]
