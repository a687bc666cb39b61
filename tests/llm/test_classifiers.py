"""Toxicity and quality: held-out accuracy, edges, and the compiled forms."""

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weekwatch.llm import quality, registry, toxicity

DOCS = "doc_id long, text string, score double, label string"
LABELS = "doc_id long, toxic int, quality int, text string"


def auc(scores, labels):
    order = pd.Series(scores).rank().to_numpy()
    ones = np.asarray(labels) == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_is_every_fifth_checksum(spark):
    docs = spark.createDataFrame([(i, "x", None, None) for i in range(200)] + [(None, "x", None, None)], DOCS)
    got = {r["doc_id"]: r["held_out"] for r in quality.score(docs, quality.RuleModel(0.0, ())).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)} | {None: True}


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.85), ("op3_quality", "quality", 0.97)])
def test_accuracy_on_held_out_rows(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    scored = registry.queries()[name](spark, folder)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows["score"].between(0, 1).all()
    assert auc(rows["score"], rows[label]) >= least
    assert (rows["predicted"] == rows[label]).mean() >= 0.97
    clean = rows[rows[label] == (0 if label == "toxic" else 1)]
    assert (clean["predicted"] == clean[label]).mean() >= 0.99


def toy(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "stone", "river", "house", "light"]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, 30))
        toxic = i % 4 == 0
        rows.append((i, f"{text} vileword {text}" if toxic else text, None, "x"))
        labels.append((i, int(toxic), int(i % 3 > 0), None))
    rows = [(i, t if i % 3 else t.upper() + " ###", s, x) for i, t, s, x in rows]
    return rows, labels


EDGES = [(9000, None, 1.0, None), (9001, "", None, None), (9002, " \n", None, None), (None, "vileword", None, None),
         (9003, "calm " * 60_000 + "vileword", None, None), (4, "vileword", None, None), (4, "vileword", None, None)]


def test_toxicity_learns_and_scores_edges(spark):
    rows, labels = toy(spark)
    labels += [(None, 1, 1, None), (1, None, None, None), (2, 0, 1, None), (12345, 1, 1, None)]
    docs, known = spark.createDataFrame(rows + EDGES, DOCS), spark.createDataFrame(labels, LABELS)
    got = toxicity.score(docs, toxicity.fit(docs, known)).toPandas()
    assert len(got) == len(rows) + len(EDGES) and got["score"].between(0, 1).all()
    by_id = got.groupby("doc_id")["score"].max()
    assert all((by_id[i] >= 0.5) == (i % 4 == 0) for i in range(600) if i != 4)
    assert by_id[9003] >= 0.5 and by_id[9000] == by_id[9001] == by_id[9002] < 0.5


def test_training_terms_are_stored_in_order(spark):
    docs = spark.createDataFrame([(i, 1.0, t) for i, t in enumerate([t for t in ODD_TEXTS if "\ud800" not in (t or "")])],
                                 "doc_id long, label double, text string")
    for row, text in zip(toxicity._term_rows(docs).orderBy("doc_id").collect(), ODD_TEXTS):
        assert row["terms"] == sorted(toxicity.hashed_terms(text))
    assert len({len(step) for _, step in toxicity.STEP_NAMES}) == 1


def test_pairs_add_to_the_score():
    terms = tuple(sorted(toxicity.hashed_terms("insult") | toxicity.hashed_terms("group")))
    model = toxicity.FactorModel(-2.0, terms, np.zeros(len(terms)), np.ones((len(terms), 1)))
    alone, both = model.scores(pd.Series(["insult", "insult group"]))
    n = [len(toxicity.hashed_terms(t)) for t in ("insult", "insult group")]
    logit = [math.log(p / (1 - p)) for p in (alone, both)]
    assert logit == pytest.approx([-2.0 + k * (k - 1) / 2 for k in n])


ODD_TEXTS = [
    None, "", " \n", "insult", "Insults insulted insulting insulter insulters insultingly insult_able in5ult",
    "STRASSE straße ΣΊΣΥΦΟΣ İstanbul \u201cquoted\u201d\u2014dash x² ½ ٣٤ 한국어 中文字 e\u0301te\u0301 a\x85b\xa0c\x1cd",
    "calm " * 3000 + "insultable", "z" * 5000 + " insults " + "insult" * 40, "insult\u0301s \ud800 insulted",
]


def _words_read_one_by_one(text):
    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def test_words_are_runs_of_letters():
    for text in ODD_TEXTS:
        words = _words_read_one_by_one(text)
        assert toxicity.distinct_words(text) == words
        assert toxicity.distinct_words(text, {"insult", "calm", "x²"}) == words - {"insult", "calm", "x²"}


@pytest.mark.parametrize("bits", [4, 9, 30])
@pytest.mark.parametrize("most", [0, 3, 1 << 16])
def test_terms_found_are_those_of_all_words(bits, most):
    every = sorted(set().union(*(toxicity.hashed_terms(t, bits) for t in ODD_TEXTS)))
    for terms in ([], every[::3], every[1::7], every):
        finder = toxicity.TermFinder(terms, bits, most)
        for text in ODD_TEXTS * 2:
            held = toxicity.hashed_terms(text, bits)
            assert finder.held(text) == [i for i, t in enumerate(terms) if t in held]
            assert len(finder.quiet) <= most and all(len(w) <= toxicity.QUIET_LETTERS for w in finder.quiet)


def test_stems_are_hashed_once_whatever_their_steps(monkeypatch):
    words = {f"insult{end}" for end in "abcdefgh"}
    spelled = words | {f"{'insults'[:k]}*{n}" for k in (4, 5, 6) for n in (1, 2, 3, 5, 8)}
    hashed = []
    crc32 = zlib.crc32
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda *a: hashed.append(a[0]) or crc32(*a))
    assert toxicity.hashed_terms(" ".join(sorted(words))) == {crc32(t.encode()) >> 2 for t in spelled}
    begun = [t for t in hashed if not t.startswith(b"*")]
    assert sorted(begun) == sorted([*(w.encode() for w in words), b"insu", b"insul", b"insult"])


def test_words_without_terms_are_hashed_once_a_task(monkeypatch):
    hashed = []
    crc32 = zlib.crc32
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda *a: hashed.append(a) or crc32(*a))
    terms = tuple(sorted(toxicity.hashed_terms("insult")))
    model = toxicity.FactorModel(-2.0, terms, np.ones(len(terms)), np.zeros((len(terms), 1)))
    text = " ".join(f"harmless{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    model.scores(pd.Series([text]))
    once = len(hashed)
    hashed.clear()
    model.scores(pd.Series([text] * 50))
    assert len(hashed) <= once + 50


def test_remembered_words_take_less_than_the_texts_of_a_batch(monkeypatch):
    made, finder = [], toxicity.TermFinder
    monkeypatch.setattr(toxicity, "TermFinder", lambda *a, **k: made.append(finder(*a, **k)) or made[-1])
    terms = tuple(sorted(toxicity.hashed_terms("insult")))
    model = toxicity.FactorModel(-2.0, terms, np.ones(len(terms)), np.zeros((len(terms), 1)))
    texts = [" ".join(f"harmless{a}{b}{c}" for b in "abcdefgh" for c in "abcdefgh") for a in "abcdefghijklmnop"]
    batches = [pa.array(texts[:1]), pa.array(texts), pa.array(["insult", None, ""])]
    expected = [list(model.scores(b.to_pylist())) for b in batches]
    made.clear()
    for batch, scores in zip(batches, model.score_batches(batches)):
        assert scores.to_pylist() == expected.pop(0)
        assert len(made[0].quiet) <= made[0].most <= max(b.nbytes for b in batches) // toxicity.QUIET_BYTES
    assert len(made) == 1 and 0 < batches[0].nbytes // toxicity.QUIET_BYTES < made[0].most


def test_quality_learns_and_scores_edges(spark):
    rows, labels = toy(spark)
    labels += [(None, 1, 1, None), (1, None, None, None), (2, 0, 1, None)]
    docs, known = spark.createDataFrame(rows + EDGES, DOCS), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, known)
    assert model.rules and all(r.weight for r in model.rules)
    got = quality.score(docs, model).toPandas()
    assert len(got) == len(rows) + len(EDGES) and got["score"].between(0, 1).all()
    by_id = got.groupby("doc_id")["score"].max()
    assert all((by_id[i] >= quality.THRESHOLD) == (i % 3 > 0) for i in range(600) if i != 4)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    good = got[got["score"] >= quality.THRESHOLD]
    assert kept.count() == len(good)
    plan = quality.score(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_compiled_rules_equal_rules_read_one_by_one(spark):
    rows, labels = toy(spark)
    docs, known = spark.createDataFrame(rows[:50], DOCS), spark.createDataFrame(labels, LABELS)
    model = quality.fit(spark.createDataFrame(rows, DOCS), known)
    numbers = quality.with_statistics(docs, "text", F.col("doc_id")).collect()
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in numbers:
        held = [rule.weight for rule in model.rules
                if all((r[n] > t) == above for n, above, t in rule.conditions)]
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(model.intercept + sum(held)))))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_nothing_to_learn_from(spark, module):
    docs = spark.createDataFrame([(i, "a b", None, None) for i in range(20)], DOCS)
    for labels, expected in (([], 0.5), ([(i, 1, 1, None) for i in range(20)], 1.0)):
        model = module.fit(docs, spark.createDataFrame(labels, LABELS))
        assert all(r["score"] == pytest.approx(expected, abs=1e-5) for r in module.score(docs, model).collect())
    empty = docs.limit(0)
    assert module.score(empty, module.fit(empty, spark.createDataFrame([], LABELS))).collect() == []


def test_statistics_of_nothing_are_zero(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", None, None)], DOCS)
    for row in quality.with_statistics(docs, "text").collect():
        assert set(row) == {0.0}
