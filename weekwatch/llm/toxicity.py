"""Toxicity by a factorization machine over hashed terms.

Every term has a linear weight and a short vector; two terms of a text add the product of their
vectors, so that a pair may count although its terms alone do not. Terms are hashed; only those
whose presence differs between the labels are given weights.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.quality import training_rows
from weekwatch.llm.text import held_out, whole
from weekwatch.sources.scratch import store

# Bits of a term's hash. Only chosen terms are stored, so the space may be wide.
HASH_BITS = 30
# Lengths of the beginnings of words, and numbers of words that share one.
STEM_LETTERS, STEM_STEPS = (4, 5, 6, 7), (1, 2, 3, 5, 8)
STEP_NAMES = tuple((n, f"*{n}".encode()) for n in STEM_STEPS)
# At most so many terms get weights, and only where the log-likelihood ratio of presence reaches this.
MAX_TERMS, LEAST_RATIO = 2048, 16.0
# At most so many labelled rows are fitted to: those whose ids have the smallest hashes.
TRAINING_ROWS = 20_000
FACTORS, ITERATIONS, STEP, PENALTY, SEED = 4, 120, 0.2, 1e-4, 17
THRESHOLD = 0.5
# A word is a run of letters. ASCII characters that are no letters stand between words in any language.
WORD = r"[^\W\d_]+"
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
# At most so many words, of at most so many letters, are remembered in a task as words of no term of the model, and
# no more than one for so many bytes of its largest batch: remembered words take less than the batch's texts.
QUIET_WORDS, QUIET_LETTERS, QUIET_BYTES = 1 << 16, 32, 128


def distinct_words(text: str | None, passed: Set[str] = frozenset()) -> set[str]:
    """The words of a whole text, in lower case, but for those in ``passed``.

    Cutting at ASCII characters leaves few pieces that hold anything but letters; only these need the expression.
    """
    lower = (text or "").lower().encode("utf-8", "surrogatepass")
    pieces = set(lower.translate(SPACED).decode("utf-8", "surrogatepass").split()) - passed
    words = set(filter(str.isalpha, pieces))
    if len(words) == len(pieces):
        return words
    return words.union(re.findall(WORD, " ".join(pieces - words))) - passed


def hashed_terms(text: str | None, bits: int = HASH_BITS) -> set[int]:
    """The hashes of the terms of a whole text, in lower case.

    Terms are the words (runs of letters), and the first letters of words together with how many
    different words begin so, in steps: insults come with many endings.
    """
    return terms_of(distinct_words(text), bits)


def terms_of(words: Set[str], bits: int = HASH_BITS) -> set[int]:
    """The hashes of the terms that these words make; those of a stem's steps go on from the stem's own."""
    stems = Counter(w[:k] for w in words for k in STEM_LETTERS if len(w) > k)
    shift = 32 - bits
    found = {zlib.crc32(w.encode()) >> shift for w in words}
    for stem, seen in stems.items():
        start = zlib.crc32(stem.encode())
        for n, step in STEP_NAMES:
            if n > seen:
                break
            found.add(zlib.crc32(step, start) >> shift)
    return found


class TermFinder:
    """Finds the terms of a model in texts; most words can make none of them, and are remembered as such.

    A word tells something if it is a term, or if one of its beginnings is, with any count. Counts
    need no other words, since all words with that beginning tell something as well.
    """

    def __init__(self, terms: Iterable[int], bits: int = HASH_BITS, most: int = QUIET_WORDS) -> None:
        self.at = {t: i for i, t in enumerate(terms)}
        self.bits, self.shift, self.most = bits, 32 - bits, most
        self.quiet: set[str] = set()
        # Another step after a stem changes the same bits of the checksum, whatever the stem (CRC is linear and
        # all steps are as long), so the hash of the first step tells whether any of them leads to a term.
        self.first = STEP_NAMES[0][1]
        changes = [(zlib.crc32(step) ^ zlib.crc32(self.first)) >> self.shift for _, step in STEP_NAMES]
        self.first_steps = {t ^ c for t in self.at for c in changes}

    def tells(self, word: str) -> bool:
        if zlib.crc32(word.encode()) >> self.shift in self.at:
            return True
        for k in STEM_LETTERS:
            if len(word) <= k:
                return False
            if zlib.crc32(self.first, zlib.crc32(word[:k].encode())) >> self.shift in self.first_steps:
                return True
        return False

    def held(self, text: str | None) -> list[int]:
        """The places of the terms that a whole text holds, in ascending order."""
        words = distinct_words(text, self.quiet)
        telling = set(filter(self.tells, words))
        fresh = [w for w in words - telling if len(w) <= QUIET_LETTERS]
        if len(self.quiet) + len(fresh) > self.most:
            self.quiet.clear()
        self.quiet.update(fresh[: self.most])
        return sorted(self.at[t] for t in terms_of(telling, self.bits) if t in self.at)


@dataclass(frozen=True)
class FactorModel:
    """``terms`` are sorted hashes; ``linear`` and ``factors`` have a row for each of them."""

    intercept: float
    terms: tuple[int, ...]
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, texts: Iterable[str | None], finder: TermFinder | None = None) -> pd.Series:
        """The scores of texts; ``finder`` is one for ``terms`` that has seen other texts of the task."""
        finder = finder or TermFinder(self.terms)

        def one(text: str | None) -> float:
            held = finder.held(text)
            vectors = self.factors[held]
            pairs = 0.5 * float((vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum())
            return self.intercept + float(self.linear[held].sum()) + pairs

        margin = np.clip(np.array([one(t) for t in texts], dtype=float), -500, 500)
        return pd.Series(1.0 / (1.0 + np.exp(-margin)))

    def score_batches(self, batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
        """The scores of a task's batches of texts, which share a finder."""
        finder = TermFinder(self.terms, most=0)
        for batch in batches:
            finder.most = max(finder.most, min(QUIET_WORDS, batch.nbytes // QUIET_BYTES))
            yield pa.array(self.scores((text.as_py() for text in batch), finder))


def _term_rows(labelled: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [np.sort(np.fromiter(hashed_terms(t), np.int64)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": terms})

    return labelled.mapInPandas(cut, "doc_id bigint, label double, terms array<bigint>")


def telling_terms(rows: DataFrame, most: int = MAX_TERMS, least: float = LEAST_RATIO) -> list[int]:
    """The terms whose presence differs most between the labels, by the log-likelihood ratio."""
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = total["n"] or 0, total["ones"] or 0.0
    if not n or ones in (0, n):
        return []
    both = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("with"), F.sum("label").alias("one")
    )
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    held, one = F.col("with"), F.col("one")
    ratio = 2 * (
        part(one, held * (ones / n))
        + part(held - one, held * (1 - ones / n))
        + part(ones - one, (n - held) * (ones / n))
        + part((n - ones) - (held - one), (n - held) * (1 - ones / n))
    )
    best = both.withColumn("ratio", ratio).where(F.col("ratio") >= least)
    chosen = best.orderBy(F.desc("ratio"), "term").limit(most).select("term").collect()
    return sorted(r["term"] for r in chosen)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = TRAINING_ROWS,
) -> FactorModel:
    """Choose terms and fit the machine to them.

    With one class only, or no term that tells the labels apart, every text gets the share of label
    1, or 0.5 without labelled rows.
    """
    known = training_rows(docs, labels, label_col, id_col, rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(known), "doc_id")
    cut = store(_term_rows(labelled).dropDuplicates(["doc_id"]), "terms")
    terms = telling_terms(cut)
    if not terms:
        share = cut.agg(F.avg("label")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return FactorModel(float(np.log(share / (1 - share))), (), np.zeros(0), np.zeros((0, FACTORS)))
    at = {t: i for i, t in enumerate(terms)}

    @F.udf(VectorUDT())
    def vector(held: list[int]) -> SparseVector:
        return SparseVector(len(at), [(at[t], 1.0) for t in held if t in at])

    vectors = store(cut.select("label", vector("terms").alias("features")), "vectors")
    machine = FMClassifier(
        labelCol="label", factorSize=FACTORS, maxIter=ITERATIONS, stepSize=STEP, regParam=PENALTY, seed=SEED
    ).fit(vectors)
    return FactorModel(
        float(machine.intercept), tuple(terms), machine.linear.toArray(), machine.factors.toArray()
    )


def score(docs: DataFrame, model: FactorModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` of every row; null and empty texts score as texts without terms.

    Whole texts are read whatever their length; rows are never moved or joined. Of a batch only the
    text at hand is a Python string.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from model.score_batches(batches)

    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scored(whole(text_col)).alias("score")
    )
