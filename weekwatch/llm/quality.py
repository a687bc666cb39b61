"""Quality by a sparse ensemble of rules.

Trees are grown on statistics of the text; every path from a root to a node is a rule, a few
conditions that all hold. A logistic model with a lasso penalty keeps few of the rules, and those
become one column expression, so that scoring is a projection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.text import SPACE, held_out, whole
from weekwatch.sources.scratch import store

# At most so many labelled rows are fitted to: those whose ids have the smallest hashes.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 20, 3, 17
LASSO = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "words",
    "word_chars",
    "distinct_words",
    "capitals",
    "symbols",
    "digits",
    "bangs",
    "bars",
    "stops",
    "distinct_lines",
    "line_words",
)


@dataclass(frozen=True)
class Rule:
    """Conditions that all hold: a statistic at most, or above, a threshold."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        holds = F.lit(True)
        for name, above, threshold in self.conditions:
            holds = holds & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return F.when(holds, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, from the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column() * rule.weight
        return 1.0 / (1.0 + F.exp(-total))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one text; shares of nothing are 0, so an empty text is all zeros."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "[\n\r]+"), lambda line: line != "")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    marks = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    chars, n, n_lines = F.length(text), F.size(words), F.size(lines)
    return {
        "words": n.cast("double"),
        "word_chars": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "capitals": share(left(r"[^\p{Lu}]+"), chars),
        "symbols": share(left(r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()-]+"), chars),
        "digits": share(left(r"[^0-9]+"), chars),
        "bangs": share(marks("!"), n),
        "bars": share(marks("|"), n),
        "stops": share(marks("."), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "line_words": share(n, n_lines),
    }


def with_statistics(docs: DataFrame, text_col: str, *kept: Column) -> DataFrame:
    """The kept columns and the statistics; words and lines are cut once a row."""
    return docs.select(*kept, *(c.cast("double").alias(name) for name, c in statistics(whole(text_col)).items()))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    rows: int = TRAINING_ROWS,
) -> DataFrame:
    """``doc_id, label`` of the rows to learn from: labelled, not held out, at most ``rows``.

    Rows without an id or label are passed over; of several labels of a document the largest
    counts. The bound holds for the broadcast as well, since the smallest hashes are picked first.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def tree_rules(debug: str, names: tuple[str, ...]) -> set[Rule]:
    """The rules of a fitted forest, from its printed form: one for each node below a root."""
    rules, path = set(), []
    for line in debug.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth, above, name = len(found[1]), found[4] == ">", names[int(found[3])]
        path = [p for p in path if p[0] < depth] + [(depth, name, above, float(found[5]))]
        bounds: dict[tuple[str, bool], float] = {}
        for _, n, a, t in path:
            bounds[n, a] = (max if a else min)(t, bounds.get((n, a), t))
        rules.add(Rule(tuple(sorted((n, a, t) for (n, a), t in bounds.items()))))
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = TRAINING_ROWS,
) -> RuleModel:
    """Grow the trees, take their paths as rules, and weigh these by a logistic lasso.

    With one class only, or no labelled row, there are no rules and every text gets the share of
    label 1, or 0.5.
    """
    known = training_rows(docs, labels, label_col, id_col, rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(known), "doc_id")
    numbers = with_statistics(labelled, "text", F.col("doc_id"), F.col("label"))
    numbers = store(numbers.dropDuplicates(["doc_id"]), "statistics")
    found = numbers.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not found["n"] or found["ones"] in (0, found["n"]):
        share = min(max(found["ones"] / found["n"], 1e-6), 1 - 1e-6) if found["n"] else 0.5
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(numbers)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featureSubsetStrategy="onethird"
    ).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString, STATISTICS), key=lambda r: r.conditions)
    held = numbers.select("label", array_to_vector(F.array(*(r.column() for r in rules))).alias("features"))
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=LASSO, labelCol="label", standardization=False, maxIter=100
    ).fit(held)
    weighed = zip(rules, lasso.coefficients.toArray().tolist(), strict=True)
    return RuleModel(float(lasso.intercept), tuple(Rule(r.conditions, w) for r, w in weighed if w))


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score`` of every row: null and empty texts too, with all statistics 0.

    Rows are never moved or joined, so repeated rows and ids stay as they are. Texts of any length are
    measured whole, an empty table gives no rows, and other columns are not read.
    """
    numbers = with_statistics(docs, text_col, F.col(id_col).alias("doc_id"))
    return numbers.select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"))


def keep_good(
    docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    numbers = with_statistics(docs, text_col, F.struct("*").alias("doc"))
    return numbers.where(model.score() >= threshold).select("doc.*")
