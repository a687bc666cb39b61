"""Find secrets through an inverted index of trigrams.

From each rule's regular expression follows a Boolean query: some clause of trigrams that every
match must hold, in lower case. Postings name the documents that hold a trigram; intersecting them
gives the candidates of a rule, which alone are searched with its expression. A rule whose matches
need no particular trigram is searched for in every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.text import whole
from weekwatch.sources.scratch import store


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """A pattern for an ASCII word in upper or lower case, letter by letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# The three kinds that are always reported, in the order of their digest.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}"),
)
# Public formats of keys and tokens.
EXTRA = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
)
RULES = BASE + EXTRA

# A class of at most so many letters is spelled out; more ways than this end the analysis of a rule.
MAX_CLASS = 8
MAX_WAYS = 128


# ---- from an expression to trigrams -------------------------------------------------------------


def _ways(parsed, ways: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Extend each way to match, a tuple of literal runs of which the last is open, by the next parts."""
    broken = lambda old: [(*w, "") for w in old]
    spelled = lambda old, letters: [(*w[:-1], w[-1] + c) for w in old for c in letters]
    for op, value in parsed:
        if op is sre.LITERAL:
            ways = spelled(ways, [chr(value).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= MAX_CLASS:
            ways = spelled(ways, sorted({chr(v).lower() for _, v in value}))
        elif op is sre.SUBPATTERN:
            ways = _ways(value[3], ways)
        elif op is sre.BRANCH:
            ways = [w for branch in value[1] for w in _ways(branch, ways)]
        elif op is sre.MAX_REPEAT:
            least, most, part = value
            once = _ways(part, ways) if most else ways
            if (least, most) == (0, 1):
                ways = ways + once
            elif least == most == 1:
                ways = once
            else:
                ways = broken(once if least else ways)
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            ways = broken(ways)
        ways = list(dict.fromkeys(ways))
        if len(ways) > MAX_WAYS:
            return [("",)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams, one of which every match holds whole; none if the text must be searched."""
    clauses = {
        frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2))
        for way in _ways(_parser.parse(pattern), [("",)])
    }
    if frozenset() in clauses:
        return []
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(least, key=sorted)


# ---- the index ----------------------------------------------------------------------------------


def postings(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``trigram, doc_id``: which documents hold which of the trigrams, in lower case; null where none.

    The outer form keeps Spark from testing first, with all trigrams over again, whether there are any.
    """
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(whole(text_col)).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", held.alias("held")).select("doc_id", F.explode_outer("held").alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``doc_id, kinds``: the rules whose trigram query a document meets.

    Documents that share an id are candidates together, which the search afterwards puts right.
    """
    terms = [
        (rule.kind, number, trigram, len(clause))
        for rule in rules
        for number, clause in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(clause)
    ]
    rows = F.array(
        *(
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(t).alias("trigram"), F.lit(n).alias("all"))
            for k, c, t, n in terms
        )
    )
    asked = index.sparkSession.range(1).select(F.inline(rows))
    # The terms are as many as the rules make them, whatever the data; so they are broadcast.
    return (
        index.join(F.broadcast(asked), "trigram")
        .groupBy("doc_id", "kind", "clause", "all")
        .agg(F.count_distinct("trigram").alias("met"))
        .where(F.col("met") == F.col("all"))
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


# ---- the search ---------------------------------------------------------------------------------


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The matches of a rule, leftmost and not overlapping, as ``(start, number, end, kind)``.

    What lies between the matches and the matches themselves add up to positions in code points.
    """
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["before"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        real = part["match"].isNotNull() & (F.length(part["value"]) >= rule.least)
        return F.struct(
            end.alias("at"), F.when(real, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    def advance(at: Column, part: Column) -> Column:
        return at + F.length(part["before"]) + F.coalesce(F.length(part["match"]), F.lit(0))

    def in_blocks(every: Column) -> Column:
        # A list that grows is copied as it grows. So blocks of about the root of their number are walked
        # one by one, each from where the ones before it end.
        root = F.ceil(F.sqrt(F.size(every))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.size(every) - 1, root), lambda i: F.slice(every, i + 1, root)
        )
        begun = F.aggregate(
            blocks, F.array(F.lit(0)),
            lambda ends, block: F.array_append(ends, F.aggregate(block, F.element_at(ends, -1), advance)),
        )
        walked = lambda pair: F.aggregate(
            pair["block"], F.struct(pair["at"].alias("at"), none.alias("spans")), step
        )["spans"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), F.slice(begun, 1, F.size(begun) - 1).alias("at")), walked))

    # A list of one, so that the parts are found once and bound to a name.
    found = F.transform(F.array(parts), in_blocks)[0]
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans``: every secret of every row, in order of start and rule.

    A span has ``start``, ``number`` of the rule, ``end`` (exclusive) and ``kind``, in code points.
    Null and empty texts hold none; one row comes out per row, repeated rows included. Null ids are
    one id for the index, which only adds candidates. Positions cover whole texts of any length.
    An empty table gives no rows, and other columns are not read.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted({t for clauses in queries.values() for clause in clauses for t in clause})
    found = store(candidates(postings(docs, trigrams, id_col, text_col), rules), "candidates") if trigrams else None
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    if found is None:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    else:
        # The stored table's size is known, so Spark broadcasts it only where it is small.
        of = found.select(F.col("doc_id").alias("of"), "kinds")
        rows = rows.join(of, rows["doc_id"].eqNullSafe(of["of"]), "left").select("doc_id", "text", "kinds")
    each = []
    for number, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, number)
        if queries[rule.kind]:
            none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        each.append(spans)
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def digest(found: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    kinds = {r.kind: n for n, r in enumerate(rules)}
    as_text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda numbers: F.filter("spans", lambda s: s["number"].isin(numbers))
    return found.select(
        "doc_id",
        *(F.size(of([kinds[r.kind]])).cast("bigint").alias(f"n_{r.kind}") for r in base),
        F.sha2(as_text(of([kinds[r.kind] for r in base])), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
