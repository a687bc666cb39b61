"""Exact Jaccard join of word n-grams, and the groups it makes.

Equal sets are one class. A set with too many shingles that no other text holds is similar to none and
goes no further. Similar sets of different classes differ in few shingles; so, if the space
of shingles is cut into more parts than that, some part of both is the same. Sets that share a part,
directly or through others, form a cluster. Inside a cluster the join is exact: lists of an inverted
index are sorted by the position of the shingle in its set, and blocks behind the last position that
allows enough overlap are skipped; the overlaps of a set follow from those of a highly similar set,
by the few shingles that differ.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwatch.llm.components import components
from weekwatch.llm.text import rows_that_stay, whole
from weekwatch.sources.scratch import store

# A cluster with more shingles is joined in pairs of blocks of about this size.
BLOCK_SHINGLES = 3_000_000
# So many sets' overlaps are kept to derive others from.
PIVOTS = 32
# A task that combines signatures holds about so many of them.
BUFFERED = 2_000_000
# Shingles are counted in at least so many ranges of their hashes (as a power of two), each of about so many.
RANGES_LOG, RANGE_SHINGLES = 6, 2_000_000
# A task names texts of about so many shingles at once.
NAMED_SHINGLES = 1_000_000
# So many classes are sent to the tasks to find their texts; beyond that, all texts are shuffled.
SENT_CLASSES = 1_000_000
# Bits of the names of parts and of members, at least. Equal names of different ones only add candidates, and there
# are more bits where there are more rows, so that chance leads to few of them.
PART_BITS, MEMBER_BITS = 48, 40
# A set has about so many parts (as a power of two).
PARTS_LOG = 7
# So many words' hashes are kept in a task, and an odd number that steps are taken by.
KNOWN_WORDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- shingles -----------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """The 64-bit hashes of words, as bytes; a task keeps those of the words it has met, of so many at most."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_digest(word)
        return found


def shingles(text: str | None, words: int, known: Words | None = None) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams.

    Only A-Z are lowered, and only ASCII white space parts words. With fewer words the whole
    sequence is one shingle; without words there is none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = Words() if known is None else known
    hashed = np.frombuffer(b"".join(map(known.__getitem__, parts)), np.uint64)
    take = min(words, len(parts))
    many = len(parts) - take + 1
    # Every word is scrambled with its place before the sum, so words in another order are another shingle.
    found = np.full(many, np.uint64(take), np.uint64)
    for at, step in enumerate(np.arange(1, take + 1, dtype=np.uint64) * STEP):
        found += _mixed(hashed[at : at + many] + step)
    found = np.sort(_mixed(found))
    return found[np.append(True, found[1:] != found[:-1])]


def parts_of(size: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """The ranges of sizes that a set is compared in, as ``(range, parts, most differences)``.

    A range spans one step of the similarity. A set is in the range of its size, and in the next
    one if that holds sizes it may be similar to. All sets of a range are cut into the same parts.
    """
    step = math.log(den / num) * 1.000001
    own = math.floor(math.log(size) / step)
    found = []
    for r in (own, own + 1):
        low, high = math.exp(r * step), math.exp((r + 1) * step)
        if r == own or size * den * 1.000001 >= num * low:
            differ = int(2 * high * (den - num) / (den + num) * 1.000001)
            parts, smallest = differ + 1, low * num / den
            # So many that even the smallest sets hardly ever have too few that are not empty.
            while parts < 3 * differ:
                empty = parts * math.exp(-smallest / parts)
                if parts - empty - 3 * math.sqrt(empty) > differ:
                    break
                parts += 1
            found.append((r, parts, differ))
    return tuple(found)


def signatures(
    tokens: np.ndarray, ranges: tuple[tuple[int, int, int], ...], bits: int = PART_BITS
) -> list[tuple[int, np.ndarray]]:
    """Per range of ``parts_of``, a hash for each part of the sorted set: of the part's number and shingles.

    If sets differ in at most ``d`` shingles, and one of them has more than ``d`` parts that are not
    empty, then such a part is the same in both. A set with fewer names its empty parts as well.
    """
    found = []
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(tokens), dtype=np.uint64)])
    for r, parts, differ in ranges:
        # A part is a run of the sorted shingles.
        part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        content = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        numbers = part[ends - 1]
        if len(numbers) <= differ:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), numbers)
            numbers = np.concatenate([numbers, empty])
            content = np.concatenate([content, np.zeros(len(empty), np.uint64)])
        place = _mixed(numbers * STEP + np.uint64(r + 1))
        found.append((r, _mixed(content + place) >> np.uint64(64 - bits)))
    return found


def set_name(tokens: np.ndarray) -> int:
    """The 64-bit hash of a sorted set, signed."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def member_names(node: int, ranges: tuple[tuple[int, int, int], ...], bits: int = MEMBER_BITS) -> np.ndarray:
    """What a set is called in each of its ranges."""
    of = np.array([node + 2**63], np.uint64) + np.array([r + 1 for r, _, _ in ranges], np.uint64) * STEP
    return (_mixed(of) >> np.uint64(64 - bits)).astype(np.int64)


def name_bits(rows: int) -> tuple[int, int]:
    """The bits of the names of parts and of members, for so many sets."""
    log = math.log2(max(rows, 1))
    return (
        min(64, max(PART_BITS, math.ceil(2 * (log + PARTS_LOG)) - 2)),
        min(64, max(MEMBER_BITS, math.ceil(2 * (log + 1)) + 2)),
    )


class Ranges(dict):
    """The ranges of each size that comes up, found once a task."""

    def __init__(self, num: int, den: int):
        super().__init__({0: ()})
        self.num, self.den = num, den

    def __missing__(self, size: int) -> tuple:
        self[size] = parts_of(size, self.num, self.den)
        return self[size]


def sketches(texts: DataFrame, words: int, num: int, den: int, member_bits: int) -> DataFrame:
    """Per row: ``size`` of its set, the hash ``node`` that names it, and its ``members``: its names
    in the ranges it is compared in, that of its own size first."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, known = Ranges(num, den), Words()
        for batch in batches:
            sizes, nodes, members = [], [], []
            for text in batch["text"]:
                tokens = shingles(text, words, known)
                sizes.append(len(tokens))
                nodes.append(set_name(tokens))
                members.append(member_names(nodes[-1], ranges[len(tokens)], member_bits))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "th": batch["th"], "size": sizes, "node": nodes, "members": members}
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, th bigint, size bigint, node bigint, members array<bigint>"
    return texts.mapInPandas(sketch, schema)


# ---- shingles that no other text holds ----------------------------------------------------------


def range_bits(chars: int) -> int:
    """The leading bits that a range of shingles has in common, for texts of so many bytes."""
    return min(24, max(RANGES_LOG, math.ceil(math.log2(max(chars, 1) / 8 / RANGE_SHINGLES))))


def _runs(places: np.ndarray) -> bytes:
    """Ascending places, as bits: for each place as many ones as it comes up, and a zero."""
    counts = np.bincount(places)
    bits = np.ones(len(places) + len(counts), np.uint8)
    bits[np.cumsum(counts) + np.arange(len(counts))] = 0
    return np.packbits(bits).tobytes()


def _places(runs: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(runs, np.uint8))
    return np.cumsum(bits == 0)[bits == 1]


def lone_shingles(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """``node, lone``: how many shingles of a set no other row of ``texts`` holds, where there are any.

    Shingles that differ may be taken for one by chance, so ``lone`` may be too small, never too large. A task
    names a number of texts at once by their places, and sends for each range of hashes 32 bits of each shingle
    and the places; of one that several of these texts hold only the 32 bits, once. Back come the places of those
    that are alone. A text whose range is lost or comes twice after a retry counts less, which is no error either.
    """

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(held: list[np.ndarray]) -> pd.DataFrame:
            tokens = np.concatenate(held)
            nodes = np.array([set_name(s) for s in held], np.int64).tobytes()
            buffer = xxhash.xxh3_64_intdigest(nodes) - 2**63
            place = np.repeat(np.arange(len(held), dtype=np.int32), [len(s) for s in held])
            order = np.argsort(tokens)
            first = np.append(True, tokens[order[1:]] != tokens[order[:-1]])
            once = first & np.append(first[1:], True)
            several = tokens[order[first & ~once]]
            alone = np.sort(order[once])
            tokens, place = tokens[alone], place[alone]
            # In each range the shingles stay in the order of the texts.
            number = (tokens >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(number, kind="stable")
            short, place = (tokens[order] << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), place[order]
            ends = np.searchsorted(number[order], np.arange(2**bits + 1))
            short_several = (several << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
            ends_several = np.searchsorted(several >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
            found = []
            for k in range(2**bits):
                a, b = slice(ends[k], ends[k + 1]), slice(ends_several[k], ends_several[k + 1])
                if a.stop > a.start or b.stop > b.start:
                    found.append((k, buffer, short[a].tobytes() + short_several[b].tobytes(), _runs(place[a]), None))
            found.append((buffer % 2**bits, buffer, None, None, nodes))
            return pd.DataFrame(found, columns=["number", "buffer", "cells", "runs", "nodes"])

        known = Words()
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                tokens = shingles(text, words, known)
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                if size >= NAMED_SHINGLES:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        named = rows["nodes"].notna()
        sent = rows[~named]
        if len(sent):
            parts = [np.frombuffer(x, np.uint32) for x in sent["cells"]]
            every = np.concatenate(parts)
            order = np.argsort(every)
            first = np.append(True, every[order[1:]] != every[order[:-1]])
            once = np.empty(len(every), bool)
            once[order] = first & np.append(first[1:], True)
            ends = np.cumsum([len(x) for x in parts])
            found = []
            for runs, start in zip(sent["runs"], ends - [len(x) for x in parts], strict=True):
                places = _places(runs)
                found.append(_runs(places[once[start : start + len(places)]]))
            sent = sent.assign(runs=found)
        return pd.concat([sent, rows[named]])[["buffer", "runs", "nodes"]]

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.frombuffer(next(iter(rows["nodes"].dropna()), b""), np.int64)
        lone = np.zeros(len(nodes), np.int64)
        for runs in rows["runs"].dropna() if len(nodes) else ():
            lone += np.bincount(_places(runs), minlength=len(nodes))
        return pd.DataFrame({"node": nodes[lone > 0], "lone": lone[lone > 0]})

    sent = texts.select("text").mapInPandas(cells, "number int, buffer bigint, cells binary, runs binary, nodes binary")
    found = sent.groupBy("number").applyInPandas(alone, "buffer bigint, runs binary, nodes binary")
    return found.groupBy("buffer").applyInPandas(added, "node bigint, lone bigint")


# ---- clusters of sets that may be similar -------------------------------------------------------


def candidate_links(
    texts: DataFrame, words: int, num: int, den: int, part_bits: int, member_bits: int
) -> DataFrame:
    """``u, v``: links that connect all sets which share a signature, as members of a range.

    Signatures are made here from the texts and not stored, as they are many. Each task links its own
    members of a signature to the smallest of them, and of the signature only that one is shuffled; so
    one that a third of all sets share reaches the shuffle once a task. Then the smallest members of a
    signature are linked likewise.
    """

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            part, member = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((member, part))
            part, member = part[order], member[order]
            first = np.append(True, part[1:] != part[:-1])
            hub = member[np.flatnonzero(first)][np.cumsum(first) - 1]
            more = ~first & (member != hub)
            pairs = np.unique(np.stack([member[more], hub[more]], axis=1), axis=0)
            n = int(first.sum())
            # Names are 64 bits long, so missing ones must not turn them into floats.
            missing = np.arange(n + len(pairs)) < n
            return pd.DataFrame(
                {
                    # A link goes along under any name that spreads the links; it has its hub.
                    "part": np.append(part[first], pairs[:, 0] ^ pairs[:, 1]),
                    "u": np.append(member[first], pairs[:, 0]),
                    "v": pd.arrays.IntegerArray(np.append(np.zeros(n, np.int64), pairs[:, 1]), missing),
                }
            )

        ranges, known = Ranges(num, den), Words()
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                tokens = shingles(text, words, known)
                if not len(tokens):
                    continue
                of = ranges[len(tokens)]
                names = member_names(set_name(tokens), of, member_bits)
                for member, (_, hashes) in zip(names, signatures(tokens, of, part_bits), strict=True):
                    held.append((hashes.astype(np.int64), np.full(len(hashes), member, np.int64)))
                    size += len(hashes)
                if size >= BUFFERED:
                    yield rows(held)
                    held, size = [], 0
        if size:
            yield rows(held)

    combined = texts.select("text").mapInPandas(combine, "part bigint, u bigint, v bigint")
    # Links and signatures pass one shuffle together, so the texts are read and cut once.
    hub = F.min(F.when(F.col("v").isNull(), F.col("u"))).over(Window.partitionBy("part"))
    return combined.select("u", F.coalesce("v", hub).alias("v")).where("u > v")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of several ranges, one after another."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def similar_sets(sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, those others whose Jaccard similarity to it is at least ``num / den``. Exact.

    Shingles are ordered from rare to frequent, and a set is listed under its first ones, so many
    that similar sets share one. The lists are sorted by position. A set without candidates there
    has no answer; one close to a set already answered takes over its overlaps, less the lists of
    the shingles it lacks and plus those of the ones it has besides; others read all their lists.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(tokens, minlength=len(vocabulary))
    # Number the shingles by frequency.
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((np.arange(len(held)), held))] = np.arange(len(held))
    held = np.sort(held)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((rank[tokens], owner))
    tokens = rank[tokens][order]
    starts = np.cumsum(sizes) - sizes
    position = np.arange(len(tokens)) - np.repeat(starts, sizes)
    lists, list_ends = owner[np.argsort(tokens, kind="stable")], np.cumsum(held)

    prefix = sizes - -(-num * sizes // den) + 1
    listed = (position < np.repeat(prefix, sizes)) & (held[tokens] > 1)
    span = int(sizes.max()) + 1
    keys = tokens[listed] * span + position[listed]
    by_key = np.argsort(keys, kind="stable")
    keys, key_owner = keys[by_key], owner[listed][by_key]

    def candidates(x: int, first: np.ndarray) -> np.ndarray:
        # A similar set has at most n * den / num shingles, and shares at least n * num / den of them.
        last = int(sizes[x] * den / num - sizes[x] * num / den) + 1
        at = np.searchsorted(keys, first * span)
        return key_owner[_ranges(at, np.searchsorted(keys, first * span + min(last, span - 1), side="right"))]

    def overlaps(of: np.ndarray) -> np.ndarray:
        of = of[held[of] > 1]  # a shingle of one set only never adds to an overlap
        return np.bincount(lists[_ranges(list_ends[of] - held[of], list_ends[of])], minlength=len(sets))

    pivots: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=PIVOTS)
    for x, start in enumerate(starts):
        own = tokens[start : start + sizes[x]]
        differ = [len(p) + len(own) - 2 * both[x] for p, both in pivots]
        if differ and 2 * min(differ) < len(own):
            near, overlap = pivots[int(np.argmin(differ))]
            gone = np.setdiff1d(near, own, assume_unique=True)
            new = np.setdiff1d(own, near, assume_unique=True)
            both = overlap - overlaps(gone) + overlaps(new)
        elif (candidates(x, own[: prefix[x]]) != x).any():
            both = overlaps(own)
            pivots.append((own, both))
        else:
            yield x, np.zeros(0, np.int64)
            continue
        alike = np.flatnonzero(den * both >= num * (sizes[x] + sizes - both))
        yield x, alike[alike != x]


FOUND = "u bigint, v bigint, links bigint"


def cluster_links(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The links inside clusters: ``u, v`` that connect what is similar, and ``u, links`` counts.

    ``members`` has ``component, i, j, part, own, node, copies, text``: the cluster, the pair of
    blocks, the member's own block, and whether the range is that of its size. A pair of blocks
    gives the links across them; a block with itself those inside. Two sets of a lower range meet
    there, and are passed over here.
    """

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        known = Words()
        sets = [shingles(t, words, known) for t in rows["text"]]
        nodes, parts, own, copies = (rows[c].to_numpy() for c in ("node", "part", "own", "copies"))
        across = rows["i"].iloc[0] != rows["j"].iloc[0]
        root = list(range(len(sets)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        joined, counted = [], []
        for x, alike in similar_sets(sets, num, den):
            if across:
                alike = alike[parts[alike] != parts[x]]
            if not own[x]:
                alike = alike[own[alike]]
            if len(alike):
                counted.append((nodes[x], int(copies[alike].sum())))
            for y in alike[alike < x].tolist():
                if top(x) != top(y):
                    root[top(x)] = top(y)
                    joined.append((nodes[x], nodes[y]))
        counts, links = np.array(counted, np.int64).reshape(-1, 2), np.array(joined, np.int64).reshape(-1, 2)
        missing = np.arange(len(counts) + len(links)) < len(counts)
        return pd.DataFrame(
            {
                "u": np.append(counts[:, 0], links[:, 0]),
                "v": pd.arrays.IntegerArray(np.append(np.zeros(len(counts), np.int64), links[:, 1]), missing),
                "links": np.append(counts[:, 1], np.zeros(len(links), np.int64)),
            }
        )

    return members.groupBy("component", "i", "j").applyInPandas(link, FOUND)


# ---- the operator -------------------------------------------------------------------------------


def near_groups(
    docs: DataFrame,
    words: int = 5,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, kept, th`` of every row.

    Two rows link when the Jaccard similarity of their sets of word n-grams is at least
    ``num / den``; ``component_id`` is the smallest id reachable by links, itself included, and one
    row per component is ``kept``: that with the smallest id, null last. ``n_links`` counts linked
    rows, copies too. Null and empty texts have no shingles and link with nothing. Repeated rows
    are copies of one another, and all of those that share the kept id and text are marked. Other
    columns are not read. ``th`` is a hash of id and text that tells rows of one id apart.
    """
    text = whole(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("th"), text.alias("text"))
    rows, chars = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    part_bits, member_bits = name_bits(rows)
    sketch = store(sketches(texts, words, num, den, member_bits), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = sketch.where("size > 0").groupBy("node").agg(
        F.min(first).alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"),
        F.first("members").alias("members"),
    )
    classes = store(classes, "classes")
    # What similar sets share is at least num / den of either; copies share all.
    lone = lone_shingles(texts, words, range_bits(chars or 0)).groupBy("node").agg(F.max("lone").alias("lone"))
    near = classes.join(lone, "node", "left").where(F.coalesce("lone", F.lit(0)) * den <= F.col("size") * (den - num))
    near = store(near.select("node", "size", "copies", "members", "rep.th"), "near")
    held = store(_texts_of(texts, near), "held")
    clusters = components(candidate_links(held, words, num, den, part_bits, member_bits))
    found = store(_joined(held, near, clusters, words, num, den), "found")
    groups = components(found.where("v is not null").select("u", "v"))
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = (
        classes.select("node", "rep", "copies")
        .join(groups, "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    keeps = named.groupBy("component").agg(F.min("rep").alias("keep"))
    named = named.join(keeps, "component").select("node", "keep", "copies", "links")
    alone = F.col("keep").isNull()
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))
    return sketch.drop("members").join(named, "node", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        (alone | is_kept).alias("kept"),
        "th",
    )


def _texts_of(texts: DataFrame, near: DataFrame) -> DataFrame:
    """``node, text``: the text that stands for each class."""
    reps = near.select("node", "th")
    reps = F.broadcast(reps) if near.count() <= SENT_CLASSES else reps.hint("merge")
    return texts.join(reps, "th").dropDuplicates(["th"]).select("node", "text")


def _joined(held: DataFrame, near: DataFrame, clusters: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Bring the text of each clustered set to its cluster, or to its cluster's pairs of blocks."""
    members = near.select("node", "size", "copies", F.posexplode("members").alias("at", "member"))
    sized = (
        clusters.withColumnRenamed("node", "member")
        .join(members, "member")
        .select("component", "node", (F.col("at") == 0).alias("own"), "size", "copies")
    )
    sized = store(sized, "members")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    wanted = sized.join(blocks, "component").select(
        "component", "node", "own", "copies", "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = held.join(wanted, "node").select("component", "part", "own", "node", "copies", "text", other)
    return cluster_links(
        paired.select(
            "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
            "part", "own", "node", "copies", "text",
        ),
        words, num, den,
    )


def keep_one(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns; rows without words all stay.

    Rows repeated with the same id and text are one; of those with other columns the same one stays in every run.
    """
    groups = near_groups(docs, words, num, den, id_col, text_col)
    return rows_that_stay(docs, groups, {"doc_id": F.col(id_col), "th": F.xxhash64(F.col(id_col), whole(text_col))})
