"""Alignment of two tokenizers over the same bytes.

Texts are cut at single spaces between visible characters. There neither tokenizer has a token across
the cut: the byte-level one splits before such a space before it merges, and the vocabulary of the other
has no piece with a space behind another character, which is tested when it is loaded. So a text's tokens
are those of its words one after another, and a task encodes a word once however often it occurs.

The token ends of many texts are then merged in lockstep: one state vector holds a pointer into the A
tokens and one into the B tokens of every text of the batch; each step compares the ends that all
pointers stand at, emits a link and a cut where they are equal, and moves the pointers that are behind.
Texts that are through leave the vector. Counts over the corpus and sums back to the rows are Spark
aggregates and joins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwatch.llm.text import whole
from weekwatch.sources.scratch import store

VOCABULARIES = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Texts are merged together until they have so many characters; a longer text comes alone.
BATCH_CHARS = 2_000_000
# A lane of the lockstep holds at most so many words, so that a long text does not outlast the others.
LANE_WORDS = 400
# A task remembers the tokens of so many words, then starts afresh.
REMEMBERED = 600_000
# New words are encoded in lines of so many.
LINE_WORDS = 500
# A pair with at least this part of all links is broadcast; there can be no more of them than this.
HOT_PAIRS = 1 << 17

CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


# ---- the lockstep ---------------------------------------------------------------------------------


def lockstep(ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of A and B tokens that end together, lane by lane.

    ``ends_*`` are the byte offsets at which tokens end, of one lane after another; ``starts_*`` say
    where each lane begins, and where the last one ends. Both sides of a lane cover the same bytes.
    """
    at_a, at_b, stop = starts_a[:-1].copy(), starts_b[:-1].copy(), starts_a[1:]
    live = at_a < stop
    at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at_a):
        behind = ends_a[at_a] - ends_b[at_b]
        cut = behind == 0
        found_a.append(at_a[cut])
        found_b.append(at_b[cut])
        at_a = at_a + (behind <= 0)
        at_b = at_b + (behind >= 0)
        live = at_a < stop
        if not live.all():
            at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of several ranges, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


# ---- words and their tokens -----------------------------------------------------------------------


def byte_of_char() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves; the other bytes follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece of the B vocabulary."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_MARK, " ").encode()


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """The tokens that both vocabularies give for words, each encoded once."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share a machine's cores already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        back = byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            known = all(c in back for c in entry)
            self.bytes_a[number] = bytes(back[c] for c in entry) if known else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in pieces]
        # Whether no piece has a space behind another character, so that words can be cut apart.
        self.separable = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.texts = [f"{i}{end}".encode() for i in range(len(self.bytes_a)) for end in ",|"]
        self.base_b = len(self.texts)
        self.texts += [f"{i}{end}".encode() for i in range(len(self.bytes_b)) for end in ",;"]
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.sides = [(np.zeros(0, np.int32), np.zeros(1, np.int64)) for _ in "ab"]
        self.complete = np.zeros(0, bool)

    def cut(self, text: str) -> list[str]:
        return CUT.split(text) if self.separable else [text]

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The words of each text as numbers; those not known yet are encoded."""
        if len(self.number) > REMEMBERED:
            self.forget()
        out = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode new words. A word stands for a space and itself."""
        # A word with white space at an end, from an end of a text, cannot stand in a row with others.
        lines, line = [], []
        for word in new:
            if not self.separable or word[0].isspace() or word[-1].isspace():
                lines += [line, [word]] if line else [[word]]
                line = []
            else:
                line.append(word)
                if len(line) == LINE_WORDS:
                    lines.append(line)
                    line = []
        lines += [line] if line else []
        in_a = self.a.encode_batch_fast([" " + " ".join(line) for line in lines], add_special_tokens=False)
        in_b = self.b.encode([" ".join(line) for line in lines], num_threads=1)
        found: tuple[list, ...] = ([], [], [], [], [])
        for line, a, b in zip(lines, in_a, in_b, strict=True):
            for kind, part in zip(found, self._split(line, a.ids, b), strict=True):
                kind.append(part)
        ids_a, sizes_a, ids_b, sizes_b, complete = map(np.concatenate, found)
        self.sides = [
            (np.append(ids, more), np.append(ends, ends[-1] + np.cumsum(sizes)))
            for (ids, ends), more, sizes in zip(self.sides, (ids_a, ids_b), (sizes_a, sizes_b), strict=True)
        ]
        self.complete = np.append(self.complete, complete)

    def _split(self, line: list[str], ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, ...]:
        """Ids and sizes on both sides, and which words both give back; from the tokens of words in a row."""
        raw = [f" {w}".encode() for w in line]
        joined = b"".join(raw)
        out = []
        for ids, names, lengths in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            if b"".join(map(names.__getitem__, ids)) != joined:
                if len(line) > 1:  # some word is not given back; find out which
                    return self._one_by_one(line)
                return (*(np.zeros(0, np.int32), np.zeros(1, np.int64)) * 2, np.zeros(1, bool))
            ids = np.array(ids, np.int32)
            stops = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(r) for r in raw])) + 1
            out += [ids, np.diff(stops, prepend=0)]
        return (*out, np.ones(len(line), bool))

    def _one_by_one(self, line: list[str]) -> tuple[np.ndarray, ...]:
        parts = [
            self._split([w], a.ids, b)
            for w, a, b in zip(
                line,
                self.a.encode_batch_fast([f" {w}" for w in line], add_special_tokens=False),
                self.b.encode(line, num_threads=1),
                strict=True,
            )
        ]
        return tuple(np.concatenate(kind) for kind in zip(*parts, strict=True))

    def of(self, words: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of the words one after another, and how many each word has."""
        ids, ends = self.sides[side]
        sizes = ends[words + 1] - ends[words]
        return ids[spread(ends[words], sizes)].astype(np.int64), sizes


@dataclass
class Aligned:
    """What one text's alignment comes to."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    digest: str = ""
    pairs: np.ndarray | tuple = ()
    times: np.ndarray | tuple = ()


def align(texts: list[str], words: Words) -> list[Aligned]:
    """Align both tokenizations of each text."""
    numbers = words.numbers([words.cut(t) if t else [] for t in texts])
    out = [Aligned() for _ in texts]
    kept = [k for k, n in enumerate(numbers) if len(n) and words.complete[n].all()]
    if not kept:
        return out
    lanes = [n[i : i + LANE_WORDS] for k in kept for n in [numbers[k]] for i in range(0, len(n), LANE_WORDS)]
    first_lane = np.cumsum([0] + [-(-len(numbers[k]) // LANE_WORDS) for k in kept])
    every = np.concatenate(lanes)
    lane_ends = np.cumsum([len(lane) for lane in lanes])

    def side(number: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, sizes = words.of(every, number)
        return tokens, np.cumsum(lengths[tokens]), np.append(0, np.cumsum(sizes)[lane_ends - 1])

    tokens_a, ends_a, starts_a = side(0, words.size_a)
    tokens_b, ends_b, starts_b = side(1, words.size_b)
    link_a, link_b = lockstep(ends_a, starts_a, ends_b, starts_b)

    # Groups in order: A ids, then B ids, each marked where its group ends.
    n_a, n_b = len(tokens_a), len(tokens_b)
    ends_group_a, ends_group_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    ends_group_a[link_a] = ends_group_b[link_b] = 1
    group_a, group_b = np.cumsum(ends_group_a) - ends_group_a, np.cumsum(ends_group_b) - ends_group_b
    line = np.empty(n_a + n_b, np.int64)
    line[np.arange(n_a) + np.append(0, link_b + 1)[group_a]] = 2 * tokens_a + ends_group_a
    line[np.arange(n_b) + (link_a + 1)[group_b]] = words.base_b + 2 * tokens_b + ends_group_b

    # Links of each text, equal ones counted.
    text_a, text_b = starts_a[first_lane], starts_b[first_lane]
    owner = np.searchsorted(text_a, link_a, side="right") - 1
    span = len(words.bytes_a) * len(words.bytes_b)
    keys, times = np.unique(owner * span + tokens_a[link_a] * len(words.bytes_b) + tokens_b[link_b], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(kept) + 1) * span)
    groups = np.bincount(owner, minlength=len(kept))
    for at, k in enumerate(kept):
        codes = line[text_a[at] + text_b[at] : text_a[at + 1] + text_b[at + 1]].tolist()
        rendered = b"".join(map(words.texts.__getitem__, codes))[:-1]
        low, high = cuts[at], cuts[at + 1]
        out[k] = Aligned(
            int(text_a[at + 1] - text_a[at]), int(text_b[at + 1] - text_b[at]), int(groups[at]),
            hashlib.sha256(rendered).hexdigest(), keys[low:high] - at * span, times[low:high],
        )
    return out


# ---- over a table ---------------------------------------------------------------------------------

COLUMNS = ("n_a", "n_b", "n_groups")


def encode(texts: DataFrame, vocabularies: str = VOCABULARIES) -> DataFrame:
    """Each row of ``row, doc_id, text`` aligned: counts, digest, and its links as ``pairs, times``.

    A pair is ``A id * size of the B vocabulary + B id``. Both vocabulary files are read by the driver and
    broadcast, a few MB whatever the corpus; the tasks need no such folder.
    """
    spark = texts.sparkSession
    files = spark.sparkContext.broadcast(tuple((Path(vocabularies) / f).read_bytes() for f in (A_FILE, B_FILE)))
    doc_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*files.value)

        def rows(ids: list[pa.RecordBatch], held: list[str]) -> pa.RecordBatch:
            aligned = align(held, words)
            whole_ids = pa.Table.from_batches(ids).combine_chunks()
            sizes = np.cumsum([0] + [len(a.pairs) for a in aligned]).astype(np.int32)
            listed = lambda name, kind: pa.ListArray.from_arrays(
                pa.array(sizes), pa.array(np.concatenate([np.asarray(getattr(a, name), kind) for a in aligned]))
            )
            columns = [c.combine_chunks() for c in whole_ids.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            columns += [pa.array([getattr(a, c) for a in aligned], pa.int64()) for c in COLUMNS]
            columns += [pa.array([a.digest for a in aligned]), listed("pairs", np.int64), listed("times", np.int64)]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *COLUMNS, "groups_sha256", "pairs", "times"])

        ids, held, size = [], [], 0
        for batch in batches:
            texts_in, start = batch.column("text").to_pylist(), 0
            pair = batch.select(["row", "doc_id"])
            for at, text in enumerate(texts_in):
                held.append(text)
                size += len(text) + 1
                if size >= BATCH_CHARS:
                    ids.append(pair.slice(start, at + 1 - start))
                    yield rows(ids, held)
                    ids, held, size, start = [], [], 0, at + 1
            if start < len(texts_in):
                ids.append(pair.slice(start))
        if held:
            yield rows(ids, held)

    schema = (
        f"row bigint, doc_id {doc_type}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
        "pairs array<bigint>, times array<bigint>"
    )
    return texts.select("row", "doc_id", "text").mapInArrow(run, schema)


def pair_counts(encoded: DataFrame, b_size: int) -> DataFrame:
    """``pair, count, best``: how many links hold a pair, and whether no pair of its B id has more."""
    each = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = each.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    counts = store(counts, "pairs")
    b_id = (F.col("pair") % b_size).alias("b_id")
    # One row per id of the B vocabulary, so its size bounds the broadcast.
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))
    named = counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")
    return named.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def cross_tokenizer(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabularies: str = VOCABULARIES,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A is the byte-level vocabulary over a space and the text, B the piece vocabulary over the text, before
    which it puts a space itself. Bytes where tokens of both end cut a text into groups, and the two tokens
    that end there are a link; so there are as many links as groups. ``n_best`` counts links whose pair is
    the most frequent one of its B id in the corpus, ties included; ``count_sum`` adds up the frequencies.
    Null and empty texts, and those that a side cannot give back byte by byte, have zeros and an empty
    digest. Rows may repeat, and ids be null or repeated: each row is counted by itself. An empty table gives
    no rows. Texts may be of any length. Columns of ``docs`` other than the two named are not read.

    Pairs that hold at least one of ``hot_pairs`` equal parts of all links are broadcast (there are at most
    ``hot_pairs``); the others, none of them frequent, are joined by a shuffle.
    """
    from sentencepiece import SentencePieceProcessor

    b_size = SentencePieceProcessor(model_file=str(Path(vocabularies) / B_FILE)).get_piece_size()
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    encoded = store(encode(texts.withColumn("row", F.monotonically_increasing_id()), vocabularies), "aligned")
    rated = store(pair_counts(encoded, b_size), "rated")
    total = rated.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * hot_pairs >= total
    each = encoded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    each = each.select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = (
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    hot = rated.where(frequent)
    often = each.join(F.broadcast(hot), "pair").groupBy("row").agg(*sums)
    seldom = each.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rated.where(~frequent), "pair")
    summed = often.union(seldom.groupBy("row").agg(*sums)).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return encoded.drop("pairs", "times").join(summed, "row", "left").select(
        "doc_id", *COLUMNS, F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )
