"""WARC archives: written by Spark's writers, read back in byte ranges.

An archive is written as text whose rows are records and whose row end is the empty lines behind a
record, so the files are committed as any table is. It is read in lines that end in a line feed alone;
of these every byte belongs to exactly one, so the offset of a line is the sum of the lengths before it:
within its byte range by the task, before its range by a sum over ranges.

Any line of a payload may look like the start of a record. So a task can only say what would follow: for
each candidate start its successor, the offset behind the record. Pointers are doubled inside the range,
which leaves for each candidate the first offset outside; then ranges are passed by doubling over a table
of these pointers, from the start of each file. What is reached is a record; what is not was payload.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekwatch.sources.scratch import store

VERSION = "WARC/1.1"
END = "\r\n"
# Smaller payloads are stored wherever they occur.
LEAST_REVISIT = 1000
# Payloads that so many of all rows hold are broadcast, and all repeated ones while they are no more rows.
BROADCAST_ROWS = 500_000
# A header may be so long; one of a candidate that is longer is no header.
LONGEST_HEADER = 65_536
# Byte ranges are a few bytes each in a broadcast; beyond so many, larger ranges have to be set.
MOST_RANGES = 2_000_000

# A task hands on records when it has read so many bytes.
BATCH_BYTES = 8_000_000

MAGIC = re.compile(rb"WARC/1\.[01]\r\Z")
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*?)[ \t]*\r\Z", re.DOTALL)


# ---- writing --------------------------------------------------------------------------------------


def _hot_or_all(groups: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The part of ``groups`` to broadcast, bounded by ``most`` rows, and the rest if there is any."""
    found = groups.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if found["n"] <= most:
        return groups, None
    hot = F.col("rows") * most >= found["rows"]
    return groups.where(hot), groups.where(~hot)


def repeated_payloads(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``digest, top, rows`` of payloads with at least ``least`` bytes that several page ids hold."""
    held = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    # Distinct on the map side first, so copies of one payload reach the shuffle once a task and id.
    grouped = held.groupBy("digest").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count("*").alias("rows"), F.count("page_id").alias("named"))
    several = (F.col("top") > F.col("low")) | ((F.col("named") > 0) & (F.col("named") < F.col("rows")))
    return grouped.where(several).select("digest", "top", "rows")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def record(page_id: Column, url: Column, payload: Column, digest: Column, top: Column, date: str) -> Column:
    """The text of one record, without the empty lines behind it.

    A revisit has the headers of the response it stands for, with the full length, and no payload.
    """
    length = F.octet_length(payload).cast("string")
    name = lambda of: F.concat(F.lit("<urn:page:"), F.coalesce(of.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _field("Content-Length", length), F.lit(END)
    )
    # Control characters and spaces would end a field.
    target = F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")
    block = F.concat(http, F.when(top.isNull(), payload).otherwise(F.lit("")))
    return F.concat(
        F.lit(VERSION + END),
        F.when(top.isNull(), F.lit(f"WARC-Type: response{END}")).otherwise(
            F.concat(
                F.lit(f"WARC-Type: revisit{END}"),
                F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"),
                _field("WARC-Refers-To", name(top)),
            )
        ),
        _field("WARC-Record-ID", name(page_id)),
        F.lit(f"WARC-Date: {date}{END}"),
        F.when(target.isNull(), F.lit("")).otherwise(_field("WARC-Target-URI", target)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least: int = LEAST_REVISIT,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Write one record per row into new files under ``path``.

    Of rows with equal payloads of at least ``least`` bytes those with the largest id are responses, the
    others revisit them; a null id is smaller than any. Rows that repeat the largest id and the payload are
    a response each. A null payload is empty, a null url has no field. Payloads of any length and content
    are written as they are. Without rows there are no records. Columns besides the three are not read.

    Rows learn by a broadcast whether their payload repeats, while at most ``broadcast_rows`` payloads do;
    if more do, only the most frequent ones are broadcast (no more than that many can hold so large a part of the rows),
    and the rows meet the others by a shuffle.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    )
    repeated = store(repeated_payloads(rows, least), "repeated")
    hot, cold = _hot_or_all(repeated, broadcast_rows)
    rows = rows.withColumn("digest", F.sha1("payload"))
    known = rows.join(F.broadcast(hot.select("digest", F.col("top").alias("hot_top"))), "digest", "left")
    top = F.col("hot_top")
    if cold is not None:
        # Rows of hot payloads are spread at random: they match nothing here, by whatever key.
        key = F.when(top.isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot"), F.rand(7).cast("string")))
        named = cold.select(F.col("digest").alias("key"), F.col("top").alias("cold_top"))
        known = known.withColumn("key", key).join(named.hint("merge"), "key", "left")
        top = F.coalesce("hot_top", "cold_top")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < top), top)
    text = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), refers, date)
    known.select(text.alias("value")).write.option("lineSep", END * 2).text(path)


# ---- reading --------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, length, line`` of every line, in the order of the file within a byte range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("value").cast("binary").alias("line"),
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where a new byte range begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
            yield batch.slice(a, b - a)


def _field_of(line: bytes) -> tuple[str, str] | None:
    found = FIELD.match(line)
    return (found[1].decode("ascii").lower(), found[2].decode("utf-8", "replace")) if found else None


def successor(header: list[bytes], offset: int) -> int | None:
    """Where the record at ``offset`` ends, from its header lines up to the empty one; None if it says nothing."""
    fields = dict(f for f in map(_field_of, header[1:-1]) if f)
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return None
    return offset + sum(len(line) + 1 for line in header) + int(length) + len(END * 2)


SCAN = "file bigint, block bigint, length bigint, kind string, start bigint, next bigint, lines array<binary>"


def scan(lines: DataFrame) -> DataFrame:
    """What each byte range says of records: rows of ``SCAN``, offsets counted from its first line.

    ``size``: its bytes in ``next``. ``start``: a candidate and the first offset outside that following
    successors from it leads to, or -1 where they lead nowhere. ``open``: a candidate whose header goes
    on in the next range, with its lines so far. ``head``: header lines at its beginning, which an earlier
    range may need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, []

        def begin(new: tuple) -> None:
            nonlocal key, at, starts, nexts, header, begun, head, heading
            key, at, starts, nexts = new, 0, [], []
            header, begun, head, heading = None, 0, [], True

        at, starts, nexts, header, begun, head, heading = 0, [], [], None, 0, [], True

        def end() -> list[tuple]:
            where = np.array(starts, np.int64)
            to = np.array(nexts, np.int64)
            # Double the pointers until all lead outside or nowhere.
            while len(where):
                index = np.searchsorted(where, to)
                hit = (to >= 0) & (to < at)
                ok = hit & (where[np.minimum(index, len(where) - 1)] == to)
                if header is not None:
                    ok &= to != begun
                lost = hit & ~ok & ~((to == begun) & (header is not None))
                to = np.where(lost, -1, np.where(ok, to[np.minimum(index, len(where) - 1)], to))
                if not ok.any():
                    break
            rows = [(*key, "size", 0, at, None)]
            rows += [(*key, "start", int(s), int(t), None) for s, t in zip(where, to, strict=True)]
            if header is not None:
                rows.append((*key, "open", begun, -1, header))
            if head:
                rows.append((*key, "head", 0, -1, head))
            return rows

        def line_at(line: bytes) -> None:
            nonlocal header, begun, heading
            if heading:
                if (FIELD.match(line) or line == b"\r") and sum(map(len, head)) + len(line) <= LONGEST_HEADER:
                    head.append(line)
                    heading = line != b"\r"
                else:
                    heading = False
            if MAGIC.match(line):
                header, begun = [line], at
            elif header is not None:
                header.append(line)
                if line == b"\r":
                    to = successor(header, begun)
                    if to is not None:
                        starts.append(begun)
                        nexts.append(to)
                    header = None
                elif not FIELD.match(line) or sum(map(len, header)) > LONGEST_HEADER:
                    header = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
            names = ["file", "block", "length", "kind", "start", "next", "lines"]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in _ranges(batches):
            new = tuple(batch.column(c)[0].as_py() for c in ("file", "block", "length"))
            if new != key:
                if key is not None:
                    out += end()
                begin(new)
            column = batch.column("line")
            ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64) + 1) + at
            marks = np.flatnonzero(pc.starts_with(column.cast(pa.large_binary()), pattern=b"WARC/1.").to_numpy(zero_copy_only=False))
            row, size = 0, len(column)
            while row < size:
                if not heading and header is None:  # nothing to follow before the next mark
                    index = np.searchsorted(marks, row)
                    if index == len(marks):
                        break
                    row = int(marks[index])
                at = int(ends[row - 1]) if row else int(ends[0]) - len(column[0].as_py()) - 1
                line_at(column[row].as_py())
                row += 1
            at = int(ends[-1])
            if len(out) > 10_000:
                yield table(out)
                out = []
        if key is not None:
            out += end()
        if out:
            yield table(out)

    return lines.mapInArrow(run, SCAN)


def _offsets(found: DataFrame) -> DataFrame:
    """``file, block, length, size, base``: where the first line of each byte range begins in its file."""
    sizes = found.where("kind = 'size'").select("file", "block", "length", F.col("next").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))


def _split_headers(found: DataFrame) -> DataFrame:
    """Candidates whose header lies in several ranges: ``file, block, start, next``, ``next`` from ``start``."""

    def join(rows):
        import pandas as pd

        rows = rows.sort_values("block", kind="stable")
        out, pending = [], []
        for block, part in rows.groupby("block", sort=True):
            heads = [list(x) for x in part.loc[part["kind"] == "head", "lines"]]
            rank = int(part["rank"].iloc[0])
            still = []
            for owner, start, header, last in pending:
                if heads and last + 1 == rank:
                    header = header + heads[0]
                    if header[-1] == b"\r":
                        to = successor(header, 0)
                        if to is not None:
                            out.append((rows["file"].iloc[0], owner, start, to))
                    elif sum(map(len, header)) <= LONGEST_HEADER and bool(part["all_head"].iloc[0]):
                        still.append((owner, start, header, rank))
            pending = still
            for _, r in part[part["kind"] == "open"].iterrows():
                pending.append((block, int(r["start"]), list(r["lines"]), rank))
        return pd.DataFrame(out, columns=["file", "block", "start", "next"]).astype("int64")

    ranked = found.where("kind = 'size'").select(
        "file", "block", F.col("next").alias("bytes"), F.row_number().over(Window.partitionBy("file").orderBy("block")).alias("rank")
    )
    parts = found.where("kind in ('open', 'head')").join(ranked, ["file", "block"])
    held = F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, line: n + F.octet_length(line) + 1)
    parts = parts.withColumn("all_head", held >= F.col("bytes"))
    # A head matters only where the range before it leaves a header open, or is nothing but header lines.
    before = parts.where("kind = 'open' or all_head").select("file", (F.col("rank") + 1).alias("rank")).distinct()
    heads = parts.where("kind = 'head'").join(before, ["file", "rank"], "left_semi")
    wanted = parts.where("kind = 'open'").unionByName(heads)
    return wanted.groupBy("file").applyInPandas(join, "file bigint, block bigint, start bigint, next bigint")


def entries(found: DataFrame, strict: bool = True) -> DataFrame:
    """``file, block, length, base, entry, next`` of each byte range, found by pointer doubling.

    Offsets are those of the file. ``entry`` is the first record that begins in the range, null where none
    does, and ``next`` the first of a later range, or the end of the file; null behind a break of the chain.
    With ``strict`` a file whose chain of records does not end where the file ends is an error.
    """
    bases = store(_offsets(found), "ranges")
    split = _split_headers(found).withColumn("next", F.col("start") + F.col("next"))
    whole = found.where("kind = 'start'").select("file", "block", "start", "next")
    based = whole.union(split).join(bases.select("file", "block", "base"), ["file", "block"])
    to = F.when(F.col("next") < 0, -1).otherwise(F.col("next") + F.col("base"))
    pointers = based.select("file", "block", (F.col("start") + F.col("base")).alias("start"), to.alias("next"))
    pointers = store(pointers, "pointers")
    # Only what some pointer leads to can be the first record of its range, and the start of the file.
    led = pointers.where("next > 0").select("file", F.col("next").alias("start")).distinct()
    nodes = pointers.join(led, ["file", "start"], "left_semi").union(pointers.where("start = 0").select("file", "start", "block", "next"))
    nodes = store(nodes.distinct(), "nodes")
    reached = nodes.where("start = 0").select("file", "start")
    jump, jumps = nodes.select("file", "start", "next"), 1
    # A range holds two nodes at most on the way: its first record, and one whose header it does not end.
    most = 2 * (bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0)
    while jumps < most:
        ahead = reached.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = store(reached.union(ahead.where("start > 0")).distinct(), "reached")
        jumps *= 2
        if jumps < most:
            via = jump.select("file", F.col("start").alias("via"), F.col("next").alias("end"))
            further = jump.withColumnRenamed("next", "via").join(via, ["file", "via"])
            jump = store(further.select("file", "start", F.col("end").alias("next")), "jumps")
    chain = nodes.join(reached, ["file", "start"], "left_semi")
    firsts = chain.groupBy("file", "block").agg(F.min("start").alias("entry"))
    ends = bases.groupBy("file").agg(F.sum("size").alias("size"))
    last = chain.groupBy("file").agg(F.max("next").alias("last"))
    complete = store(ends.join(last, "file", "left").withColumn("ok", F.coalesce(F.col("last") == F.col("size"), F.lit(False))), "chains")
    if strict and (broken := complete.where("not ok").count()):
        raise ValueError(f"the chain of records does not end with the file in {broken} files")
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    ended = F.when(F.col("ok"), F.col("size"))
    return (
        bases.drop("size").join(firsts, ["file", "block"], "left").join(complete, "file")
        .withColumn("next", F.coalesce(F.min("entry").over(later), ended))
        .select("file", "block", "length", "base", "entry", "next")
    )


RECORDS = "file bigint, offset bigint, headers map<string,string>, http string, payload binary"
PIECES = "file bigint, next bigint, at bigint, bytes binary"
RECORD_KINDS = [pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
PIECE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [column.split()[0] for column in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def parse_records(data: bytes, at: int) -> tuple[list[tuple], bytes | None]:
    """The complete records at the front of ``data``, which lies at offset ``at``, and what is left.

    None is left where something other than a record follows. The block of a record with an HTTP head
    is parted into that head and the payload.
    """
    out, start = [], 0
    while start < len(data):
        stop = data.find(b"\r\n\r\n", start)
        if stop < 0:
            return out, data[start:]
        header = data[start : stop + 2].split(b"\n")[:-1]
        length = successor([*header, b"\r"], 0)
        if not MAGIC.match(header[0]) or length is None:
            return out, None
        if start + length > len(data):
            return out, data[start:]
        fields = dict(f for f in map(_field_of, header[1:]) if f)
        payload, http = data[stop + 4 : start + length - 4], None
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = payload.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        out.append((at + start, list(fields.items()), http, payload))
        start += length
    return out, b""


def _cut(lines: DataFrame, ranges: DataFrame, pieces: bool) -> DataFrame:
    """The records that lie in one byte range, or the ``pieces`` of those that lie in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, at, skip, behind, out, size = None, b"", 0, None, None, [], 0
        kinds, schema = (PIECE_KINDS, PIECES) if pieces else (RECORD_KINDS, RECORDS)
        for batch in _ranges(batches):
            new = tuple(batch.column(c)[0].as_py() for c in ("file", "block"))
            if new != key:
                if pieces and rest and behind is not None:
                    out.append((key[0], behind, at, rest))
                at, entry, behind = (batch.column(c)[0].as_py() for c in ("base", "entry", "next"))
                key, rest, skip = new, b"", None if entry is None else entry - at
            data = b"\n".join(batch.column("line").to_pylist()) + b"\n"
            size += len(data)
            if skip is None or skip:  # the front of the range is the end, or the middle, of a record from before
                piece = data if skip is None else data[:skip]
                data = data[len(piece) :]
                to = behind if skip is None else at + skip
                if pieces and to is not None:
                    out.append((key[0], to, at, piece))
                at += len(piece)
                skip = None if skip is None else skip - len(piece)
            if data and rest is not None:
                data = rest + data
                found, rest = parse_records(data, at)
                at += len(data) - len(rest or b"")
                if not pieces:
                    out += [(key[0], *r) for r in found]
            if out and size > BATCH_BYTES:
                yield _batch(out, kinds, schema)
                out, size = [], 0
        if pieces and rest and behind is not None:
            out.append((key[0], behind, at, rest))
        if out:
            yield _batch(out, kinds, schema)

    changed = F.raise_error(F.lit("byte ranges changed between two scans: set spark.sql.files.minPartitionNum"))
    found = lines.join(F.broadcast(ranges), ["file", "block", "length"], "left")
    base = F.coalesce("base", changed.cast("bigint")).alias("base")
    return found.select("file", "block", "line", base, "entry", "next").mapInArrow(run, PIECES if pieces else RECORDS)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces, which meet by the offset behind the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, end, parts in zip(*(batch.column(c).to_pylist() for c in ("file", "next", "parts")), strict=True):
                data = b"".join(p["bytes"] for p in parts)
                found, _ = parse_records(data, end - len(data))
                rows += [(file, *r) for r in found]
            if rows:
                yield _batch(rows, RECORD_KINDS, RECORDS)

    parts = F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts")
    return pieces.groupBy("file", "next").agg(parts).mapInArrow(run, RECORDS)


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``file, offset, headers, http, payload`` of every record of the archives under ``path``.

    ``file`` is a hash of the file's path, ``headers`` the record's fields under lower-case names, ``http`` the
    HTTP head where the block has one, ``payload`` the rest of the block. Archives are not compressed.
    Files may be of any length and records lie in any number of byte ranges; one record is held by one task.
    Folders without records give no rows. A file whose records do not lead to its end is an error, or with
    ``strict`` off gives the records before the break. Record starts inside payloads are not records.
    """
    lines = _lines(spark, path)
    ranges = store(entries(store(scan(lines), "scanned"), strict), "entries")
    if (n := ranges.count()) > MOST_RANGES:
        raise ValueError(f"{n} byte ranges: raise spark.sql.files.maxPartitionBytes")
    return _cut(lines, ranges, False).union(_joined(_cut(lines, ranges, True)))


def page_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from records as ``write_warc`` made them.

    What a response holds is measured on its payload; a revisit states the length and digest of its own.
    """
    field = lambda name: F.element_at("headers", name)
    page = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(.*):[0-9a-f]*>$", 1), F.lit("")).cast(id_type)
    revisit = field("warc-type") == "revisit"
    stated = F.regexp_extract("http", r"(?i)\r\ncontent-length: (\d+)", 1).cast("bigint")
    return records.select(
        page("warc-record-id").alias("page_id"),
        F.when(revisit, stated).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(field("warc-payload-digest"), "^sha1:(.*)$", 1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        field("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )
