"""WARC archives: what is written is read, whatever the byte ranges and the payloads."""

import hashlib
import random

import pytest

from weekwatch.llm import warc
from weekwatch.llm.warc import page_records, read_warc, write_warc

NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def inner(payload: bytes, length: int | None = None) -> bytes:
    """What looks like a record."""
    size = len(payload) if length is None else length
    return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (size, payload)


def payloads():
    pick = random.Random(2)
    nested = inner(inner(b"deep")) + inner(b"after")
    out = [
        None, "", "short", "é" * 700, "x" * 1000, "x" * 999, "\r\n", "\r\n\r\n", "\n" * 30, "a\rb\r\rc\n\rd", "WARC/1.1", "WARC/1.1\r", "WARC/1.1\r\n",
        "WARC/1.1\r\nContent-Length: 3", "\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n", nested.decode(), inner(b"", 10**9).decode(),
        inner(b"", 5).decode() * 40, inner(b"x" * 40, 44).decode() * 30, "\n".join(f"field{i}: {i}\r" for i in range(60)) + "\n\r\n",
        "WARC/1.0\r\n" + "\n".join(f"f{i}: {i}\r" for i in range(80)) + "\nContent-Length: 7\r\n\r\n", "\x00\x01﻿", "long " * 60_000,
    ]
    for _ in range(60):
        parts = ["\r\n", "\n", "WARC/1.1\r\n", "Content-Length: 12\r\n", "\r\n\r\n", "text", "é", "Name: value\r\n"]
        out.append("".join(pick.choice(parts) for _ in range(pick.randint(0, 60))))
    return out


def expected(rows, least=1000):
    held = {}
    for page, html in rows:
        held.setdefault(html or "", []).append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        ids = [p for p in held[html or ""] if p is not None]
        top = max(ids) if ids else None
        revisit = len(data) >= least and top is not None and (page is None or page < top)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, rows, path, parts=2, **how):
    table = spark.createDataFrame([(p, f"http://a/{p} b\r\n", h, "x", 1) for p, h in rows], "page_id long, url string, html string, digest string, top int")
    write_warc(table.repartition(parts), path, **how)
    found = page_records(read_warc(spark, path))
    assert found.columns == list(NAMES)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture
def ranges(spark):
    """Byte ranges of a size."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


ROWS = [(n, h) for n, h in enumerate(payloads())]
ROWS += [(None, "x" * 1000), (400, "x" * 1000), (7, "x" * 1000), (400, "y" * 2000), (400, "y" * 2000), (3, "y" * 2000), (None, "z" * 1500), (None, "z" * 1500)]


@pytest.mark.parametrize("size", [134_217_728, 20_000])
def test_round_trip(spark, ranges, tmp_path, size):
    ranges(size)
    assert round_trip(spark, ROWS, str(tmp_path / "w")) == expected(ROWS)


def test_ranges_smaller_than_a_header(spark, ranges, tmp_path):
    ranges(150)
    rows = [row for row in ROWS[:22] if len(row[1] or "") < 5_000]
    assert round_trip(spark, rows, str(tmp_path / "w"), parts=1) == expected(rows)


def test_repeated_payloads_that_are_too_many_to_broadcast(spark, tmp_path):
    rows = [(n, f"{n % 5} " * 600) for n in range(60)] + [(n, "hot " * 400) for n in range(100, 160)] + [(999, "once " * 400)]
    assert round_trip(spark, rows, str(tmp_path / "w"), broadcast_rows=2) == expected(rows)


def test_bytes_of_the_records(spark, tmp_path):
    """The archive is what another reader expects: each header states the length of its block."""
    rows = [(1, "one"), (2, "a" * 1000), (3, "a" * 1000)]
    round_trip(spark, rows, str(tmp_path / "w"), parts=1)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    kinds = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        size = int(fields[b"Content-Length"])
        assert lines[0] == b"WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n"
        http, _, payload = rest[:size].partition(b"\r\n\r\n")
        kinds.append((fields[b"WARC-Type"], payload[:3], b"%20" in fields[b"WARC-Target-URI"]))
        assert http.startswith(b"HTTP/1.1 200 OK")
        data = rest[size + 4 :]
    assert sorted(kinds) == [(b"response", b"aaa", True), (b"response", b"one", True), (b"revisit", b"", True)]


def test_other_archives(spark, ranges, tmp_path):
    """Records of other kinds, without HTTP, and blocks that are not text."""
    block = bytes(range(256)) * 8
    (tmp_path / "a.warc").write_bytes(
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
        b"WARC/1.0\r\nwarc-type:resource\r\nContent-Type: image/png\r\nCONTENT-LENGTH:  2048 \r\n\r\n" + block + b"\r\n\r\n"
    )
    ranges(300)
    rows = read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["headers"]["warc-type"], r["http"], bytes(r["payload"])) for r in rows] == [("warcinfo", None, b"hello"), ("resource", None, block)]


@pytest.mark.parametrize("size", [134_217_728, 200])
def test_a_broken_chain_is_an_error(spark, ranges, tmp_path, size):
    ranges(size)
    good = b"".join(inner(b"x" * n) for n in (30, 40, 50))
    (tmp_path / "a.warc").write_bytes(good + inner(b"y" * 100, 90) + inner(b"z"))
    (tmp_path / "b.warc").write_bytes(good)
    with pytest.raises(ValueError, match="in 1 files"):
        read_warc(spark, str(tmp_path))
    assert sorted(len(r["payload"]) for r in read_warc(spark, str(tmp_path), strict=False).collect()) == [30, 30, 40, 40, 50, 50, 90]


def test_no_rows(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "w")) == []


def test_a_header_is_followed_to_its_end():
    header = [b"WARC/1.1\r", b"Content-Length: 5\r", b"\r"]
    assert warc.successor(header, 100) == 100 + 10 + 19 + 2 + 5 + 4
    assert warc.successor([b"WARC/1.1\r", b"Content-Length: x\r", b"\r"], 0) is None
