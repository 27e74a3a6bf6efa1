import gzip
import hashlib
import pathlib
import random
import zlib

from phaseloom.llm import warc
from phaseloom.llm.common import shared_dir


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        refers = first.get(b) if i is not None and first.get(b) not in (None, i) else None
        out.append((str(i) if i is not None else None, u, "response" if refers is None else "revisit", str(refers) if refers is not None else None, len(b), hashlib.sha256(b).hexdigest(), b if refers is None else None))
    return sorted(out, key=repr)


def test_round_trip_over_small_ranges(spark):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}\n%0A", "".join(rng.choices("abc<>é ", k=rng.choice([0, 50, 99, 100, 3000, 60000])))) for i in range(60)]
    rows += [(i + 100, None, rows[i % 7][2]) for i in range(20)] + [(None, "u", "n" * 200), (None, "u", "n" * 200), (7, "again", rows[7][2]), (999, "x", None)]
    path = shared_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    for size in ("700", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, path).collect()), key=repr)
        assert got == expected(rows)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for f in pathlib.Path(path.removeprefix("file:")).glob("part-*"):
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") > 0


def test_magic_numbers_inside_members(spark, tmp_path):
    """Stored (not compressed) blocks hold the magic bytes of the payload as they are."""
    out, want = b"", []
    for i in range(40):
        payload = (warc.MAGIC + bytes([i])) * (i * 7 % 23) + b"x" * (i * 37 % 400)
        block = warc.HTTP + payload
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        out += c.compress(head + block + b"\r\n\r\n") + c.flush()
        want.append((str(i), payload))
    (tmp_path / "a.warc").write_bytes(out)
    (tmp_path / "b.warc").write_bytes(b"")
    for size in ("97", "500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect())
        assert got == sorted(want)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_of_other_writers():
    text = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID:<urn:uuid:1>\r\nContent-Type: text/plain\r\ncontent-length: 4\r\n\r\na\r\n\r\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: abc\r\n\r\nx\r\n\r\n"
    assert [(r[0], r[2], r[6]) for r in warc.records(text + text + other + text)] == [("urn:uuid:1", "response", b"a\r\n\r")] * 2
    assert list(warc.records(b"")) == list(warc.records(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")) == []


def test_empty_table(spark):
    path = shared_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_members_over_several_ranges_and_plain_archives(spark, tmp_path):
    """Ranges smaller than members; one file is a single member of many records, one is no archive at all."""
    rng = random.Random(8)
    text = lambda i, n: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n".encode() + rng.randbytes(n) + b"\r\n\r\n"
    (tmp_path / "many.warc").write_bytes(b"".join(gzip.compress(text(i, rng.choice([10, 4000, 30_000]))) for i in range(30)))
    (tmp_path / "single.warc").write_bytes(gzip.compress(b"".join(text(100 + i, 2000) for i in range(20))))
    (tmp_path / "other.bin").write_bytes(gzip.compress(rng.randbytes(50_000)))
    for size in ("900", "7000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted(int(r.page_id) for r in warc.read_warc(spark, str(tmp_path)).collect())
        assert got == [*range(30), *range(100, 120)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
