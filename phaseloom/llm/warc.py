"""WARC archives: a writer with deduplicated payloads and a splittable reader.

Writer: each record is a gzip member of its own; members are separated by an empty member, so a file is a valid gzip
stream for any reader. Reader: Spark's line reader deals out byte ranges and cuts them at the gzip magic number; a task
owns the candidates that start inside its range. A candidate is a member if its header decodes and WARC headers follow;
magic bytes inside compressed data are joined again with the member they belong to, across ranges where need be.
Everything is read and written by Spark, so any of its file systems will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.llm.common import give_back, shared_dir, slices, spread_join, stored, table

#: Fixed by the gzip format: the first three bytes of a member, and an empty member.
MAGIC = b"\x1f\x8b\x08"
EMPTY = MAGIC + b"\x00\x00\x00\x00\x00\x00\x03\x03" + b"\x00" * 9
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
LOOSE = RECORD + ", file string, block long, seq long, starts boolean, fragment binary"
NAMES = [x.split()[0] for x in LOOSE.split(", ")]


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(page_id: str | None, url: str | None, digest: str, size: int, refers_to: str | None, payload: bytes | None) -> bytes:
    """One record as a gzip member; a revisit has no payload."""
    block = b"" if refers_to is not None else HTTP + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{_clean(page_id)}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{_clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _number(value: str | None, otherwise: int) -> int:
    return int(value) if value is not None and value.isascii() and value.isdigit() else otherwise


def records(unpacked: bytes) -> Iterator[tuple]:
    """Columns of RECORD for each whole WARC record of an unpacked member."""
    at = 0
    while unpacked[at : at + 7] == b"WARC/1.":
        blank = unpacked.find(b"\r\n\r\n", at)
        if blank < 0:
            return
        lines = [x.partition(":") for x in unpacked[at:blank].decode("utf-8", "replace").split("\r\n")[1:]]
        fields = {name.strip().lower(): value.strip() for name, colon, value in reversed(lines) if colon}
        size, at = _number(fields.get("content-length"), -1), blank + 4
        if size < 0 or len(unpacked) < at + size:
            return
        block, at = unpacked[at : at + size], at + size
        yield _columns(fields, block)
        while unpacked[at : at + 2] == b"\r\n":
            at += 2


def _columns(fields: dict[str, str], block: bytes) -> tuple:
    of = lambda name: _unclean(v.strip("<>").removeprefix("urn:page:")) if (v := fields.get(name)) is not None else None
    is_http = fields.get("content-type", "application/http" if block.startswith(b"HTTP/") else "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if is_http else block
    url, kind = fields.get("warc-target-uri"), fields.get("warc-type")
    size = _number(fields.get("x-payload-length"), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    return (of("warc-record-id"), None if url is None else _unclean(url), kind, of("warc-refers-to"), size, digest, None if kind == "revisit" else payload)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Write a record for each row of pages.

    Of equal payloads of at least `least` bytes, the row with the smallest id is a response and the others are revisits
    that refer to it; all other rows are responses. A null html is an empty payload. Rows with a null id are always
    responses, and so are rows that repeat both id and payload of one. Other columns are not read.
    """
    prep = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    prep = prep.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    seen = prep.filter(F.col("size") >= least).select("id", "digest")
    first = seen.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = spread_join(seen, first, ["digest"], F.col("id")).filter(F.col("id") != F.col("first")).distinct()
    rows = prep.join(again, ["id", "digest"], "left").select(F.col("id").cast("string"), "url", "digest", "size", F.col("first").cast("string").alias("first"), F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                out = [member(*(x[k] for k in ("id", "url", "digest", "size", "first", "payload"))) for x in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
        give_back()

    packed = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    packed.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class _Scan:
    """Turns the pieces of one byte range, in order, into records; what belongs to other ranges is kept as fragments."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.seq, self.whole = file, block, 0, True
        self.raw: list[bytes] = []
        self.text: list[bytes] = []
        self.unpack = None
        self.out: list[tuple] = []

    def fragment(self, raw: bytes, starts: bool = False) -> None:
        """starts: the bytes are known to begin a member."""
        self.out.append((*[None] * 7, self.file, self.block, self.seq, starts, raw))
        self.seq += 1

    def add(self, piece: bytes, head: bool) -> None:
        """piece: what follows a magic number; head: the bytes before the first magic of a file."""
        if head:
            return
        todo = [MAGIC + piece]
        while todo:
            raw = todo.pop(0)
            if self.unpack is None:
                self.unpack, self.raw, self.text = zlib.decompressobj(31), [], []
            if not self.feed(raw):  # no member starts with the first of these; one may with the others
                first, *rest = [*self.raw, raw]
                self.unpack = None
                if self.whole:
                    self.fragment(first)  # the rest of a member from the range before
                todo = rest + todo

    def feed(self, raw: bytes) -> bool:
        try:
            text = self.unpack.decompress(raw)
        except zlib.error:
            return False
        begun = b"".join([*self.text, text]) if sum(map(len, self.text)) < 7 else b"WARC/1."
        if begun[:7] != b"WARC/1."[: len(begun)]:
            return False
        self.raw.append(raw)
        self.text.append(text)
        if self.unpack.eof:
            for found in records(b"".join(self.text)):
                self.whole = False  # from here on, what does not decode belongs to no member
                self.out.append((*found, *[None] * 5))
            self.unpack = None
        return True

    def end(self) -> list[tuple]:
        if self.unpack is not None and self.raw:
            # the rest is in the ranges after
            if sum(map(len, self.text)) >= 7:
                self.fragment(b"".join(self.raw), True)
            else:
                for raw in self.raw:
                    self.fragment(raw)
        return self.out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=NAMES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the gzipped archives under path, with the columns of RECORD; payload is null for revisits.

    Members that are damaged or hold no WARC record are passed over, and so is the rest of a member from a record with a
    missing or malformed length on; a member may hold several records. Header names count in any case. Empty files give
    no rows. Nearly all records are whole within the pieces of one range. What lies across borders is written first, from a
    decoding of its own, and put together member by member: a task gets the fragments of one member, not of one file. Only
    a file that is one single member, which nothing can split, meets in one task. Names that end in .gz raise an error:
    Spark's line reader would unpack such files itself, each in one task; give them another name.
    """
    if [f for f in spark.read.format("binaryFile").load(path).inputFiles() if f.endswith(".gz")]:
        raise ValueError("names of archives must not end in .gz")
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, fresh = None, False
        for b in batches:
            rows: list[tuple] = []
            for piece, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if scan is None or (scan.file, scan.block) != (file, block):
                    if scan is not None:
                        rows += scan.end()
                    scan, fresh = _Scan(file, block), True
                scan.add(piece, fresh and block == 0)
                fresh = False
                if len(scan.out) > 500:
                    rows, scan.out = rows + scan.out, []
            if scan is not None:
                rows, scan.out = rows + scan.out, []
            for at in range(0, len(rows), 1000):
                yield _batch(rows[at : at + 1000])
        if scan is not None and (rest := scan.end()):
            yield _batch(rest)

    found = pieces.mapInArrow(run, LOOSE)
    whole = found.filter("file is null").select(*NAMES[:7])
    torn = stored(found.filter("file is not null").select("file", "block", "seq", "starts", "fragment"), "torn")
    # Runs of fragments that make up one member: each begins where a member is known to begin. The fragments stay behind.
    runs = torn.select("file", "block", "seq", F.sum(F.col("starts").cast("long")).over(Window.partitionBy("file").orderBy("block", "seq")).alias("run"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, run = None, None
        for b in batches:
            rows: list[tuple] = []
            for file, number, raw in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "run", "fragment")), strict=True):
                if (file, number) != run:
                    rows += scan.out if scan else []
                    scan, run = _Scan("", 0), (file, number)
                scan.add(raw[len(MAGIC) :], False)
            rows, scan.out = rows + scan.out, []
            yield _batch([r for r in rows if r[2] is not None]).select(NAMES[:7])

    runs = torn.join(runs, ["file", "block", "seq"]).select("file", "run", "block", "seq", "fragment").repartition("file", "run").sortWithinPartitions("file", "run", "block", "seq")
    return whole.unionByName(runs.mapInArrow(stitch, RECORD))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    r = read_warc(spark, path)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return r.select(F.col("page_id").cast("long"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("refers_to").cast("long"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest
)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
