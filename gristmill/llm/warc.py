"""WARC archives: one gzip member a record, written and read in byte ranges by Spark's own text source and sink.

Writing. A member's last byte is the top byte of its length, 0 below 16 MiB; longer records get an empty member after
them, which ends in 0 as well. So a row is a member without its last byte, and the sink's "line separator", one zero
byte, completes it: each part file is a plain .warc.gz, in whatever store Spark can write to, and is named so in the end.

Reading. The source splits files into byte ranges with the gzip magic as separator: a task scans its range, owns the
pieces that start inside and reads the last one to its end beyond. A piece is the start of a record only if it decodes
to a member with a WARC header. The magic may also occur by chance inside compressed bytes; a piece that doesn't
complete a member is joined with the next one. Where a range ends within such a member, its pieces and the orphans at
the start of the next range are put together by file and range in a small second step. Archives are read once.

Hadoop's readers would unpack files named .gz themselves, and in one piece. Which codec unpacks a file they tell by the
last registered extension that comes before its reversed name; `_raw` registers one that no file has right after .gz, so
that no codec is found and the file is read as it is, in ranges.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import small, stored

#: Up to so many revisits are broadcast to the pages (some 60 bytes each); beyond, the pages are shuffled to them.
REVISITS_AT_ONCE = 200_000
MAGIC = b"\x1f\x8b\x08"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, error string, payload binary"
_PIECE = RECORD + ", file string, block long, seq long, piece binary"
#: The pieces of the member that is open at a range's end are numbered from here, the orphans at its start from 0.
OPEN = 1 << 40
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def _clean(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def build(record_id: str, kind: str, uri: str | None, payload: bytes, refers_to: str | None, digest: str, size: int | None = None) -> bytes:
    """A record with its headers; a revisit carries no payload, but HTTP headers with the full one's length, `size`."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    size = len(payload) if size is None else size
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + http + payload + b"\r\n\r\n"


def _number(value: str | bytes | None) -> int | None:
    """A header's number, if it is one."""
    value = value.decode("latin-1") if isinstance(value, bytes) else value
    return int(value) if value and value.strip().isascii() and value.strip().isdigit() else None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by name; of a name that comes twice the first one counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out.setdefault(key.strip().lower(), value.strip())
    return out


def _unchunked(body: bytes) -> bytes | None:
    """What a chunked HTTP body holds; None if it isn't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not size or not set(size) <= set(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if len(body) < end + 2 + n + 2 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(head: dict[str, str], block: bytes, error: str | None) -> tuple:
    """A row of RECORD. Payload, length and digest are of the HTTP body with its chunks put together; what is odd goes to `error`."""
    kind, payload, full = head.get("warc-type"), block, None
    said = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    raw = block
    if head.get("content-type", "").startswith("application/http"):
        http, _, raw = block.partition(b"\r\n\r\n")
        fields = _fields(http)
        payload, full = raw, _number(fields.get("content-length"))
        if "chunked" in fields.get("transfer-encoding", "").lower() and kind != "revisit":
            payload = _unchunked(raw)
            if payload is None:
                payload, error = raw, error or "the chunked body can't be decoded"
    digest = said
    if kind != "revisit":
        full, digest = len(payload), _digest(payload)
        if said and len(said) == 32 and said.upper() not in (digest, _digest(raw)):
            error = error or "the payload is not what its digest says"
    return (head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), (head.get("warc-refers-to") or "").strip("<>") or None, full, digest, error, payload)


def records(raw: bytes) -> Iterator[tuple]:
    """Rows of RECORD from the bytes of a member, which holds one record or many.

    A record without a length that is a number ends where the next one begins, and says so in `error`, as does one that is cut
    off. Bytes that are no record give a row with nothing but their number and an error; blank lines between records, none.
    """
    at = 0
    while True:
        while raw[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(raw):
            return
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            found = raw.find(b"\r\n\r\nWARC/", at)
            to = len(raw) if found < 0 else found + 4
            yield ("", None, None, None, to - at, None, "bytes that are no WARC record", raw[at:to])
            at = to
            continue
        head = _fields(raw[at:end])
        size, error = _number(head.get("content-length")), None
        begin = end + 4
        if size is None:
            found = raw.find(b"\r\n\r\nWARC/", begin)
            size, error = (len(raw.rstrip(b"\r\n")) if found < 0 else found) - begin, "the record's length is no number"
        elif begin + size > len(raw):
            error = "the record is cut off"
        yield _record(head, raw[begin : begin + max(0, size)], error)
        at = begin + max(0, size)


def _inflate(member: bytes) -> bytes | None:
    """What a member holds, if it is whole."""
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(member) + z.flush()
    except zlib.error:
        return None
    return out if z.eof else None


def _is_start(piece: bytes) -> bool:
    """Whether a piece looks like a member with a WARC record, or an empty one: decoded as far as its first bytes."""
    try:
        z = zlib.decompressobj(31)
        head = z.decompress(MAGIC + piece[:512], 5)
    except zlib.error:
        return False
    return head == b"WARC/" or head == b"" and z.eof


def write(pages: DataFrame, path: str, at_least: int = 0) -> None:
    """Writes each row (page_id, url, html) as a record to parts named *.warc.gz under `path`.

    The payload is html in UTF-8, null as empty. Of records with equal payloads of at least `at_least` bytes the one
    with the smallest page_id is a response and the others are revisits of it, with no payload; smaller ones are all
    responses. A repeated row of that smallest page_id is a response again. A null page_id counts as larger than all.
    Other columns are not read; an empty table makes an archive without records. Revisits are found by digests and ids
    alone; payloads are not shuffled for it unless there are very many revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body")))
    ids = rows.where(F.octet_length("body") >= at_least).select(F.col("sha").alias("of"), F.col("page_id").alias("who"))
    shared = ids.groupBy("of").agg(F.min("who").alias("refers"), F.count("*").alias("n")).where("n > 1 and refers is not null").drop("n")
    revisits = stored(ids.join(shared, "of").where(~F.col("who").eqNullSafe(F.col("refers"))).distinct(), "revisits")
    rows = rows.join(small(revisits, REVISITS_AT_ONCE), (F.col("sha") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("who")), "left")
    rows = rows.select("page_id", "url", "sha", "refers", F.octet_length("body").alias("size"), F.when(F.col("refers").isNull(), F.col("body")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                out = []
                for row in batch.slice(at, 100).to_pylist():
                    digest = base64.b32encode(row["sha"]).decode()
                    key, refers = (f"urn:page:{'' if x is None else x}" for x in (row["page_id"], row["refers"]))
                    kind = "response" if row["refers"] is None else "revisit"
                    out.append(_member(build(key, kind, row["url"], row["body"] or b"", refers, digest, row["size"]))[:-1])
                yield pa.record_batch([pa.array(out, pa.binary())], ["member"])

    rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    _named(pages.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """Gives the sink's parts their suffix."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(top):
        name = found.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(found.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, name.removesuffix(".txt") + ".warc.gz"))


def _raw(spark: SparkSession) -> dict[str, str]:
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": codec.CLASSNAME, codec.OPT_EXTENSION: ".\u0001.gz"}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under `path`: id, type, target URI, refers_to, payload length and digest, error, payload.

    Files may have any name, *.warc.gz among them, and other members than `write` makes, with one record each or many. Chunked
    HTTP bodies are put together. Numbers that aren't any, digests that differ, records that are cut off and bytes that are no
    record are named in `error`, which is null otherwise; they end no read. Bytes that belong to no gzip member do: an archive
    that is cut off is never read as if it were whole. A member is in memory as a whole. Records are stored in the shared
    folder; without `payloads` only their lengths and digests are, and payload is null.
    """
    lines = spark.read.options(**_raw(spark)).option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    def rows_of(raw: bytes) -> Iterator[tuple]:
        for found in records(raw):
            yield (*(found if payloads else (*found[:-1], None)), None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that lie whole in a range, and the pieces of those that don't."""
        here: tuple | None = None
        state: list[bytes] = []
        rows: list[tuple] = []
        size = orphans = 0

        def finish(at_end: bool) -> None:
            if not state:
                return
            raw = _inflate(b"".join(MAGIC + x for x in state))
            if raw is None and at_end:
                rows.extend((None,) * 8 + (*here, seq, x) for seq, x in enumerate(state, OPEN))
            elif raw is None:
                raise ValueError("an archive holds bytes that are no whole gzip member")
            elif raw:
                rows.extend(rows_of(raw))

        for batch in batches:
            for piece, file, block in zip(*batch.columns, strict=True):
                at, piece = (file.as_py(), block.as_py()), piece.as_py()
                if at != here:
                    finish(True)
                    here, state, orphans = at, [], 0
                    if at[1] == 0 and not piece:
                        continue  # nothing stands before the first magic of a file
                if _is_start(piece):
                    finish(False)
                    state = [piece]
                elif state:
                    state.append(piece)
                else:
                    rows.append((None,) * 8 + (*here, orphans, piece))
                    orphans += 1
                size += len(piece)
                if rows and (len(rows) >= 500 or size > 4 << 20):
                    yield out(rows)
                    rows, size = [], 0
        finish(True)
        yield out(rows)

    def stitch(table: pa.Table) -> pa.Table:
        """Pieces of one file in the order of their ranges; those of a range that ends a member have the higher numbers."""
        rows, held = [], []

        def close() -> None:
            if held:
                raw = _inflate(b"".join(MAGIC + x for x in held))
                if raw is None:
                    raise ValueError("an archive holds bytes that are no whole gzip member")
                if raw:
                    rows.extend(rows_of(raw))
                held.clear()

        for row in table.sort_by([("block", "ascending"), ("seq", "ascending")]).to_pylist():
            if row["seq"] == OPEN:
                close()
            held.append(row["piece"])
        close()
        return pa.Table.from_batches([out(rows)])

    fields = [x.split()[0] for x in RECORD.split(", ")]
    found = stored(lines.mapInArrow(run, _PIECE), "records")
    torn = found.where("file is not null").groupBy("file").applyInArrow(stitch, _PIECE)
    return found.where("file is null").select(fields).unionByName(torn.select(fields))
