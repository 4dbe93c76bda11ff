"""WARC archives: records written from pages, read back, segments reassembled.

Writing: a page is a response record with a chunked HTTP message; a block longer than ``segment_bytes`` goes on in
continuation records. Of pages with equal payloads the one with the largest id is the response, the others are
revisits of it. The files are plain WARC/1.1 text, one gzip stream a file, committed by Spark's own writer, so
any store and any lost executor will do.

Reading: records are parsed from a stream of each file. Segments meet by origin identifier, in order of segment
number, are checked for gaps and against the total length, and the chunked framing is decoded piece by piece: a
task holds one segment at a time, unless payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm._scratch import batches, small_batches, written

SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 1 << 16, 1 << 13, 1 << 25
#: The format's own words.
_END, _PROFILE = b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(id: int | None, key: bytes) -> str:
    return f"urn:x-page:{'' if id is None else id}:{key.hex()[:32]}"


def page_of(record: str) -> Column:
    """The page id in a record's identifier, null if it has none."""
    return F.regexp_extract(record, r"^urn:x-page:(-?\d*):", 1).try_cast("long")


def chunked(data: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join(out) + b"0\r\n\r\n"


def _record(block: bytes, **fields: str | int | None) -> bytes:
    head = ["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block


def records(id: int | None, url: str | None, payload: bytes, key: bytes, refers_to: str | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page, without the two line ends that follow each."""
    own = record_id(id, key)
    common = {"WARC_Record_ID": f"<{own}>", "WARC_Target_URI": " ".join((url or "urn:x-none").split()), "WARC_Date": _DATE, "WARC_Payload_Digest": f"sha1:{base32_sha1(payload)}"}
    if refers_to is not None:
        yield _record(_HTTP, WARC_Type="revisit", **common, WARC_Profile=_PROFILE, WARC_Refers_To=f"<{refers_to}>", X_Payload_Length=len(payload), Content_Type="application/http; msgtype=response")
        return
    block = _HTTP + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record(block, WARC_Type="response", **common, Content_Type="application/http; msgtype=response")
        return
    yield _record(block[:segment], WARC_Type="response", **common, WARC_Segment_Number=1, Content_Type="application/http; msgtype=response")
    for k, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        yield _record(block[at : at + segment], WARC_Type="continuation", WARC_Record_ID=f"<{own}:{k}>", WARC_Date=_DATE, WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def write_archives(df: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record, with its continuations, for each row.

    A null payload is empty. Equal payloads of at least ``min_bytes`` bytes share one response. Rows that repeat
    the largest id of a payload are responses all; a null id is smaller than any other. Pages are dealt out to as
    many archives as ``archive_bytes`` of payload each ask for, so an archive takes about that, and more by its longest
    pages. Other columns are ignored; an empty table makes archives without pages.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = df.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    own = F.concat_ws(":", F.col("id").cast("string"), F.hex("key"))
    narrow = written(pages.select("id", "key", F.octet_length("payload").cast("long").alias("n")), "payloads")
    archives = max(1, math.ceil((narrow.agg(F.sum("n")).first()[0] or 0) / archive_bytes))
    narrow = narrow.where(F.col("n") >= min_bytes).select("id", "key")
    tops = narrow.groupBy("key").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL").drop("n")
    revisits = narrow.join(tops, "key").where("id IS NULL OR id < top").distinct()
    revisits = revisits.select(own.alias("__own"), "top")
    # revisits are a hash table a partition: page ids deal them out evenly, and the payloads need no sort
    revisits = revisits.hint("shuffle_hash")
    dealt = pages.withColumn("own", own).repartition(archives, "own")
    wide = dealt.join(revisits, F.col("own") == F.col("__own"), "left").select("id", "url", "payload", "key", "top")

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _record(b"software: tidegate\r\nformat: WARC File Format 1.1\r\n", WARC_Type="warcinfo", WARC_Record_ID="<urn:x-info>", WARC_Date=_DATE, Content_Type="application/warc-fields")
        out, held = [first], 0
        for batch in pieces:
            for i, u, p, k, top in zip(*batch.columns, strict=True):
                i, k, top = i.as_py(), k.as_py(), top.as_py()
                for r in records(i, u.as_py(), p.as_py(), k, None if top is None else record_id(top, k), segment_bytes, chunk_bytes):
                    out.append(r)
                    held += len(r)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = wide.coalesce(archives).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    with batches(df.sparkSession):
        lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive that comes in pieces."""
    buffer, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        if (x := next(pieces, None)) is None:
            return False
        buffer.extend(x)
        return True

    while True:
        while buffer[:1] in (b"\r", b"\n"):
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
        at = buffer.find(_END)
        while at < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            at = buffer.find(_END, 0) if buffer.strip() else -1
        if buffer[:1] in (b"\r", b"\n"):
            continue
        version, *fields = bytes(buffer[:at]).decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record starts here")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
        n = int(head["content-length"])
        while len(buffer) < at + 4 + n:
            if not more():
                raise ValueError("the archive ends within a block")
        yield head, bytes(buffer[at + 4 : at + 4 + n])
        del buffer[: at + 4 + n]


def inflated(data: bytes, size: int = 1 << 16) -> Iterator[bytes]:
    """The content of gzip members, or of plain data."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + size] for i in range(0, len(data), size))
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            piece = view[at : at + size]
            yield z.decompress(piece)
            at += len(piece) - len(z.unused_data)


class Payload:
    """Decodes an HTTP message that comes in pieces: its head, then a chunked or plain body."""

    def __init__(self, keep: bool):
        self.keep, self.sha, self.n, self.data = keep, hashlib.sha1(), 0, bytearray()
        self.buffer, self.state, self.left, self.chunked, self.broken = bytearray(), "head", 0, False, False

    def _take(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        if self.keep:
            self.data += data

    def feed(self, piece: bytes) -> None:
        b = self.buffer
        b += piece
        while b and not self.broken:
            if self.state == "head":
                if (at := b.find(_END)) < 0:
                    return
                self.chunked = b"transfer-encoding: chunked" in bytes(b[:at]).lower()
                del b[: at + 4]
                self.state = "size" if self.chunked else "plain"
            elif self.state == "plain":
                self._take(bytes(b))
                b.clear()
            elif self.state == "size":
                if (at := b.find(b"\r\n")) < 0:
                    return
                try:
                    self.left = int(bytes(b[:at]).split(b";")[0], 16)
                except ValueError:
                    self.broken = True
                del b[: at + 2]
                self.state = "data" if self.left else "trailer"
            elif self.state == "data":
                got = bytes(b[: self.left])
                self._take(got)
                self.left -= len(got)
                del b[: len(got)]
                if not self.left:
                    self.state = "line"
            elif self.state == "line":
                if len(b) < 2:
                    return
                self.broken = b[:2] != b"\r\n"
                del b[:2]
                self.state = "size"
            elif self.state == "trailer":
                if (at := b.find(b"\r\n")) < 0:
                    return
                del b[: at + 2]
                if at == 0:
                    self.state = "end"
            else:
                self.broken = True

    @property
    def whole(self) -> bool:
        return not self.broken and self.state == ("end" if self.chunked else "plain")


_ROW = pa.schema([("origin", pa.string()), ("salt", pa.int64()), ("segment", pa.int32()), ("last", pa.int64()), ("type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("valid", pa.bool_()), ("block", pa.binary())])
_DDL = "origin string, salt long, segment int, last long, type string, refers_to string, url string, digest string, n long, valid boolean, block binary"


def _bare(x: str | None) -> str | None:
    return None if x is None else x.strip("<>")


def _finished(p: Payload, stated: str | None, keep: bool) -> tuple[str, bool, bytes | None]:
    digest = base64.b32encode(p.sha.digest()).decode()
    return digest, p.whole and stated in (None, f"sha1:{digest}"), bytes(p.data) if keep else None


def _rows(keep: bool):
    """A row for each record: decoded where it is whole, with its block where it is a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = dict.fromkeys(_ROW.names)
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for k, (head, block) in enumerate(parsed(inflated(content.as_py()))):
                    kind = head.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    row = blank | {"origin": _bare(head.get("warc-segment-origin-id", head["warc-record-id"])), "salt": 0, "type": kind, "refers_to": _bare(head.get("warc-refers-to")), "url": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest")}
                    if "warc-segment-number" in head:
                        row |= {"segment": int(head["warc-segment-number"]), "last": int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, "block": block}
                        held += len(block)
                    elif kind == "revisit":
                        row |= {"salt": k, "digest": (row["digest"] or "").removeprefix("sha1:") or None, "n": int(head["x-payload-length"]) if "x-payload-length" in head else None, "valid": True}
                    else:
                        p = Payload(keep)
                        p.feed(block)
                        digest, valid, data = _finished(p, row["digest"], keep)
                        row |= {"salt": k, "digest": digest, "n": p.n, "valid": valid, "block": data}
                        held += len(data or b"")
                    out.append(row)
                    if held > 1 << 22 or len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, _ROW)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _ROW)

    return run


def _assembled(keep: bool):
    """Whole records pass; segments, sorted by origin and number, become one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict | None = None

        def closed() -> list[dict]:
            g = group
            if g is None:
                return []
            digest, valid, data = _finished(g["payload"], g["first"]["digest"], keep)
            right = valid and g["first"]["segment"] == 1 and not g["gap"] and g["total"] == g["bytes"]
            row = g["first"] | {"segment": None, "last": None, "digest": digest, "n": g["payload"].n, "valid": right, "block": data}
            return [row] * max(1, min([g["least"], g["copies"]]))

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["segment"] is None:
                    out.append(row)
                    continue
                if group is None or group["first"]["origin"] != row["origin"]:
                    out += closed()
                    group = {"first": row | {"block": None}, "payload": Payload(keep), "gap": False, "total": None, "bytes": 0, "at": 0, "copies": 0, "least": 1 << 62}
                if row["segment"] == group["at"]:  # another copy of the same record
                    group["copies"] += 1
                    continue
                if group["copies"]:
                    group["least"] = min(group["least"], group["copies"])
                group["gap"] |= row["segment"] != group["at"] + 1
                group |= {"at": row["segment"], "copies": 1, "total": row["last"]}
                group["payload"].feed(row["block"])
                group["bytes"] += len(row["block"])
            if out:
                yield pa.RecordBatch.from_pylist(out, _ROW)
        if group is not None:
            yield pa.RecordBatch.from_pylist(closed(), _ROW)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per response or revisit: record_id, record_type, refers_to (a record's identifier), url, payload_bytes,
    payload_digest, valid, and the payload itself if asked for.

    ``valid`` is false where segments are missing, the total length differs, the framing is broken or the
    stated digest is another; such records are returned all the same. Records that repeat an identifier are returned each,
    segmented ones as often as all their segments are there; fields that a record lacks are null, other fields are left out.
    Archives may be gzipped; those without records give no rows. The session's Arrow batches stay small afterwards.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_rows(payload), _DDL)
    met = rows.repartition(F.col("origin"), F.col("salt")).sortWithinPartitions("origin", "salt", "segment")
    out = met.mapInArrow(_assembled(payload), _DDL)
    return out.select(F.col("origin").alias("record_id"), F.col("type").alias("record_type"), "refers_to", "url", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "valid", *([F.col("block").alias("payload")] if payload else []))
