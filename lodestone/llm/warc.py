"""WARC archives: write pages as segmented records, read them back, reassemble segments."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import remove, rename_files, written

SEGMENT = 16384
CHUNK = 4096
END = b"\r\n\r\n"
#: What every gzip member of under 16 MB ends in.
LAST = b"\0"
PAGE = "urn:x-page:"
#: Digests or record names that are broadcast: some tens of MB.
MOST_BROADCAST = 200_000


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of chunked framing; extensions after a chunk's size are skipped, and ValueError tells of broken framing."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A whole record with the blank lines that end it, as one gzip member, but for its last byte, which is zero in any member of under 16 MB."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record + END) + packer.flush()
    if out[-1:] != LAST:
        raise ValueError(f"a record of {len(record)} bytes is too long")
    return out[:-1]


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head).encode() + END + block


def response_id(page: int | None, found: str, tag: str | None = None) -> str:
    """The name of a response: its page and payload digest, and a tag where it is not one that revisits refer to."""
    return f"{PAGE}{'' if page is None else page}:{found}" + ("" if tag is None else f":{tag}")


def page_records(page: int | None, tag: str, url: str | None, payload: bytes, latest: int | None, kind: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, without the blank lines that end records. kind: head (the response that revisits refer to), response or revisit."""
    found, clean = digest(payload), (url or "").replace("\r", " ").replace("\n", " ")
    common = [("WARC-Target-URI", clean), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{found}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        fields = [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{response_id(latest, found)}>")]
        return [_record("revisit", f"{response_id(page, found, tag)}:again", head, fields)]
    own, block = response_id(page, found, None if kind == "head" else tag), head + chunked(payload)
    if len(block) <= segment:
        return [_record("response", own, block, common)]
    cuts = range(0, len(block), segment)
    out = [_record("response", own, block[:segment], [*common, ("WARC-Segment-Number", "1")])]
    for number, at in enumerate(cuts, 1):
        if number > 1:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(cuts) else []
            out.append(_record("continuation", f"{own}:part{number}", block[at : at + segment], [("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", str(number)), *last]))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 0) -> None:
    """Write one page per row of pages as WARC records under path: files *.warc.gz with one gzip member a record.

    Among pages with equal payloads of at least least_revisit bytes the one with the largest id is a response and the others are revisits of it; a null id counts
    as smallest, and rows that repeat the largest id are all responses, the first of which the revisits refer to. A null html is an empty payload.
    Continuation records follow their origin in its file, but readers need not rely on that.

    Only ids and digests are grouped, an id's repeats first. Digests that occur more than once are counted: up to MOST_BROADCAST they are broadcast to the scan of the payloads, beyond
    that both sides are shuffled by digest, where Spark can split a hot one, as the digests have one row a key. Files come from Spark's own committed
    text writer, whose line separator is the last byte that all members share, so any file system that Spark writes to will do; they are then renamed.
    """
    spark = pages.sparkSession
    few = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    counted = base.where(F.octet_length("payload") >= least_revisit).groupBy("sha", "page").agg(F.count("*").alias("same"))
    top = F.max(F.struct("page", "same")).alias("top")
    copies, at = written(counted.groupBy("sha").agg(F.sum("same").alias("n"), top).where("n > 1 and top.page is not null").select("sha", F.col("top.page").alias("latest"), F.col("top.same").alias("same")), "copies")
    rows = base.join(few(copies), "sha", "left")
    # rows that repeat the largest id are numbered in a table of their own, as a row's number must not change between plans; one of them is the head
    repeats = F.coalesce((F.col("page") == F.col("latest")) & (F.col("same") > 1), F.lit(False))
    tied, at_tied = written(rows.where(repeats).withColumn("row", F.monotonically_increasing_id()), "tied")
    heads = tied.groupBy("sha").agg(F.min("row").alias("head"))
    tied = tied.join(few(heads), "sha").withColumn("kind", F.when(F.col("row") == F.col("head"), "head").otherwise("response")).withColumn("tag", F.concat(F.lit("t"), "row"))
    kind = F.when(F.col("latest").isNull(), "response").when(F.col("page") == F.col("latest"), "head").otherwise("revisit")
    alone = rows.where(~repeats).withColumn("kind", kind).withColumn("tag", F.monotonically_increasing_id().cast("string"))
    fields = ["page", "tag", "url", "payload", "latest", "kind"]
    rows = alone.select(*fields).unionByName(tied.select(*fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256).to_pylist()
                made = [member(r) for x in part for r in page_records(*x.values())]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary")
    parts = f"{path}.parts"
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", LAST.decode()).text(parts)
    rename_files(spark, parts, path, ".txt", ".warc.gz")
    remove(spark, parts, at, at_tied)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


RECORD = "page long, record_id string, origin string, kind string, segment int, total long, sha string, refers string, payload_bytes long, block binary"


def records_of(path_and_bytes: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """Records of files that come as pieces between blank lines, in order; a record may span any number of them."""
    file, data = None, bytearray()
    for name, piece in path_and_bytes:
        if name != file:
            if bytes(data).strip():
                raise ValueError(f"{file} ends within a record")
            file, data = name, bytearray()
        data += piece + END
        while (end := data.find(END)) >= 0:
            fields = _fields(bytes(data[:end]))
            size = int(fields["content-length"])
            if len(data) < end + 4 + size + 4:
                break
            block = bytes(data[end + 4 : end + 4 + size])
            if data[end + 4 + size : end + 8 + size] != END:
                raise ValueError(f"a record of {file} does not end where its length says")
            del data[: end + 8 + size]
            own = fields["warc-record-id"].strip("<>")
            page = own.removeprefix(PAGE).split(":")[0]
            number = lambda k: int(fields[k]) if k in fields else None
            yield {
                "page": int(page) if page else None, "record_id": own, "origin": fields.get("warc-segment-origin-id", own).strip("<>"), "kind": fields["warc-type"], "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
                "sha": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "refers": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_bytes": None, "block": block,
            }
    if bytes(data).strip():
        raise ValueError(f"{file} ends within a record")


def decoded(record: dict, block: bytes, with_payload: bool) -> dict:
    """A response with its payload in place of its block; a payload that does not have the digest that its record states raises."""
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest(payload) != record["sha"]:
        raise ValueError(f"{record['record_id']}: the payload's digest is {digest(payload)}, its record says {record['sha']}")
    return record | {"segment": None, "total": None, "payload_bytes": len(payload), "block": payload if with_payload else None}


ARROW = pa.schema([("page", pa.int64()), ("record_id", pa.string()), ("origin", pa.string()), ("kind", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("sha", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])


def scan_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under path, one row a record; a response of one record is decoded, and its block is the payload. gzip files are never split, so a file's
    pieces come in order in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v or b"") for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        held, size = [], 0
        for record in records_of(pieces):
            if record["kind"] == "response" and record["segment"] is None:
                size += len(record["block"])
                record = decoded(record, record["block"], with_payload)
            elif record["kind"] == "revisit":
                record["block"] = None
            held.append(record)
            size += len(record["block"] or b"") + 256
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)

    lines = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.warc.gz").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def reassembled(parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """Responses from the records of segmented ones: grouped by origin identifier, ordered by segment number, decoded as a whole. A missing or doubled
    segment, or a total length that differs, raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            numbers, block = [p["segment"] for p in held], b"".join(p["block"] for p in held)
            if numbers != list(range(1, len(held) + 1)) or held[-1]["total"] != len(block):
                raise ValueError(f"{held[0]['origin']}: segments {numbers}, {len(block)} bytes of {held[-1]['total']}")
            return pa.RecordBatch.from_pylist([decoded(held[0], block, with_payload)], ARROW)

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for record in batch.slice(k, 64).to_pylist():
                    if held and held[0]["origin"] != record["origin"]:
                        yield close()
                        held = []
                    held.append(record)
        if held:
            yield close()

    return parts.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(run, RECORD)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per page of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The archives are read once, into a table of records. Whatever does not fit raises: see decoded and reassembled, and a revisit must refer to a response that is
    there and states the same digest. A revisit's length is that response's; it has no payload of its own.
    """
    records, _ = written(scan_warc(spark, path, with_payload), "records")
    lone = records.where("kind = 'response' and segment is null")
    whole, _ = written(reassembled(records.where("segment is not null"), with_payload), "whole")
    responses = lone.unionByName(whole)
    revisits = records.where("kind = 'revisit'").select("page", "record_id", "sha", "refers")
    heads, _ = written(responses.select(F.col("record_id").alias("refers"), F.col("page").alias("head"), F.col("sha").alias("said"), "payload_bytes").join(revisits.select("refers").distinct(), "refers", "left_semi"), "heads")
    found = revisits.join(F.broadcast(heads) if heads.count() <= MOST_BROADCAST else heads, "refers", "left")
    wrong = F.raise_error(F.concat(F.col("record_id"), F.lit(" refers to "), F.col("refers"), F.lit(", which is not there or has another payload")))
    checked = F.when(F.col("said") == F.col("sha"), F.col("head")).otherwise(wrong.cast("long"))
    again = found.select(F.col("page").alias("page_id"), "payload_bytes", F.col("sha").alias("payload_digest"), F.lit("revisit").alias("record_type"), checked.alias("refers_to"), F.lit(None).cast("binary").alias("payload"))
    first = responses.select(F.col("page").alias("page_id"), "payload_bytes", F.col("sha").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("block").alias("payload"))
    return first.unionByName(again)
