"""WARC archives: writing with revisits, segments and chunked framing; reading back with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import new_path, salted_join, written

#: Payloads below this many bytes are never revisits.
LEAST = 1000
#: A record block above this many bytes is cut into segments.
SEGMENT = 16_384
#: Bytes of a chunk in the chunked transfer framing.
CHUNK = 4096
#: Compressed bytes after which the next archive file begins.
FILE = 64 << 20
#: Tasks that read archives, at most.
READERS = 20_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """Payload of a whole HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(fields: dict[str, str], block: bytes) -> bytes:
    fields = {**fields, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page: object, url: str | None, payload: bytes, refers_to: object | None, segment: int) -> Iterator[bytes]:
    digest = hashlib.sha1(payload).hexdigest()
    own = record_id(page, digest)
    common = {
        "WARC-Record-ID": own,
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Page-ID": "" if page is None else str(page),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record({"WARC-Type": "revisit", **common, "WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": profile, "X-Refers-To-Page-ID": str(refers_to)}, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        yield record({"WARC-Type": "response", **common}, block)
        return
    for i in range(0, len(block), segment):
        n = {"WARC-Segment-Number": str(i // segment + 1)}
        if i + segment >= len(block):
            n["WARC-Segment-Total-Length"] = str(len(block))
        if i:
            part = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(f"{page}#{i}", digest), "WARC-Date": common["WARC-Date"], "WARC-Segment-Origin-ID": own}
            yield record({**part, **n}, block[i : i + segment])
        else:
            yield record({"WARC-Type": "response", **common, **n}, block[:segment])


def member(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, segment: int = SEGMENT, file_bytes: int = FILE) -> DataFrame:
    """Writes pages (page_id, url, html) as gzipped WARC files and returns the table of files (path, records, bytes).

    Of equal payloads of `least` bytes or more the one with the largest page_id is the response, the others are
    revisits of it. A null html is an empty payload. Rows that repeat page_id and payload are all responses with one
    record id; a null page_id never is referred to, unless no copy has an id (then all are responses).
    Each task attempt writes files of its own; the returned table names those of the attempts that counted,
    so a lost executor's half-written files are never read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    sizes = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    shared = sizes.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = salted_join(rows, written(shared, "warc-shared"), ["digest"], "page_id", "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made, out, path, n = [], None, "", 0
        for x in batches:
            x = x.astype({"page_id": object, "refers_to": object}).where(x.notna(), None)
            for page, url, text, refers_to in zip(x["page_id"], x["url"], x["html"], x["refers_to"]):
                page, refers_to = (None if v is None else int(v) for v in (page, refers_to))
                if out is None:
                    path = f"{root}/{task.taskAttemptId():08d}-{len(made):05d}.warc.gz"
                    out, n = store.open_output_stream(path, compression=None), 0
                for data in records(page, url, text.encode("utf-8", "surrogatepass"), refers_to, segment):
                    out.write(member(data))
                    n += 1
                if out.tell() >= file_bytes:
                    made.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            made.append((path, n, out.tell()))
            out.close()
        yield pd.DataFrame(made, columns=["path", "records", "bytes"]).astype({"path": object, "records": "int64", "bytes": "int64"})

    return written(rows.mapInPandas(run, "path string, records long, bytes long"), "warc-files")


def members(stream: io.RawIOBase, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time in memory."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(step):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("a gzip member is cut off")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


RECORD = "record_id string, page_id long, type string, refers_to long, digest string, number int, total long, payload_bytes long, sha1 string, block binary"


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """A row per WARC record. Whole responses come decoded (payload_bytes, sha1); segments come as blocks under their origin's record id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for x in batches:
            for path in x["path"]:
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        f, block = parsed(data)
                        rows.append(_row(f, block))
                        held += len(rows[-1][-1] or b"") + 200
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=NAMES).astype(TYPES)
                            rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=NAMES).astype(TYPES)

    # a number of its own, which adaptive execution does not merge: each task reads a few files
    tasks = files.agg(F.count("path")).first()[0]
    return files.select("path").repartition(max(1, min(tasks, READERS))).mapInPandas(run, RECORD)


NAMES = [x.split()[0] for x in RECORD.split(", ")]
TYPES = {"page_id": "Int64", "refers_to": "Int64", "number": "Int32", "total": "Int64", "payload_bytes": "Int64"}


def _row(f: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(f[k]) if f.get(k) else None
    digest = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in f else None
    kind, segment = f["warc-type"], number("warc-segment-number")
    size = sha1 = None
    if kind == "response" and segment is None:
        payload = payload_of(block)
        size, sha1, block = len(payload), hashlib.sha1(payload).hexdigest(), None
    elif kind == "revisit":
        block = None
    return f.get("warc-segment-origin-id", f["warc-record-id"]), number("x-page-id"), kind, number("x-refers-to-page-id"), digest, segment, number("warc-segment-total-length"), size, sha1, block


def reassemble(found: DataFrame) -> DataFrame:
    """Responses (page_id, payload_bytes, digest) of read_records: whole ones, and segments put together.

    Segments are grouped by their origin's id and ordered by number; numbers must run without a gap to the one
    that states the total length, which must be that of the joined block, and the payload's digest must be the stated
    one - else the query fails. Records that share an id, as repeated rows and null ids of one payload do, are put together
    once, from one copy of each segment, and give a row for each copy of the first.
    """
    whole = found.where("type = 'response' and number is null").select("page_id", "payload_bytes", "sha1", "digest")

    def join(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("number")
        block, total = b"".join(x["block"]), x["total"].iloc[-1]
        if list(x["number"]) != list(range(1, len(x) + 1)) or pd.isna(total) or int(total) != len(block):
            raise ValueError(f"segments of {x['record_id'].iloc[0]} are not whole")
        payload = payload_of(block)
        return pd.DataFrame({"record_id": [x["record_id"].iloc[0]], "payload_bytes": [len(payload)], "sha1": [hashlib.sha1(payload).hexdigest()]})

    # copies of a segment fall together in the tasks that read them, before they are dealt out
    parts = found.where("number is not null").groupBy("record_id", "number").agg(F.max("total").alias("total"), F.any_value("block").alias("block"))
    joined = parts.groupBy("record_id").applyInPandas(join, "record_id string, payload_bytes long, sha1 string")
    heads = found.where("number is not null and type = 'response'").select("record_id", "page_id", "digest")
    # a head of every record and no other; joined has one row for an id, so hot ids are dealt to several tasks
    joined = salted_join(heads.withColumn("turn", F.monotonically_increasing_id()), joined, ["record_id"], "turn").select("page_id", "payload_bytes", "sha1", "digest")
    checked = whole.union(joined)
    wrong = F.raise_error(F.concat(F.lit("payload digest differs on page "), F.col("page_id").cast("string")))
    return checked.select("page_id", "payload_bytes", F.when(F.col("sha1") == F.col("digest"), F.col("digest")).otherwise(wrong).alias("digest"))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes pages into WARC files in the shared folder, reads them back; per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null, empty and very long pages, repeated rows and null ids: see write_archives. An empty table
    writes nothing and gives no rows. Other columns are not carried. Keywords: those of write_archives.
    """
    folder = new_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder, **how)
    found = written(read_records(files, folder), "warc-records")
    responses = written(reassemble(found), "warc-responses")
    own = responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    kept = responses.where("page_id is not null").groupBy("page_id", "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = found.where("type = 'revisit'").select(F.col("page_id").alias("id"), F.col("refers_to").alias("page_id"), "digest")
    kept = written(kept.join(again.select("page_id", "digest").distinct(), ["page_id", "digest"]), "warc-referred")
    again = salted_join(again, kept, ["page_id", "digest"], "id", "left")
    return own.union(again.select("id", "payload_bytes", "digest", F.lit("revisit"), "page_id"))
