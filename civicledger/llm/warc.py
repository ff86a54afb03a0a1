"""WARC archives: one gzip member per record, written by the tasks that hold the pages, read one after the other."""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from civicledger.llm.common import shared_root, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "page_id long, url string, payload binary, refers_to long, revisit boolean"
ARCHIVE = "path string, records long, bytes long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string, "
          "path string, position long")
CHUNK = 256 << 10
MOST_HEADER = 1 << 20


# ---- which records repeat others ---------------------------------------------------------------

def with_revisits(pages: DataFrame, min_bytes: int = 1000, hot_parts: int = 1000) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of every row.

    Rows with equal payloads (html in UTF-8, null: empty) of at least ``min_bytes`` bytes form a group.
    The rows with its largest page_id are responses, the others revisit them; a null page_id is smaller
    than any other, and a group without ids has responses only. Repeated rows with the largest id are
    all responses, as nothing tells them apart.

    Groups are counted before any payload moves. Those with at least 1/hot_parts of all rows, of which
    there are hot_parts at most, are broadcast and their rows stay where they are; for the shuffle each
    such row has a key of its own. All other groups are small.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    groups = staged(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    repeated = groups.filter("key is not null and n > 1")
    hot = repeated.filter(F.col("n") * hot_parts >= total).select("key", F.col("last").alias("hot_last"), F.lit(True).alias("hot"))
    rest = repeated.filter(F.col("n") * hot_parts < total).select(F.col("key").alias("rest_key"), F.col("last").alias("rest_last"))
    own = F.concat(F.lit("row "), F.xxhash64("page_id", "url").cast("string"))
    marked = keyed.join(F.broadcast(hot), "key", "left").withColumn("rest_key", F.when(F.col("hot") | F.col("key").isNull(), own).otherwise(F.col("key")))
    last = F.coalesce("hot_last", "rest_last")
    return (marked.join(rest, "rest_key", "left").withColumn("last", last)
            .select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
            .withColumn("revisit", F.col("refers_to").isNotNull()))


# ---- writing -----------------------------------------------------------------------------------------

def _sha1_field(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _safe_uri(url: str | None, page_id) -> str:
    """The url with blanks and control characters escaped, so that no url can end its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _record_id(page_id)[1:-1]


def record_bytes(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> tuple[bytes, bytes]:
    """(header, block) of a response, or of a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", _safe_uri(url, page_id)), ("WARC-Payload-Digest", _sha1_field(hashlib.sha1(payload).digest())),
              ("WARC-Block-Digest", _sha1_field(hashlib.sha1(block).digest()))]
    if revisit:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode(), block


def _open_root(root: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)


def archive_writer(root: str, archive_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each attempt of a task writes files of its own; only those it returns belong to the result, so
        a lost or repeated task leaves nothing behind that a reader would meet."""
        store, folder = _open_root(root)
        store.create_dir(folder, recursive=True)
        sink, path, records, size = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(b[c] for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if sink is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = store.open_output_stream(path, compression=None)
                head, block = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                for piece in (member.compress(head), member.compress(block), member.compress(b"\r\n\r\n"), member.flush()):
                    sink.write(piece)
                    size += len(piece)
                records += 1
                if size >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()
    return write


def write_archives(pages: DataFrame, archive_bytes: int = 64 << 20, min_bytes: int = 1000) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) as archives below the shared folder. Returns the
    list of archives: path, records, bytes. An archive ends with the record that reaches ``archive_bytes``."""
    spark = pages.sparkSession
    root = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages, min_bytes)
    return staged(rows.mapInArrow(archive_writer(root, archive_bytes), ARCHIVE), "archives")


# ---- reading ------------------------------------------------------------------------------------------

class Broken(Exception):
    """The archive cannot be read beyond this place."""


class Members:
    """The gzip members of a stream, one after the other, each given out in pieces of bounded size."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.rest, self.inflate, self.held = read, b"", None, b""

    def next_member(self) -> bool:
        if not self.rest:
            self.rest = self.read(CHUNK)
        self.inflate, self.held = zlib.decompressobj(31), b""
        return bool(self.rest)

    def _more(self) -> bytes:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.rest or self.read(CHUNK)
            self.rest = b""
            if not data:
                raise Broken("the file ends inside a gzip member")
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise Broken(f"not a gzip member: {e}") from None
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int) -> bytes:
        """All bytes up to and with ``mark``; the member's end or ``most`` bytes without it are an error."""
        while (at := self.held.find(mark)) < 0:
            more = self._more()
            if not more or len(self.held) > most:
                raise Broken(f"no end of the header within {len(self.held)} bytes")
            self.held += more
        out, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes of the member."""
        while size:
            part = self.held or self._more()
            if not part:
                raise Broken(f"the record is {size} bytes shorter than its Content-Length")
            part, self.held = part[:size], part[size:]
            size -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _hex(field: str) -> str:
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        raise Broken(f"unknown digest {kind}")
    return base64.b32decode(value).hex()


def read_records(read: Callable[[int], bytes], with_payload: bool = False) -> Iterator[dict]:
    """Records of one archive in order. A record whose digests do not fit is given with its ``problem``;
    where framing is lost, the last row says so and reading ends. Only one piece is held at a time,
    unless payloads are asked for."""
    members, position = Members(read), 0
    try:
        while members.next_member():
            head = members.until(b"\r\n\r\n", MOST_HEADER)
            if not head.startswith(b"WARC/"):
                raise Broken("not a WARC record")
            f = _fields(head)
            if not f.get("content-length", "").isdigit():
                raise Broken("no Content-Length")
            left, block, payload, http, kept = int(f["content-length"]), hashlib.sha1(), hashlib.sha1(), b"", []
            size = None         # of the payload so far; None within the HTTP header
            for part in members.pieces(left):
                block.update(part)
                if size is None:
                    http += part
                    if (at := http.find(b"\r\n\r\n")) < 0:
                        if len(http) > MOST_HEADER:
                            raise Broken("endless HTTP header")
                        continue
                    http, part, size = http[:at], http[at + 4:], 0
                payload.update(part)
                size += len(part)
                if with_payload:
                    kept.append(part)
            if b"".join(members.pieces(4)) != b"\r\n\r\n" or members.held or members._more():
                raise Broken("the record goes on behind its Content-Length")
            kind, problem = f.get("warc-type"), None
            told = _hex(f["warc-payload-digest"]) if "warc-payload-digest" in f else None
            if "warc-block-digest" in f and _hex(f["warc-block-digest"]) != block.hexdigest():
                problem = "block digest"
            elif kind == "response" and told not in (None, payload.hexdigest()):
                problem = "payload digest"
            if kind == "revisit":       # the whole payload is described by the headers it carries
                length = _fields(http + b"\r\n").get("content-length", "")
                size = int(length) if length.isdigit() else None
            yield {"page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "payload_bytes": size or 0,
                   "payload_digest": told if kind == "revisit" else payload.hexdigest(), "record_type": kind,
                   "refers_to": _page(f.get("warc-refers-to")), "payload": b"".join(kept) if with_payload and kind == "response" else None,
                   "problem": problem, "position": position}
            position += 1
    except Broken as e:
        yield {"problem": str(e), "position": position}


def archive_reader(root: str, with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open_root(root)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
        rows, held = [], 0
        for b in batches:
            for path in b["path"].to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_records(source.read, with_payload):
                        rows.append({"path": path, **r})
                        held += len(r.get("payload") or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the listed archives (column ``path``), one archive after the other in a task.
    ``problem`` is null for sound records; a broken archive costs only what lies behind its break."""
    spark = archives.sparkSession
    tasks = max(1, min(archives.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("path").repartition(tasks).mapInArrow(archive_reader(shared_root(spark), with_payload), RECORD)


def op12(pages: DataFrame) -> DataFrame:
    records = read_archives(write_archives(pages))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "position", "problem"))).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AS again FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to FROM r"""
