"""WARC archives in Zstandard frames, a frame for each record, with a dictionary in a leading skippable frame.

The dictionary frame has the magic number 0x184D2A5D and holds the dictionary as it is or as a Zstandard frame. The
reader loads it, decodes one frame after another in small steps, and checks each record: version line, the headers that must be
there, the lengths of block and frame, the HTTP head and the payload's length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import fresh_path, sliced, small, string_of, table, written

#: Fixed values of the format.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2020-01-01T00:00:00Z"
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: The dictionary is trained on so many pages, of each so many bytes at most; it changes the size of an archive only.
DICT_ROWS, DICT_ROW_BYTES, DICT_BYTES = 256, 16 << 10, 64 << 10
#: Broadcast the groups of equal payloads up to this number, else join them through a shuffle.
MOST_GROUPS = 1_000_000


class BadArchive(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """A record's bytes: a whole HTTP response, or for a revisit its head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    uri = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:x-page:{page_id}"
    lines = [
        VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or b"" where the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(stream, step: int = 1 << 16):
    """(offset, content) of every frame of an archive, read in steps."""
    buf, at = stream.read(8), 0
    dictionary = None
    if len(buf) == 8 and struct.unpack("<I", buf[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", buf[4:])[0]
        body = stream.read(size)
        if len(body) < size:
            raise BadArchive("the dictionary's frame is cut short")
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary, at, buf = zstandard.ZstdCompressionDict(body), 8 + size, b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        buf = buf or stream.read(step)
        if not buf:
            return
        one, parts, used = decoder.decompressobj(), [], 0
        while not one.eof:
            if not buf:
                raise BadArchive(f"the frame at {at} is cut short")
            try:
                parts.append(one.decompress(buf))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at {at}: {e}") from e
            used += len(buf)
            buf = one.unused_data if one.eof else stream.read(step)
            used -= len(buf) if one.eof else 0
        yield at, b"".join(parts)
        at += used


def parse(data: bytes) -> dict:
    """A frame's record as a dict; BadArchive if anything about it is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not first.startswith(b"WARC/1."):
        raise BadArchive("no WARC version line")
    h: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        h[name.lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in h]:
        raise BadArchive(f"no {', '.join(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadArchive(f"content-length {h['content-length']}, but {len(rest) - 4} bytes")
    block, out = rest[:-4], {"type": h["warc-type"], "id": h["warc-record-id"], "uri": h.get("warc-target-uri"), "digest": None, "length": None, "payload": None, "refers_to": h.get("warc-refers-to"), "headers": h}
    if h["warc-type"] in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        length = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if not gap or not http.startswith(b"HTTP/") or len(length) != 1 or not length[0].isdigit():
            raise BadArchive("no whole HTTP head")
        out |= {"length": int(length[0]), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if h["warc-type"] == "response":
            if len(payload) != out["length"]:
                raise BadArchive(f"HTTP content-length {out['length']}, but {len(payload)} bytes")
            if out["digest"] not in (None, own := payload_digest(payload)):
                raise BadArchive(f"payload digest {out['digest']}, but it is {own}")
            out |= {"payload": payload, "digest": own}
        elif payload or not out["digest"] or not out["refers_to"]:
            raise BadArchive("a revisit has a digest, what it refers to, and no payload")
    return out


def records(stream):
    """(offset, record) of every record of an archive."""
    for at, data in frames(stream):
        yield at, parse(data)


def _page(uri: str | None):
    x = (uri or "").strip("<>").removeprefix("urn:x-page:")
    return int(x) if x.lstrip("-").isdigit() else None


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _write(folder: str, dictionary: bytes, most: int):
    """Rows (page_id, url, html, response) -> archives of the task, and their names. Names are the attempt's own: a task that is run again writes other
    files, and the manifest has those of the attempt that counts."""

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        task, k, out, n = TaskContext.get(), 0, None, 0
        lead = dictionary_frame(dictionary) if dictionary else b""
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        done = []

        def name():
            return f"{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}.warc.zst"

        def close():
            nonlocal out, n, k
            out.close()
            done.append((name(), n))
            out, n, k = None, 0, k + 1

        for b in sliced(batches):
            for page, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name()}", compression=None)
                    out.write(lead)
                own = first is None or page is None or page == first
                out.write(zstd.compress(record("response" if own else "revisit", page, url, (html or "").encode("utf-8", "surrogatepass"), first)))
                n += 1
                if out.tell() >= most:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["name", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, most: int = ARCHIVE_BYTES, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for every row into archives in a folder that all machines share; returns (name, records) of each archive.

    Of rows with equal payloads of at least min_bytes, those with the smallest id are responses, the others revisits of it.
    Null html is an empty payload; a row with a null id is always a response; null url: the record's own id as URI. Repeated
    rows are repeated records. Empty table: no archive.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), string_of(html).alias("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = small(written(groups.where("n > 1").select("sha", "first"), "warc-groups"), MOST_GROUPS)
    sample = [r.html.encode("utf-8", "surrogatepass")[:DICT_ROW_BYTES] for r in rows.select(F.substring("html", 1, DICT_ROW_BYTES).alias("html")).limit(DICT_ROWS).collect()]
    linked = rows.join(groups, "sha", "left").select("page_id", "url", "html", F.when(F.octet_length("html") >= min_bytes, F.col("first")).alias("first"))
    return written(linked.mapInArrow(_write(folder, train_dictionary(sample), most), "name string, records long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that manifest (name, ...) names, each checked; a bad one fails the job.

    (archive, offset, page_id, record_type, url, payload_bytes, payload_digest, refers_to, and payload if asked for).
    """
    names = ["archive", "offset", "page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        fs, root = _filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for at, r in records(f):
                        rows.append((name, at, _page(r["id"]), r["type"], r["uri"], r["length"], r["digest"], _page(r["refers_to"]), *[r["payload"]] * payloads))
                        held += len(r["payload"] or b"") * payloads
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "archive string, offset long, page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("name").repartition(n).mapInArrow(run, schema)


def op6_warc(spark, sf_dir):
    """All pages written as archives and read back."""
    folder = fresh_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_FIVE = "(('0x' || substr(h, 5 * k + 1, 5))::INTEGER >> {}) & 31"
_BASE32 = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[({_FIVE.format(s)}) + 1]" for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {_BASE32}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
