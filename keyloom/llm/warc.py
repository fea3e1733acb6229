"""WARC archives in Zstandard: a writer, and a reader that takes one frame per record.

An archive begins with a skippable frame that holds its dictionary; every record is a frame of its own, compressed with
it. Writer tasks put archives of bounded size into a shared folder under names that no other attempt uses and report
them; only reported archives are read, so a lost or repeated task leaves nothing behind that counts. The reader streams:
it holds one record and one block of the file at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpointed

#: Payloads shorter than this are stored each time.
LEAST_REVISITED = 1000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: A dictionary is trained on the first payloads of its archive: at most so many, of each at most so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16 << 10, 16 << 10
_SKIPPABLE, _ZSTD, _BLOCK = 0x184D2A5D, b"\x28\xb5\x2f\xfd", 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is not well formed."""


def record_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, payload (UTF-8; null: empty), digest (SHA-1, hex) and refers_to: null for a response, else the page whose payload is the same.

    Of rows with equal payloads of LEAST_REVISITED bytes or more, those with the largest key are responses and the others
    refer to it; rows with a null key refer too, if a key exists.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_REVISITED
    kept = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "keeper")
    joined = rows.join(kept, large & (F.col("digest") == F.col("same")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")).alias("refers_to"))


def _name(page: int | None) -> str:
    return f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else _name(page).strip("<>")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """None where there is too little to learn from."""
    samples = [s[:SAMPLE_BYTES] for s in samples if s]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes record_types() rows into archives under folder (a URI that all machines share). Returns their path, records and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n, pack = None, "", 0, 0, None

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for k in range(0, batch.num_rows, SAMPLES):
                rows = batch.slice(k, SAMPLES).to_pylist()
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                    learned = _dictionary([r["payload"] for r in rows])
                    pack = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True)
                    if learned is not None:
                        raw = zstandard.ZstdCompressor(level=3).compress(learned.as_bytes())
                        size += out.write(struct.pack("<II", _SKIPPABLE, len(raw)) + raw) or 8 + len(raw)
                for r in rows:
                    frame = pack.compress(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                    out.write(frame)
                    size += len(frame)
                    n += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records bigint, bytes bigint")


def _frames(stream) -> Iterator[bytes]:
    """The content of every frame after the dictionary's."""
    data = stream.read(_BLOCK)
    unpack = zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == _SKIPPABLE:
        n = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + n:
            if not (more := stream.read(_BLOCK)):
                raise WarcError("the dictionary's frame is cut off")
            data += more
        raw, data = data[8 : 8 + n], data[8 + n :]
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == _ZSTD else raw
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while data or (data := stream.read(_BLOCK)):
        one, parts = unpack.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(_BLOCK)):
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def parse_record(content: bytes) -> dict:
    """The one record that a frame holds, its headers, lengths and digest checked."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or first not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC record: {first[:40]!r}")
    fields: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if not colon:
            raise WarcError(f"no header: {x[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for x in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if x not in fields:
            raise WarcError(f"{x} is missing")
    if not fields["content-length"].isdigit() or len(rest) != (n := int(fields["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {fields['content-length']}; {len(rest) - 4} bytes are there")
    kind, payload = fields["warc-type"], rest[:n].partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields.get("warc-payload-digest", "").partition(":")[2]).hex()
    if kind == "response":
        if digest != hashlib.sha1(payload).hexdigest():
            raise WarcError(f"{fields['warc-record-id']}: the payload doesn't have its digest")
        if len(payload) != int(fields.get("warc-payload-length", len(payload))):
            raise WarcError(f"{fields['warc-record-id']}: the payload doesn't have its length")
    elif "warc-refers-to" not in fields:
        raise WarcError(f"{fields['warc-record-id']}: a revisit of nothing")

    def page(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    return {"page_id": page("warc-record-id"), "payload_bytes": int(fields.get("warc-payload-length", len(payload))), "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


_FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that write_archives() reported. Anything not well formed raises WarcError, as do missing records."""
    names = _FIELDS.names if payloads else _FIELDS.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([_FIELDS.field(x) for x in names])
        for batch in batches:
            for archive in batch.to_pylist():
                held, size, n = [], 0, 0
                with fs.open_input_stream(archive["path"], compression=None) as stream:
                    for content in _frames(stream):
                        held.append(parse_record(content))
                        n += 1
                        size += len(content) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != archive["records"]:
                    raise WarcError(f"{archive['path']}: {n} records of {archive['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"int64": "bigint", "string": "string", "binary": "binary"}
    return archives.mapInArrow(run, ", ".join(f"{x} {kinds[str(_FIELDS.field(x).type)]}" for x in names))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Writes a record per row of pages and reads all archives again. An empty table makes no archive and no rows."""
    written = checkpointed(write_archives(record_types(pages), folder))
    return read_archives(written.repartition(max(1, min(written.count(), 10_000)), "path"), folder, payloads)
