"""WARC archives: a monolithic writer, the normaliser to one gzip member per record, and a reader by sidecar index.

1. `write_monolithic`: each scan partition writes its pages as response records into archives that are one gzip stream each
   (a new archive every ROLL_BYTES), without a shuffle, and returns one row of facts per record.
2. `revisits`: of records with equal payload digests the smallest identifier is the response, the others revisit it. Only
   digests and identifiers are shuffled; a common digest is pre-aggregated, and the join back may be split anywhere.
3. `normalise`: each monolithic archive is inflated once, as a stream; every record becomes a gzip member of its own, as a
   response or, without its payload, as a revisit; a sidecar of JSON lines tells offset and length of each member.
4. `read_records`: opens members by their offsets, checks payload against digest, and returns one row per record.

Files lie in the folder all executors share and carry a name that no other attempt of a task uses; only those whose task
succeeded are ever listed, so lost executors and repeated attempts leave nothing but unused files.

Defined results: a null payload counts as empty. Payloads under MIN_REVISIT bytes are always responses. Null identifiers
come after all others, and a record refers to null only if all of its copies have null identifiers, in which case all are
responses. Rows repeated with one identifier and payload are alike: all responses or all revisits. A null url is "urn:none".
Lone pages, empty tables and very long payloads need nothing special; a record is held in memory, an archive never.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

ROLL_BYTES = 32 << 20
MIN_REVISIT = 100
CHUNK = 1 << 20
FAST, SMALL = 1, 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, by the scheme of its address (none, or file:, for a mounted one)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record(identifier: str | None, url: str | None, payload: bytes | None, digest: str, n: int, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length tells the payload's size, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{quote(x, safe='')}>" if x is not None else "<urn:page>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(identifier)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%') if url is not None else 'urn:none'}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[-2:-2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _identifier(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in chunks."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield z.decompress(chunk)
            chunk = b""
            if z.eof:
                chunk = z.unused_data
                z = zlib.decompressobj(31)
    yield z.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    buffer = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        for c in chunks:
            if c:
                buffer.extend(c)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("archive ends within a record")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        head["version"] = lines[0]
        size = int(head["content-length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise ValueError("archive ends within a record")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]


def write_monolithic(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Facts of the records written: archive, place (in the archive), id, digest, n_bytes."""
    folder = scratch_path(pages.sparkSession, "warc-monolithic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_folder(folder)
        system.create_dir(path, recursive=True)
        out, place, name, size = None, 0, "", 0
        for b in batches:
            names, places, digests, sizes = [], [], [], []
            for i, key, url in zip(range(b.num_rows), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                payload = b.column(3)[i].as_buffer().to_pybytes()
                if out is None:
                    name, place, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    raw = system.open_output_stream(name, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=FAST, mtime=0)
                digest = hashlib.sha256(payload)
                out.write(record(key, url, payload, digest.hexdigest(), len(payload), None, False))
                names.append(name)
                places.append(place)
                digests.append(digest.digest())
                sizes.append(len(payload))
                place, size = place + 1, size + len(payload)
                if size >= ROLL_BYTES:
                    out.close()
                    raw.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["archive", "place", "id", "digest", "n_bytes"])
        if out is not None:
            out.close()
            raw.close()

    rows = pages.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    return materialize(rows.mapInArrow(run, f"archive string, place long, id {rows.schema['id'].dataType.simpleString()}, digest binary, n_bytes long"), "warc-facts")


def revisits(facts: DataFrame) -> DataFrame:
    """facts with first: the identifier that the record revisits, null for responses."""
    copies = facts.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null")
    out = facts.join(copies.select("digest", "first"), "digest", "left")
    return out.withColumn("first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))


def normalise(decided: DataFrame) -> DataFrame:
    """Archives rewritten with one gzip member per record, each with a sidecar index: archive, sidecar, n_records."""
    folder = scratch_path(decided.sparkSession, "warc-members")

    def run(table: pa.Table) -> pa.Table:
        # The decisions of one archive: as many rows as it has records, and bounded like it.
        old = table.column("archive")[0].as_py()
        refers = dict(zip(table.column("place").to_pylist(), table.column("first").to_pylist(), strict=True))
        system, path = _open_folder(folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        with system.open_input_stream(old, compression=None) as source, system.open_output_stream(name, compression=None) as out, system.open_output_stream(name + ".idx", compression=None) as index:
            offset = 0
            for place, (head, block) in enumerate(records(inflated(source))):
                first = refers[place]
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                payload = block.partition(b"\r\n\r\n")[2]
                url = head["warc-target-uri"]
                member = gzip.compress(record(_identifier(head["warc-record-id"]), None if url == "urn:none" else unquote(url), payload, digest, len(payload), first, first is not None), SMALL, mtime=0)
                out.write(member)
                index.write(json.dumps({"id": head["warc-record-id"], "type": "response" if first is None else "revisit", "offset": offset, "length": len(member)}).encode() + b"\n")
                offset += len(member)
        return pa.table([[name], [name + ".idx"], pa.array([place + 1], pa.int64())], names=["archive", "sidecar", "n_records"])

    own = decided.select("archive", "place", F.col("first").cast("string").alias("first"))
    # The decisions are few bytes, but each archive stands for ROLL_BYTES to rewrite: a number given by hand is not merged by AQE.
    own = own.repartition(int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive")
    return materialize(own.groupBy("archive").applyInArrow(run, "archive string, sidecar string, n_records long"), "warc-archives")


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record, read member by member: id and refers_to as strings, payload_bytes, payload_digest, record_type."""
    folder = archives.sparkSession.conf.get("spark.checkpoint.dir", None) or archives.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open_folder(folder)
        for b in batches:
            for name, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_stream(sidecar, compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                out = [[] for _ in range(5)]
                with system.open_input_file(name) as f:
                    for entry in index:
                        ((head, block),) = records([gzip.decompress(f.read_at(entry["length"], entry["offset"]))])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        for column, v in zip(out, (_identifier(head["warc-record-id"]), n, digest, head["warc-type"], _identifier(head.get("warc-refers-to"))), strict=True):
                            column.append(v)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "sidecar").repartition(tasks, "archive").mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Steps 1 to 3: the normalised archives of pages. The monolithic ones are removed once all is rewritten."""
    facts = write_monolithic(pages, id_col, url_col, payload_col)
    done = normalise(revisits(facts))
    first = facts.select("archive").first()
    if first:
        system, _ = _open_folder(scratch_path(pages.sparkSession, "any"))
        system.delete_dir(first[0].rpartition("/")[0])
    return done
