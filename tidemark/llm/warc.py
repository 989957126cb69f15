"""WARC archives with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records themselves. Every archive begins with a skippable frame that
holds the dictionary, and then has one frame for each record, so that records are read singly and archives by
themselves. Archives are files of about ``TARGET`` compressed bytes below a shared folder; the files that a task wrote
count only when the manifest, a table that Spark commits, has them, so the leavings of lost tasks are never read.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one of the smallest page_id is a response and the
others are revisits, which carry no payload but its digest and length. That is one aggregation by digest and one join,
of which adaptive execution splits a very frequent digest.

Defined results: a null html is an empty payload; a null url has no target URI; a null page_id is larger than any other
and, if its payload has no other page, a response; pages of one id and one payload are all responses if the id is the
smallest; extra columns are ignored; an empty table gives an empty result and archives without records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir

MIN_REVISIT = 100
DICTIONARY_MAGIC = 0x184D2A5D  # fixed value: the skippable frame of a dictionary
TARGET = 16 << 20
LEVEL = 6
#: Bounds of the dictionary and of its sample: records, and bytes of a record.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 64 << 10, 500, 16 << 10
DATE = "1970-01-01T00:00:00Z"  # pages tell no time of capture
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
#: File names up to this many are broadcast to tell committed archives from others.
FEW_FILES = 200_000
READ = 8 << 10


def _safe(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _urn(page_id) -> str:
    """A record's name; an id of any text stays on its line and comes back as it was, and there may be none."""
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A WARC 1.1 record: a revisit if ``refers_to`` names a response."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Payload-Length", str(size))]
        block = b""
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's page_id, type, refers_to, payload (None for revisits), payload_digest and payload_bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    name = lambda key: unquote(field[key][len("<urn:x-page:") : -1]) if field.get(key, "").startswith("<urn:x-page:") else None
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": name("WARC-Record-ID"), "record_type": field["WARC-Type"], "refers_to": name("WARC-Refers-To"), "url": field.get("WARC-Target-URI")}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_digest": digest, "payload_bytes": int(field["X-Payload-Length"])}
    payload = block.partition(b"\r\n\r\n")[2]
    found = hashlib.sha256(payload).hexdigest()
    if found != digest:
        raise ValueError(f"payload of page {out['page_id']} does not have its digest")
    return out | {"payload": payload, "payload_digest": found, "payload_bytes": len(payload)}


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records, empty if they are too few or too alike for one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, records)) // 10)), records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def opening(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(data):
    """Each record of an archive, decompressed with the dictionary that it begins with."""
    view, at, dictionary = memoryview(data), 0, b""
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        dictionary, at = bytes(view[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(view):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            parts.append(one.decompress(view[at : at + READ]))
            at += len(view[at : at + READ])
        at -= len(one.unused_data)
        yield b"".join(parts)


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    again = (
        rows.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("payload_digest", "first_id")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(again, "payload_digest", "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", refers.alias("refers_to")
    )


def _records(rows) -> list[bytes]:
    return [record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["payload_bytes"], r["refers_to"]) for r in rows]


def sample_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of the records of least id hashes, ``SAMPLE`` at most of ``SAMPLE_BYTES`` at most."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    fit = pages.where(F.octet_length(payload) <= SAMPLE_BYTES)
    ids = [r[0] for r in fit.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    if not ids:
        return b""
    rows = fit.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min_by(F.struct("url", "html"), F.xxhash64("html")).alias("p")).select("page_id", "p.*")
    full = rows.select("page_id", "url", "html", F.octet_length(payload).alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), F.lit(None).alias("refers_to"))
    return train_dictionary(_records(sorted(full.collect(), key=lambda r: r["page_id"])))


def write(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Archives below ``folder`` and their manifest (file, records, bytes), the latter as a committed table."""
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def archive(batches):
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        task, out, name, n, size, k = TaskContext.get(), None, "", 0, 0, 0
        for batch in batches:
            for row in (one for i in range(batch.num_rows) for one in _records(batch.slice(i, 1).to_pylist())):
                if out is None:
                    # a name of its own for every attempt of a task
                    name, n, size, k = f"part-{task.partitionId():06d}-{k:04d}-{uuid.uuid4().hex}.warc.zst", 0, 0, k + 1
                    out = store.open_output_stream(f"{root}/archives/{name}", compression=None)  # not by its suffix
                    size += out.write(opening(shared.value)) if shared.value else 0
                size += out.write(squeeze.compress(row))
                n += 1
                if size >= TARGET:
                    out.close()
                    out = None
                    yield pa.record_batch([[name], [n], [size]], names=["file", "records", "bytes"])
        if out is not None:
            out.close()
            yield pa.record_batch([[name], [n], [size]], names=["file", "records", "bytes"])

    classified(pages).mapInArrow(archive, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read(spark, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the committed archives below ``folder``."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file")
    if manifest.isEmpty():
        paths = None
    else:
        names = F.broadcast(manifest) if manifest.count() <= FEW_FILES else manifest
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives").withColumn("file", F.element_at(F.split("path", "/"), -1))
        paths = files.join(names, "file", "left_semi").select("content")
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    columns = [c.split()[0] for c in schema.split(", ")]

    def records(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for one in frames(data.as_buffer()):
                    rows.append(parse(one))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in columns], names=columns)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in columns], names=columns)

    kinds = {c: pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string() for c in columns}
    if paths is None:
        return spark.createDataFrame([], schema)
    return paths.mapInArrow(records, schema)


def op7_warc(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, sample_dictionary(pages))
    kind = pages.schema["page_id"].dataType
    return read(spark, folder).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
