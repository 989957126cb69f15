"""Binary data files: a varint count, then for each datum its size as a varint and the message.

A message has three fields: key and record (bytes) and master (a number). A file is a partition's share of the initial
data, so it is read by one task, and its datums leave it in small batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placement as P

SCHEMA = "key binary, record binary, master long, file string, place long"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n % 128 + 128)
        n //= 128
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte % 128) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def encode(key: bytes, record: bytes, master: int) -> bytes:
    body = b"\x0a" + _varint(len(key)) + key + b"\x12" + _varint(len(record)) + record
    return body + (b"\x18" + _varint(master) if master else b"")


def decode(body) -> tuple[bytes, bytes, int]:
    key, record, master, at = b"", b"", 0, 0
    while at < len(body):
        tag, at = _read_varint(body, at)
        value, at = _read_varint(body, at)
        if tag % 8 == 2:
            part, at = bytes(body[at : at + value]), at + value
            key, record = (part, record) if tag >> 3 == 1 else (key, part)
        else:
            master = value
    return key, record, master


def frames(data) -> Iterator[tuple[bytes, bytes, int]]:
    """Datums of a file."""
    count, at = _read_varint(data, 0)
    for _ in range(count):
        size, at = _read_varint(data, at)
        yield decode(data[at : at + size])
        at += size


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Datums of all .dat files of a folder, with file name and place; a folder without any gives an empty table."""

    def rows(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, name = [], path.rsplit("/", 1)[-1]
                for k, datum in enumerate(frames(memoryview(data.as_buffer()).cast("B"))):
                    found.append((*datum, name, k))
                    if len(found) == 10_000:
                        yield _batch(found)
                        found = []
                yield _batch(found)

    def _batch(found):
        cols = list(zip(*found)) if found else [()] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64()))], names=["key", "record", "master", "file", "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(folder).select("path", "content")
    return files.mapInArrow(rows, SCHEMA)


def write(data: DataFrame, folder: str) -> int:
    """One file <part>.dat for each partition number in ``part``; how many. data: key, record (binary), master, part.

    A task writes a part's file under a name of its own and then renames it, so a second attempt only replaces it.
    """

    def save(batches: Iterable[pa.RecordBatch]):
        import uuid

        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["part"], []).append(encode(bytes(r["key"]), bytes(r["record"]), r["master"]))
        for part, bodies in held.items():
            name = f"{root}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(name, compression=None) as out:
                out.write(_varint(len(bodies)))
                for b in bodies:
                    out.write(_varint(len(b)) + b)
            store.move(name, f"{root}/{part}.dat")
            yield pa.record_batch([pa.array([part], pa.int64())], names=["part"])

    parts = data.select(F.col("part").cast("long").alias("part"), "key", "record", F.col("master").cast("long").alias("master"))
    return parts.repartition("part").mapInArrow(save, "part long").count()


def generate(spark: SparkSession, n: int, record_size: int, regions: int, partitions: int) -> DataFrame:
    """Offline data: key = base64 of the number's 8 bytes, master = number mod regions, part by FNV of the key."""
    from ..functions.strings import base64_le

    rows = spark.range(n).select(base64_le("id").alias("text"), F.pmod("id", F.lit(regions)).alias("master"), "id")
    record = F.substring(F.repeat(F.sha2(F.col("id").cast("string"), 256), record_size // 64 + 1), 1, record_size)
    return rows.select(F.col("text").cast("binary").alias("key"), record.cast("binary").alias("record"), "master", P.hash_partition("text", partitions).alias("part"))


def records_for(total_bytes: int, record_size: int) -> int:
    """How many records make up so many bytes, with a key of 12 characters and two bytes of framing."""
    return total_bytes // (12 + record_size + 2)


def invalid(data: DataFrame, part_of_key: Column, regions: int) -> DataFrame:
    """Datums of a wrong file, or of a region that there isn't."""
    return data.where((part_of_key != F.col("part")) | (F.col("master") >= regions) | (F.col("master") < 0))


def load(data: DataFrame, part_of_key: Column, regions: int) -> DataFrame:
    """The store's first rows; a wrong datum fails the job."""
    wrong = (part_of_key != F.col("part")) | (F.col("master") >= regions) | (F.col("master") < 0)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("datum out of place: "), F.col("key").cast("string")))).otherwise(F.col("key").cast("string"))
    return data.select(checked.alias("key"), F.col("record").cast("string").alias("value"), "master", F.lit(0).alias("counter"))
