"""What the operators of this subpackage share: where tables go that cut lineage, free names, and slices of texts."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is these six ASCII characters and nothing else; all else is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that a Python task works on at once, or one text if it is longer.
SLICE_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``. Local sessions (tests) may go without; clusters must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    if found.startswith("file:/") and not found.startswith("file://"):
        found = f"file://{found[5:]}"  # the form that all file systems' libraries read
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder, so that a lost executor costs a reread and no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def sparing(spark: SparkSession, batch_bytes: str = "4m") -> Iterator[None]:
    """Within it, what an action shuffled is removed when the action ends, and batches of rows for Python are small; the
    session's own settings come back after. For actions: frames that outlive it are run by the session's settings."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": batch_bytes}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Return a worker's free memory to the system, so that one large group does not stay with it for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which may not have it


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a table of one's own that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column of ``df`` has in any case."""
    taken, k, out = {c.lower() for c in df.columns}, 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def document_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text (null: empty) of ``docs``, whatever other columns it has."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column, modulus: int) -> Column:
    """True for rows kept from training: crc32 of the id as text has remainder 2 (a null id counts as the text '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 2


def text_slices(texts: pa.Array, limit: int | None = None) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of each text (null is empty), in lists of about ``limit`` bytes, whatever a batch holds."""
    limit, part, size = limit or SLICE_BYTES, [], 0
    for x in texts.cast(pa.large_binary()):
        data = x.as_py() or b""
        part.append(data)
        size += len(data)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part
