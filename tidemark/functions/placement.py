"""Placement algebra: partitions, homes and ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV offset and prime, and the most machines that an id can name.
FNV_OFFSET, FNV_PRIME, WORD = 2166136261, 16777619, 1 << 32
MAX_MACHINES = 100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fnv1(key, n_bytes: int = 0) -> Column:
    """32-bit FNV-1 (multiply, then xor) of the first bytes of an ASCII key; 0 stands for all of them."""
    text = _c(key) if not n_bytes else F.substring(_c(key), 1, n_bytes)
    bytes_ = F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(bytes_, F.lit(FNV_OFFSET).cast("long"), lambda h, b: F.pmod(h * F.lit(FNV_PRIME), F.lit(WORD)).bitwiseXOR(b))


def hash_partition(key, partitions: int, n_bytes: int = 0) -> Column:
    return F.pmod(fnv1(key, n_bytes), F.lit(partitions))


def simple_partition(key, partitions: int) -> Column:
    return F.pmod(_c(key).cast("long"), F.lit(partitions).cast("long"))


def simple_home(key, partitions: int, regions: int) -> Column:
    return F.pmod(F.floor(_c(key).cast("long") / partitions), F.lit(regions).cast("long"))


def warehouse_partition(w_id, partitions: int) -> Column:
    return F.pmod(_c(w_id) - 1, F.lit(partitions))


def warehouse_home(w_id, partitions: int, regions: int) -> Column:
    return F.pmod(F.floor((_c(w_id) - 1) / partitions), F.lit(regions).cast("long"))


def machine(region, partition, partitions: int) -> Column:
    return _c(region) * partitions + _c(partition)


def machine_region(machine_id, partitions: int) -> Column:
    return F.floor(_c(machine_id) / partitions)


def machine_partition(machine_id, partitions: int) -> Column:
    return F.pmod(_c(machine_id), F.lit(partitions))


def unique_id(counter, machine_id) -> Column:
    """Ids of transactions and batches: a machine's counter, then the machine."""
    return _c(counter) * MAX_MACHINES + _c(machine_id)


def replication_target(region, local, partitions: int, regions: int) -> Column:
    """The partition of another region that a batch of the local region is sent to."""
    return F.pmod(F.pmod(_c(region) + regions - _c(local), F.lit(regions)), F.lit(partitions))


def key_replica(key, home) -> Column:
    """The name of a key's lock in a region."""
    return F.concat_ws(":", _c(key).cast("string"), _c(home).cast("string"))
