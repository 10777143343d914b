"""A store of all keys a stream has written, which a batch reads only where its own keys lie."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina.operators.durable import keep, names_in, read_note, write_note

# Bits of the bucket number of an empty store, and keys for each bucket from which one more is used.
FIRST_BITS = 4
KEYS_PER_BUCKET = 200_000

_SCHEMA = "key string, bits int, bucket long, batch long"


@dataclass(frozen=True)
class State:
    """What was stored before a batch: keys, rows written, rows seen, and the bits in use."""

    bits: int = FIRST_BITS
    keys: int = 0
    rows: int = 0
    seen: int = 0


class KeyStore:
    """Keys in folders ``keys/bits=D/bucket=B/batch=N`` and totals in ``log/N.json``.

    A key's bucket is the last ``bits`` bits of its hash. A batch adds one file to each
    bucket its new keys fall in and reads, of earlier batches, only buckets that its own
    keys fall in. Whenever the store holds ``per_bucket`` keys for every
    bucket, later batches use one bit more; what was written before stays where it is
    and is looked up by its own bits. So no file of keys is ever rewritten, and the keys in
    a bucket are bounded for each number of bits.

    Everything a batch writes depends on the batch and on earlier ones alone and replaces
    what an interrupted attempt left; its totals are written last. A batch that is
    run again therefore reads and writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, per_bucket: int = KEYS_PER_BUCKET):
        self.spark, self.path, self.per_bucket = spark, path, per_bucket

    def begun(self) -> bool:
        return bool(self._logged())

    def before(self, batch_id: int) -> State:
        """The state that the batch meets."""
        note = read_note(self.spark, self._note(batch_id - 1))
        if note is None:
            earlier = [b for b in self._logged() if b < batch_id]
            note = read_note(self.spark, self._note(max(earlier))) if earlier else "{}"
        return State(**json.loads(note))

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Which of the distinct keys (key) an earlier batch has stored; kept."""
        bits = self.before(batch_id).bits
        # At most one number for each bucket.
        touched = {r["b"] for r in keys.select(_bucket(F.col("key"), bits).alias("b")).distinct().collect()}
        stored = self._read(touched, batch_id)
        found = keys.join(stored, "key", "left_semi") if stored is not None else keys.limit(0)
        return keep(found, "known")

    def add(self, batch_id: int, keys: DataFrame, rows: int, seen: int) -> None:
        """Store a batch's new distinct keys (key), and the rows it wrote and saw."""
        state = self.before(batch_id)
        placed = keys.select(
            "key", F.lit(state.bits).alias("bits"), _bucket(F.col("key"), state.bits).alias("bucket"),
            F.lit(batch_id).cast("long").alias("batch"),
        )
        # What an interrupted attempt at this batch wrote is the same and is replaced.
        (
            placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bits", "bucket", "batch").parquet(f"{self.path}/keys")
        )
        stored = state.keys + keys.count()
        bits = state.bits
        while stored > self.per_bucket << bits:
            bits += 1
        after = State(bits, stored, state.rows + rows, state.seen + seen)
        write_note(self.spark, self._note(batch_id), json.dumps(asdict(after)))

    def _read(self, touched: set[int], batch_id: int) -> DataFrame | None:
        """Keys of earlier batches in the touched buckets, whatever bits they were stored with."""
        paths = []
        for level in names_in(self.spark, f"{self.path}/keys"):
            own = {b & ((1 << int(level.removeprefix("bits="))) - 1) for b in touched}
            there = names_in(self.spark, f"{self.path}/keys/{level}")
            paths += [f"{self.path}/keys/{level}/{b}" for b in there if int(b.removeprefix("bucket=")) in own]
        if not paths:
            return None
        table = self.spark.read.schema(_SCHEMA).option("basePath", f"{self.path}/keys").parquet(*paths)
        return table.where(F.col("batch") < batch_id).select("key")

    def _note(self, batch_id: int) -> str:
        return f"{self.path}/log/{batch_id}.json"

    def _logged(self) -> list[int]:
        names = names_in(self.spark, f"{self.path}/log")
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def _bucket(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
