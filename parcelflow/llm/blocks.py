"""Documents in blocks of a few megabytes, and the keys that recur between them.

Operators that compare all documents with each other read texts in blocks: one row holds the texts of many
documents, compressed, so that moving texts costs no more than storing them and the work inside is numpy's.

``recurring`` finds the keys that occur more than once in all blocks: every block sends its distinct keys to
buckets, a bucket looks for keys of several blocks, and the blocks get back which of theirs recur.  A key
is 32 bits beside its bucket, so now and then two keys are taken for one: what comes back is a superset, to be
confirmed by whoever asked.  A block sends a key once, however often it holds it, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BLOCK_DOCS = 1 << 16
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which sorts last

_BLOCK = "block long, n_docs long, n_bytes long, ids array<long>, ends array<long>, data binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in blocks, written once. Within a block documents are ordered by id, a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=ids.__getitem__)
            parts = [texts[i] for i in order]
            row = {
                "block": pa.array([number], pa.int64()),
                "n_docs": pa.array([len(ids)], pa.int64()),
                "n_bytes": pa.array([held], pa.int64()),
                "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum([len(t) for t in parts])], pa.list_(pa.int64())),
                "data": pa.array([press.compress(b"".join(parts))], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(NO_ID if name is None else name)
                    texts.append(text or b"")
                    held += len(texts[-1])
                    if held >= block_bytes or len(ids) == BLOCK_DOCS:
                        yield flush()
                        number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield flush()

    from parcelflow.scratch import materialize  # here, as this module travels with the tasks

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return materialize(texts.mapInArrow(run, _BLOCK), "blocks")


class Block:
    """An unpacked block: number, ids, where each document starts and ends in ``data``."""

    def __init__(self, number: int, ids, ends, data: bytes) -> None:
        self.number, self.ids = int(number), np.asarray(ids, np.int64)
        self.ends = np.asarray(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(data)

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def unpack(rows: pd.DataFrame) -> Block:
    r = rows.iloc[0]
    return Block(r["block"], r["ids"], r["ends"], r["data"])


def names(ids: np.ndarray) -> pa.Array:
    """Ids as a column, null where there was none."""
    return pa.array(ids, pa.int64(), mask=np.asarray(ids) == NO_ID)


def as_series(ids: np.ndarray) -> pd.Series:
    """Ids as a nullable pandas column."""
    return pd.Series(pd.arrays.IntegerArray(np.asarray(ids, np.int64).copy(), np.asarray(ids) == NO_ID))


def buckets_for(blocks: DataFrame, keys_per_byte: float, keys_per_bucket: int = 1 << 20) -> int:
    """How many buckets hold the keys of all blocks, given how many keys a byte of text yields."""
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(1, int(size * keys_per_byte / keys_per_bucket) + 1)


def split_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (from the high bits) and 32-bit key of 64-bit hashes."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return bucket.astype(np.int64), keys.astype(np.uint32)


def sent(number: int, keys: np.ndarray, twice: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows (bucket, block, keys, twice) of the distinct 64-bit keys of a block; ``twice`` marks those it holds repeatedly,
    or is the number of each as a byte, for ``counted``."""
    bucket, low = split_keys(keys, buckets)
    order = np.lexsort((low, bucket))
    bucket, low, twice = bucket[order], low[order], twice[order]
    found, starts = np.unique(bucket, return_index=True)
    stops = np.append(starts[1:], len(bucket))
    return pd.DataFrame(
        {
            "bucket": found,
            "block": np.full(len(found), number, np.int64),
            "keys": [low[a:b].tobytes() for a, b in zip(starts, stops)],
            "twice": [(np.packbits(twice[a:b]) if twice.dtype == bool else twice[a:b]).tobytes() for a, b in zip(starts, stops)],
        }
    )


SENT = "bucket long, block long, keys binary, twice binary"


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and whether each occurs more than once."""
    found, counts = np.unique(keys, return_counts=True)
    return found, counts > 1


def recurring(sent_keys: DataFrame, hot_from: int = 1) -> DataFrame:
    """(block, bucket, keys, hot): for every block the keys it sent that recur anywhere.

    ``hot`` has a bit for each key that ``hot_from`` blocks or more sent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)).astype(bool) for t, p in zip(pdf["twice"], parts)]
        keys = np.concatenate(parts)
        found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        recur = counts > 1
        recur[inverse[np.concatenate(twice)]] = True
        at, out, hot = 0, [], []
        for p in parts:
            mine = inverse[at : at + len(p)]
            at += len(p)
            keep = recur[mine]
            out.append(p[keep].tobytes())
            hot.append(np.packbits(counts[mine[keep]] >= hot_from).tobytes())
        made = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "keys": out, "hot": hot})
        return made[made["keys"].str.len() > 0]

    return sent_keys.groupBy("bucket").applyInPandas(run, "block long, bucket long, keys binary, hot binary")


def counted(sent_keys: DataFrame) -> DataFrame:
    """(block, bucket, keys, sizes): as ``recurring``, for keys sent with their number in the block instead of ``twice``.

    ``sizes`` has a byte for each key that recurs: the logarithm of its number in all blocks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([np.frombuffer(t, np.uint8) for t in pdf["twice"]])
        total = np.bincount(inverse, weights=own, minlength=len(found))
        size = np.log2(total).astype(np.uint8)
        at, keys, sizes = 0, [], []
        for p in parts:
            mine = inverse[at : at + len(p)]
            at += len(p)
            keep = total[mine] > 1
            keys.append(p[keep].tobytes())
            sizes.append(size[mine[keep]].tobytes())
        made = pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "keys": keys, "sizes": sizes})
        return made[made["keys"].str.len() > 0]

    return sent_keys.groupBy("bucket").applyInPandas(run, "block long, bucket long, keys binary, sizes binary")


def sizes_of(keys: np.ndarray, rows: pd.DataFrame, buckets: int) -> np.ndarray:
    """For 64-bit keys of a block the size that came back; -1 for a key that does not recur."""
    out = np.full(len(keys), -1, np.int64)
    if len(rows) == 0 or len(keys) == 0:
        return out
    lists = [np.frombuffer(k, np.uint32) for k in rows["keys"]]
    whole = np.concatenate([np.uint64(b) << np.uint64(32) | k.astype(np.uint64) for b, k in zip(rows["bucket"].tolist(), lists)])
    sizes = np.concatenate([np.frombuffer(s, np.uint8) for s in rows["sizes"]])
    order = np.argsort(whole)
    bucket, low = split_keys(keys, buckets)
    wanted = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
    at = np.minimum(np.searchsorted(whole, wanted, sorter=order), len(whole) - 1)
    hit = whole[order[at]] == wanted
    out[hit] = sizes[order[at[hit]]]
    return out


def hot_only(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the keys that came back for a block, those of many blocks."""
    kept = []
    for keys, hot in zip(rows["keys"], rows["hot"]):
        k = np.frombuffer(keys, np.uint32)
        kept.append(k[np.unpackbits(np.frombuffer(hot, np.uint8), count=len(k)).astype(bool)].tobytes())
    return rows.assign(keys=kept)


def known(keys: np.ndarray, rows: pd.DataFrame, buckets: int) -> np.ndarray:
    """Which 64-bit keys of a block are among those that came back for it."""
    if len(rows) == 0 or len(keys) == 0:
        return np.zeros(len(keys), bool)
    lists = [np.frombuffer(k, np.uint32) for k in rows["keys"]]
    whole = np.concatenate([np.uint64(b) << np.uint64(32) | k.astype(np.uint64) for b, k in zip(rows["bucket"].tolist(), lists)])
    bucket, low = split_keys(keys, buckets)
    return np.isin(bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), whole)


def by_block(blocks: DataFrame, extra: DataFrame, work: Callable[[Block, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on every block together with its rows of ``extra``."""
    columns = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0:
            return pd.DataFrame(columns=columns)
        return work(unpack(left), right)

    texts = blocks.select("block", "ids", "ends", "data")
    return texts.groupBy("block").cogroup(extra.groupBy("block")).applyInPandas(run, schema)


def each_block(blocks: DataFrame, work: Callable[[Block], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on every block where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                number, ids, ends, data = (batch.column(c)[k].as_py() for c in range(4))
                made = work(Block(number, ids, ends, data))
                yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    return blocks.select("block", "ids", "ends", "data").mapInArrow(run, schema)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        n = len(out) - step
        np.minimum(out[:n], out[step:], out=out[:n])
        out, done = out[:n], done + step
    return out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash of every ``width`` neighbours; the leftmost on ties of the upper bits."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    placed = hashes & ~mask
    placed |= np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(placed, width)
    least &= mask
    return least.view(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``mask`` holds."""
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
