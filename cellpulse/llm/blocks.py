"""Blocks of documents, and questions about keys that many blocks share.

A block holds some MB of whole documents, chosen by a hash of id and text, so a hot source or a group
of copies spreads over all blocks. Operators look at a block with NumPy, ask about its distinct keys
(a key travels once per block, delta-coded and split into byte planes, which shuffle compression
shrinks to about six bytes), and get one answer per key back in the same order. A bucket of keys and a
block are both bounded, and their numbers grow with the input.

An id that is null counts as the greatest one.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import words as W

#: Text bytes of a block at most and at least, and for each bucket of keys.
BLOCK_BYTES, LEAST_BYTES, BUCKET_BYTES = 16 << 20, 1 << 20, 8 << 20
#: Text bytes packed at a time.
PACK_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
PACKED = "block int, ids binary, sizes binary, data binary"
REQUEST = "channel int, bucket int, block int, size long, keys binary, vals binary"
ANSWER = "channel int, bucket int, block int, answer binary, distinct long, total double"


def block_count(docs: DataFrame, text: str) -> tuple[int, int]:
    """Number of blocks, and bits of a key that choose its bucket; both follow the bytes of text.

    Small inputs get smaller blocks, for as many as two tasks per shuffle partition.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(size // BLOCK_BYTES + 1, min(tasks, size // LEAST_BYTES + 1))
    return blocks, int(size // BUCKET_BYTES).bit_length()


def block_of(doc_id: str, text: str, count: int):
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), F.lit(count)).cast("int")


def pack(docs: DataFrame, doc_id: str, text: str, block, mark=None) -> DataFrame:
    """Rows of several documents each, compressed, to be grouped by ``block``.

    With a ``mark`` (a long), every id is followed by its document's mark.
    """
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col(text).alias("text"),
        block.alias("block"),
        *([] if mark is None else [mark.alias("mark")]),
    )
    return rows.mapInArrow(_pack, PACKED)


def _pack(batches):
    for batch in (piece for whole in batches for piece in W.slices(whole, 1, PACK_BYTES)):
        block = batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, *range(3, batch.num_columns))], 1)
        block, ids = block[order], ids[order]
        data, at = W.flat(batch.column(1).take(pa.array(order)))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        out = {"block": block[edges[:-1]], "ids": [], "sizes": [], "data": []}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            out["ids"].append(ids[lo:hi].tobytes())
            out["sizes"].append(np.diff(at[lo : hi + 1]).tobytes())
            out["data"].append(pa.compress(data[at[lo] : at[hi]].tobytes(), codec="zstd", asbytes=True))
        yield pa.RecordBatch.from_pydict({**out, "block": pa.array(out["block"], pa.int32())})
    W.release()


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a block."""
    ids, sizes, data = [], [], []
    for i, s, d in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "data")), strict=True):
        ids.append(np.frombuffer(i, np.int64))
        sizes.append(np.frombuffer(s, np.int64))
        if n := int(sizes[-1].sum()):
            data.append(np.frombuffer(pa.decompress(d, n, codec="zstd"), np.uint8))
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(ids), np.concatenate(data) if data else np.zeros(0, np.uint8), at


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, the first byte of every value first, then the second ..."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the number in them of every key."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[code]


def ask(block: int, channel: int, keys: np.ndarray, vals: np.ndarray, bits: int, width: int = 64) -> pa.Table:
    """Requests about sorted distinct keys of ``width`` bits, by ranges of the keys."""
    bits = min(bits, width)
    bucket = (keys >> np.uint64(width - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table(
        {
            "channel": pa.array([channel] * len(spans), pa.int32()),
            "bucket": pa.array(bucket[edges[:-1]], pa.int32()),
            "block": pa.array([block] * len(spans), pa.int32()),
            "size": pa.array([hi - lo for lo, hi in spans], pa.int64()),
            "keys": [planes(np.diff(keys[lo:hi], prepend=np.uint64(0))) for lo, hi in spans],
            "vals": [planes(vals[lo:hi]) for lo, hi in spans],
        },
        schema=pa.schema(
            [("channel", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("size", pa.int64())]
            + [("keys", pa.binary()), ("vals", pa.binary())]
        ),
    )


def settle(requests: DataFrame, combine, dtype) -> DataFrame:
    """Answers to requests. ``combine(codes, count, values)`` gives one answer per value sent.

    ``codes`` says which of ``count`` keys each value is of. One row per bucket has block -1 and says
    how many keys have answers over 0, and those answers' sum over keys.
    """

    def work(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()])
        vals = np.concatenate([from_planes(v, dtype) for v in table["vals"].to_pylist()])
        codes, found = pd.factorize(keys)
        answer = combine(codes, len(found), vals)
        ends = np.cumsum(table["size"].to_numpy())
        each = [planes(part) for part in np.split(answer, ends[:-1])]
        of_key = np.zeros(len(found))
        of_key[codes] = answer
        return pa.table(
            {
                "channel": pa.array([table["channel"][0].as_py()] * (len(each) + 1), pa.int32()),
                "bucket": pa.array([table["bucket"][0].as_py()] * (len(each) + 1), pa.int32()),
                "block": pa.array([*table["block"].to_pylist(), -1], pa.int32()),
                "answer": pa.array([*each, None], pa.binary()),
                "distinct": pa.array([None] * len(each) + [int((of_key > 0).sum())], pa.int64()),
                "total": pa.array([None] * len(each) + [float(of_key.sum())], pa.float64()),
            }
        )

    return requests.groupBy("channel", "bucket").applyInArrow(work, ANSWER)


def answers(table: pa.Table, channel: int, dtype) -> np.ndarray:
    """All answers of a channel in the order of the keys asked about."""
    rows = [
        (b, a)
        for c, b, a in zip(*(table.column(n).to_pylist() for n in ("channel", "bucket", "answer")), strict=True)
        if c == channel
    ]
    parts = [from_planes(a, dtype) for _, a in sorted(rows, key=lambda r: r[0])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
