"""Token ids in wavelet matrices: one compressed file per shard, with access, counting and look-up.

A wavelet matrix stores a sequence of 16-bit ids as 16 bit planes. Plane by plane, from the highest
bit, the ids are split stably into those with a 0 and those with a 1; the number of zeros and ranks at
block starts lead from a place in one plane to its place in the next. Planes are kept in blocks of
``BLOCK`` bits, each compressed alone, so a look-up opens one block per plane and not the shard.

File format. A shard is a Parquet file with one row: document ids, ids per document, and ``planes``, the
binary of ``WaveletMatrix.to_bytes``. Spark writes and reads it, so any store Spark reaches will do.
Shards hold consecutive documents in ascending id order and at most ``shard_ids`` ids, unless one
document has more. The ids of a document end with ``END``.

Edge cases: null and empty texts are the end id alone; rows with one id stand in the order of their
texts' hashes; null ids come first; an empty table writes no shard; further columns are ignored.
"""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellpulse.llm import words as W
from cellpulse.llm.blocks import distinct
from cellpulse.session import scratch_dir

END = 0
BITS = 16
#: Bits of a plane that are compressed together; ranks are kept at their starts.
BLOCK = 1 << 15
#: Ids of a shard, and bytes of text tokenised at a time.
SHARD_IDS, TEXT_BYTES = 1 << 21, 4 << 20
#: Distinct pieces whose ids a Python worker remembers.
REMEMBERED = 2_000_000


class WaveletMatrix:
    """Succinct sequence of ids below 2**16."""

    def __init__(self, size: int, zeros: np.ndarray, ranks: np.ndarray, parts: list[list[bytes]]):
        self.size, self.zeros, self.ranks, self.parts = size, zeros, ranks, parts
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        ids = ids.astype(np.uint16)
        zeros, ranks, parts = np.zeros(BITS, np.int64), [], []
        for plane in range(BITS):
            bit = (ids >> np.uint16(BITS - 1 - plane)) & np.uint16(1) > 0
            packed = np.packbits(bit, bitorder="little")
            step = BLOCK // 8
            pieces = [packed[k : k + step] for k in range(0, len(packed), step)]
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            parts.append([_squeeze(p.tobytes()) for p in pieces])
            zeros[plane] = len(ids) - ranks[-1][-1]
            ids = np.concatenate([ids[~bit], ids[bit]])
        return cls(len(bit), zeros, np.array(ranks, np.int64), parts)

    def to_bytes(self) -> bytes:
        """Size, zeros per plane, ranks at block starts, sizes of the blocks, the blocks."""
        flat = [p for plane in self.parts for p in plane]
        head = np.concatenate([[self.size], self.zeros, self.ranks.ravel(), [len(p) for p in flat]])
        return head.astype("<i8").tobytes() + b"".join(flat)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        size = int(np.frombuffer(data, "<i8", 1)[0])
        blocks = -(-size // BLOCK)
        head = np.frombuffer(data, "<i8", 1 + BITS + BITS * (blocks + 1) + BITS * blocks)
        zeros, rest = head[1 : 1 + BITS], head[1 + BITS :]
        ranks = rest[: BITS * (blocks + 1)].reshape(BITS, -1)
        at = len(head) * 8 + np.concatenate([[0], np.cumsum(rest[BITS * (blocks + 1) :])])
        flat = [data[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
        return cls(size, zeros, ranks, [flat[p * blocks : (p + 1) * blocks] for p in range(BITS)])

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._open:
            packed = np.frombuffer(_open(self.parts[plane][block]), np.uint8)
            self._open[key] = np.unpackbits(packed, bitorder="little")
        return self._open[key]

    def _ones(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        block, inner = divmod(place, BLOCK)
        before = int(self.ranks[plane, block])
        return before + int(self._block(plane, block)[:inner].sum()) if inner else before

    def access(self, place: int) -> int:
        """The id at a place."""
        value = 0
        for plane in range(BITS):
            bit = int(self._block(plane, place // BLOCK)[place % BLOCK])
            ones = self._ones(plane, place)
            place = int(self.zeros[plane]) + ones if bit else place - ones
            value = 2 * value + bit
        return value

    def rank(self, token: int, place: int) -> int:
        """How often an id occurs before a place."""
        lo, hi = self._range(token, place)
        return hi - lo

    def _range(self, token: int, place: int) -> tuple[int, int]:
        lo, hi = 0, place
        for plane in range(BITS):
            ones = self._ones(plane, lo), self._ones(plane, hi)
            if token >> (BITS - 1 - plane) & 1:
                lo, hi = int(self.zeros[plane]) + ones[0], int(self.zeros[plane]) + ones[1]
            else:
                lo, hi = lo - ones[0], hi - ones[1]
        return lo, hi

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, number: int) -> int:
        """Place of an id's occurrence, from number 0 on."""
        lo, hi = self._range(token, self.size)
        if not 0 <= number < hi - lo:
            raise IndexError(number)
        place = lo + number
        for plane in reversed(range(BITS)):
            bit = token >> (BITS - 1 - plane) & 1
            wanted = place - int(self.zeros[plane]) * bit
            ranks = self.ranks[plane] if bit else np.minimum(np.arange(len(self.ranks[plane])) * BLOCK, self.size) - self.ranks[plane]
            block = int(np.searchsorted(ranks, wanted, "right")) - 1
            found = np.flatnonzero(self._block(plane, block) == bit)
            place = block * BLOCK + int(found[wanted - int(ranks[block])])
        return place

    def ids(self) -> np.ndarray:
        """The whole sequence: planes are undone from the lowest bit up, each in one pass."""
        values = np.zeros(self.size, np.uint16)
        for plane in reversed(range(BITS)):
            packed = np.frombuffer(b"".join(map(_open, self.parts[plane])), np.uint8)
            bit = np.unpackbits(packed, bitorder="little", count=self.size).view(bool)
            above = np.empty_like(values)
            zeros = int(self.zeros[plane])
            above[~bit] = values[:zeros]
            above[bit] = values[zeros:] | np.uint16(1 << (BITS - 1 - plane))
            values = above
        return values


def _squeeze(data: bytes) -> bytes:
    """Compressed if that is shorter; the first byte says which, the next four the full size."""
    short = pa.compress(data, codec="zstd", asbytes=True)
    kind, body = (b"z", short) if len(short) < len(data) else (b"r", data)
    return kind + len(data).to_bytes(4, "little") + body


def _open(data: bytes) -> bytes:
    if data[:1] == b"r":
        return data[5:]
    return pa.decompress(data[5:], int.from_bytes(data[1:5], "little"), codec="zstd", asbytes=True)


class TextEncoder:
    """Ids of whole texts by the tokenizer, which sees each distinct piece of text once.

    The tokenizer never joins a character with white space after it, so a text may be cut before every
    ASCII white space that follows another character, and pieces are encoded apart. Texts with other
    white space (or bytes that could begin it) go to the tokenizer whole. Distinct pieces that begin
    with white space are laid end to end and encoded in one call; the byte lengths of the tokens tell
    which ids are whose.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << BITS:
            raise ValueError("ids above 16 bits")
        special = {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [s.encode() for s in special.values()]
        # A byte-level token has one character per byte.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i)) for i in range(size)])
        self.table = W.hash_table(seed=5)
        self.space = W.separators(W.SPACES)
        self.odd = W.separators(b"\xc2\xe1\xe2\xe3")
        self._forget()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint16) for e in found]

    def pieces(self, data, at, plain):
        """Start, end and text number of the pieces of the plain texts."""
        if not len(data):
            return np.zeros((3, 0), np.int64)
        space = self.space[data]
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][at[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        text = np.searchsorted(at, start, "right") - 1
        end = np.append(start[1:], len(data))
        mine = plain[text]
        return start[mine], end[mine], text[mine]

    def _learn(self, data, start, end, hashes):
        """Encodes pieces and keeps their ids."""
        raw = data.tobytes()
        glued = self.space[data[start]] & ~self.space[data[end - 1]]
        parts = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        together = [p for p, g in zip(parts, glued.tolist(), strict=True) if g]
        ids = self.whole([b"".join(together).decode()])[0] if together else np.zeros(0, np.uint16)
        reach = np.cumsum(self.bytes[ids])
        cut = np.searchsorted(reach, np.cumsum([len(p) for p in together])) + 1 if together else np.zeros(0, np.int64)
        alone = self.whole([p.decode() for p, g in zip(parts, glued.tolist(), strict=True) if not g])
        size = np.empty(len(parts), np.int64)
        size[glued] = np.diff(cut, prepend=0)
        size[~glued] = [len(a) for a in alone]
        order = np.concatenate([np.flatnonzero(glued), np.flatnonzero(~glued)])
        size = size[order]
        begin = len(self.values) + np.cumsum(size) - size
        self.values = np.concatenate([self.values, ids, *alone])
        joined = [np.concatenate(p) for p in zip(self.known, (hashes[order], begin, size), strict=True)]
        by_hash = np.argsort(joined[0], kind="stable")
        self.known = tuple(p[by_hash] for p in joined)

    def _forget(self):
        """Starts over with nothing remembered: hash, first id and number of ids of each piece; all ids."""
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values = np.zeros(0, np.uint16)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text followed by END, and the number per text."""
        data, at = W.flat(texts)
        docs = len(at) - 1
        odd = np.flatnonzero(self.odd[data])
        plain = np.bincount(np.searchsorted(at, odd, "right") - 1, minlength=docs) == 0
        raw = data.tobytes()
        for special in self.special:
            place = raw.find(special)
            while place >= 0:
                plain[np.searchsorted(at, place, "right") - 1] = False
                place = raw.find(special, place + 1)
        start, end, text = self.pieces(data, at, plain)
        hashes = W.hash_pieces(data, start, end, self.table)
        found, code = distinct(hashes)
        first = np.empty(len(found), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        if len(self.known[0]) > REMEMBERED:
            self._forget()
        new = ~np.isin(found, self.known[0], assume_unique=True)
        if new.any():
            self._learn(data, start[first[new]], end[first[new]], found[new])
        place = np.searchsorted(self.known[0], found)
        size = self.known[2][place][code]
        values = self.values[_ragged(self.known[1][place][code], size)]
        count = np.bincount(text, weights=size, minlength=docs).astype(np.int64) + 1
        others = np.flatnonzero(~plain)
        apart = self.whole([raw[at[d] : at[d + 1]].decode() for d in others])
        count[others] = [len(a) + 1 for a in apart]
        ends = np.cumsum(count)
        out = np.full(int(ends[-1]) if docs else 0, END, np.uint16)
        room = np.repeat(plain, count)
        room[ends - 1] = False
        out[room] = values
        for d, ids in zip(others, apart, strict=True):
            out[ends[d] - count[d] : ends[d] - 1] = ids
        return out, count


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin..begin+size of every pair, end to end."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


SHARDS = "part int, number int, doc_ids binary, missing binary, counts binary, n_ids long, planes binary"


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS
) -> None:
    """Tokenises all texts and writes the shards below ``path``."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (32 << 20) + 1)
    # The salt lets rows with one id spread over several parts.
    keys = [F.col("doc_id").asc_nulls_first(), "hash", "salt"]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("salt"),
    )

    def encode(batches):
        coder, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, doc_ids, missing = [], [], [], []

        def shard():
            nonlocal number
            whole = np.concatenate(ids)
            row = {
                "part": pa.array([part], pa.int32()),
                "number": pa.array([number], pa.int32()),
                "doc_ids": [np.concatenate(doc_ids).astype("<i8").tobytes()],
                "missing": [np.concatenate(missing).tobytes()],
                "counts": [np.concatenate(counts).astype("<i8").tobytes()],
                "n_ids": pa.array([len(whole)], pa.int64()),
                "planes": [WaveletMatrix.build(whole).to_bytes()],
            }
            number += 1
            for held in (ids, counts, doc_ids, missing):
                held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for piece in W.slices(batch, 1, TEXT_BYTES):
                found, count = coder.encode(piece.column(1))
                known = piece.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                null = piece.column(0).is_null().to_numpy(zero_copy_only=False)
                # A shard takes documents as long as they fit; a longer document is a shard of its own.
                lo, ends = 0, np.cumsum(count)
                while lo < len(count):
                    room = shard_ids - sum(map(len, ids))
                    base = ends[lo - 1] if lo else 0
                    hi = int(np.searchsorted(ends, base + room, "right"))
                    if hi == lo and ids:
                        yield shard()
                        continue
                    hi = max(hi, lo + 1)
                    ids.append(found[base : ends[hi - 1]])
                    counts.append(count[lo:hi])
                    doc_ids.append(known[lo:hi])
                    missing.append(null[lo:hi])
                    lo = hi
        if ids:
            yield shard()
        W.release()

    rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(
        encode, SHARDS
    ).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # Ids before each part: as many rows as parts. Inside a part, shards are counted by a window.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, total = [], 0
    for row in sorted(parts, key=lambda r: r["part"]):
        before.append((row["part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(before, "part int, part_start long")
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start"))
    starts = starts.join(F.broadcast(offsets), "part").select(
        "part", "number", (F.col("part_start") + F.col("shard_start")).alias("start")
    )

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["planes"]).ids().astype("<u4")
                counts = np.frombuffer(row["counts"], "<i8")
                ends = np.cumsum(counts)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                missing = np.frombuffer(row["missing"], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=missing),
                        pa.array(row["start"] + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.join(starts, ["part", "number"]).select("planes", "counts", "doc_ids", "missing", "start").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_index(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files of all documents to a fresh shared folder and reads them back."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_shards(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), doc_id, text)
    return read_documents(spark, path)
