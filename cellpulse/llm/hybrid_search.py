"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

Two passes over Spark partitions. The first writes an index: a row per block of some MB of documents, with
the posting lists of all terms that any item asks for, compressed, and the block's counts. Sums of the counts
give the corpus statistics. The second takes each block for itself. For an item, the short lists of the block
are added up into one table of partial scores, which from then on is a list like any other: sorted by
document, with a bound for every stride of documents. The long lists and that table are then merged document
at a time, stride by stride; a stride whose bounds add up to less than the score to beat is skipped in all
lists, and inside a stride documents that can no longer reach that score are dropped before the next list is
read. Each task keeps its best k documents per item, and the best of those are the result, exactly.

Items travel to the executors in groups of at most ``group_bytes`` of text. Items of more are searched in
several passes, one group after the other.

Edge cases: null and wordless texts are not counted as documents and never found; items without terms find
nothing; rows with one item id are one item; equal scores are ranked by id, a null id last; repeated rows are
ranked each; an empty table on either side gives no rows; texts of any length are taken whole; further columns
are ignored. 64-bit numbers that would not fit raise.
"""

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.llm import words as W
from cellpulse.llm.decontaminate import ENDS
from cellpulse.session import materialise

TERM = re.compile(b"[^%s]+" % re.escape(ENDS))
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Text bytes of a block, documents of a stride, and documents in a list of the block that still count as short.
BLOCK_BYTES, STRIDE, SHORT = 8 << 20, 256, 64
#: Blocks that a task of the second pass takes, about.
BLOCKS = 8
INDEX = "docs long, terms long, codes array<int>, sizes array<int>, ids binary, lengths binary, places binary, counts binary"


def terms_of(text: str | None) -> set[bytes]:
    return set(TERM.findall((text or "").encode().translate(UPPER_TO_LOWER)))


class Vocabulary:
    """Terms that items ask for, with the numbers of those found in a block of text."""

    def __init__(self, terms: list[bytes]):
        self.terms, self.table, self.ends = terms, W.hash_table(lower=True), W.separators(ENDS)
        data = np.frombuffer(b"".join(terms), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        self.code = pd.Index(W.hash_pieces(data, at[:-1], at[1:], self.table) if terms else np.zeros(0, np.uint64))
        if not self.code.is_unique:
            raise ValueError("two terms share a hash")

    def postings(self, data: np.ndarray, at: np.ndarray):
        """Terms per text; and text, term and number of occurrences of every posting, by term, then text."""
        start, end, text = W.find_words(data, at, self.ends)
        lengths = np.bincount(text, minlength=len(at) - 1)
        code = self.code.get_indexer(W.hash_pieces(data, start, end, self.table)) if len(start) else np.zeros(0, int)
        hit = code >= 0
        key = code[hit].astype(np.int64) * (len(at) - 1) + text[hit]
        key, count = np.unique(key, return_counts=True)
        code, text = np.divmod(key, max(1, len(at) - 1))
        return lengths, text, code, count


def index(
    docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Blocks of documents with the posting lists of ``terms``: a frame that is worked out when it is written."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches):
        vocabulary = Vocabulary(sent.value)
        for batch in (piece for whole in batches for piece in W.slices(whole, 1, block_bytes)):
            data, at = W.flat(batch.column(1))
            lengths, place, code, count = vocabulary.postings(data, at)
            codes, sizes = np.unique(code, return_counts=True)
            held = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int((lengths > 0).sum())], pa.int64()),
                    pa.array([int(lengths.sum())], pa.int64()),
                    pa.array([codes], pa.list_(pa.int32())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    *(pa.array([_shrunk(x)], pa.binary()) for x in (np.stack([ids, held]), lengths, place, count)),
                ],
                names=["docs", "terms", "codes", "sizes", "ids", "lengths", "places", "counts"],
            )
        W.release()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(work, INDEX)


def _shrunk(values: np.ndarray) -> bytes:
    """64-bit integers, compressed, with their number in front."""
    raw = np.ascontiguousarray(values, np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _grown(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.int64) if size else np.zeros(0, np.int64)


class Block:
    """Posting lists of one block with their gains: what a posting adds to a score, without the weight."""

    def __init__(self, row: dict, total_docs: int, total_terms: int, stride: int = STRIDE):
        self.stride = stride
        self.ids, self.held = _grown(row["ids"]).reshape(2, -1)
        lengths = _grown(row["lengths"])
        if int(lengths.max(initial=0)) * 90 * total_docs >= 1 << 63:
            raise OverflowError("the length term does not fit in 64 bits")
        pad = 8 * (100 - 90 + (90 * lengths * total_docs) // max(1, total_terms))
        self.places, count = _grown(row["places"]), _grown(row["counts"])
        self.gains = (1_000_000_000 * count) // (1000 * count + pad[self.places])
        ends = np.cumsum(row["sizes"])
        self.lists = {c: (e - s, e) for c, s, e in zip(row["codes"], row["sizes"], ends, strict=True)}
        self.edges = np.arange(0, len(self.ids) + stride, stride)
        self._skips: dict = {}

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.lists[term]
        return self.places[lo:hi], self.gains[lo:hi]

    def skips(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each stride starts in a list, and the greatest gain in each stride; worked out once a block."""
        if term not in self._skips:
            self._skips[term] = skips(*self.whole(term), self.edges)
        return self._skips[term]


def skips(places: np.ndarray, values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(places, edges)
    most = np.zeros(len(edges) - 1, np.int64)
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        most[filled] = np.maximum.reduceat(values, at[filled])
    return at, most


def best(
    block: Block, query: list[tuple[int, int]], k: int, beat: int, short_list: int = SHORT
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's documents that may be among the best ``k``; ``beat``: least score of use.

    ``query``: (term, weight). A document left out has a score below ``beat`` or below k others here.
    """
    found = sorted((hi - lo, term, weight) for term, weight in query if (span := block.lists.get(term)) for lo, hi in [span])
    short = [(t, w) for size, t, w in found if size <= short_list]
    # Term at a time: short lists become one table of partial scores, sorted by document.
    lists = []
    if short:
        place = np.concatenate([block.whole(t)[0] for t, _ in short])
        value = np.concatenate([block.whole(t)[1] * w for t, w in short])
        summed, code = np.unique(place, return_inverse=True)
        score = np.zeros(len(summed), np.int64)
        np.add.at(score, code, value)
        at, most = skips(summed, score, block.edges)
        lists.append((summed, score, 1, at, most))
    for size, term, weight in found:
        if size > short_list and weight:
            at, most = block.skips(term)
            lists.append((*block.whole(term), weight, at, most * weight))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists.sort(key=lambda one: -int(one[4].max()))
    bounds = np.stack([one[4] for one in lists])
    # What the lists after this one can still add, by list and stride.
    later = np.concatenate([np.cumsum(bounds[::-1], 0)[::-1][1:], np.zeros((1, bounds.shape[1]), np.int64)])
    reach = bounds.sum(0)
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Document at a time, a stride of documents in a step.
    for s in np.flatnonzero(reach >= max(1, beat)):
        if reach[s] < beat:
            continue
        score = np.zeros(block.stride, np.int64)
        alive = None
        for k_list, (place, value, weight, at, _) in enumerate(lists):
            lo, hi = at[s], at[s + 1]
            if lo < hi:
                inside, gain = place[lo:hi] - block.edges[s], value[lo:hi]
                if alive is not None:
                    kept = alive[inside]
                    inside, gain = inside[kept], gain[kept]
                score[inside] += gain * weight
            if later[k_list][s] < beat or alive is not None:
                alive = score + later[k_list][s] >= beat
                if not alive.any():
                    break
        else:
            new = np.flatnonzero(score >= max(1, beat))
            places, scores = np.concatenate([places, new + block.edges[s]]), np.concatenate([scores, score[new]])
            if len(scores) >= k:
                beat = max(beat, int(np.partition(scores, -k)[-k]))
                if len(scores) > 4 * k:
                    kept = scores >= beat
                    places, scores = places[kept], scores[kept]
    kept = scores >= beat
    return places[kept], scores[kept]


class Top:
    """The best k (score, id) seen of one item."""

    def __init__(self, k: int):
        self.k, self.rows, self.beat = k, [], 0

    def add(self, block: Block, places: np.ndarray, scores: np.ndarray) -> None:
        new = [(-int(s), not block.held[p], int(block.ids[p])) for p, s in zip(places, scores, strict=True)]
        self.rows = sorted(self.rows + new)[: self.k]
        if len(self.rows) == self.k:
            self.beat = -self.rows[-1][0]


def groups_of(items: DataFrame, item_id: str, item_text: str, group_bytes: int):
    """Dictionaries of item to terms, one after the other, each of at most ``group_bytes`` of text or one item."""
    slim = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    found, room = defaultdict(set), group_bytes
    for row in slim.orderBy("item").toLocalIterator():
        if room <= 0 and row["item"] not in found:
            yield dict(found)
            found, room = defaultdict(set), group_bytes
        found[row["item"]] |= terms_of(row["text"])
        room -= len((row["text"] or "").encode())
    yield dict(found)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    group_bytes: int = 4 << 20,
    block_bytes: int = BLOCK_BYTES,
    stride: int = STRIDE,
    short_list: int = SHORT,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    found = None
    for group in groups_of(items, item_id, item_text, group_bytes):
        terms = sorted(set().union(*group.values()))
        blocks = materialise(index(docs, terms, doc_id, text, block_bytes), "index")
        # The index is a small part of the text, so it is dealt anew, some 64 MB of text to a task at most.
        docs_held, terms_held, count = blocks.agg(F.sum("docs"), F.sum("terms"), F.count("*")).first()
        held = (
            blocks.select(F.explode(F.arrays_zip("codes", "sizes")).alias("one"))
            .groupBy(F.col("one.codes").alias("code"))
            .agg(F.sum("one.sizes").alias("df"))
        )
        # As many rows at most as the group has terms.
        weight = {r["code"]: int(1000 * math.log((2 * docs_held + 2) / (2 * r["df"] + 1))) for r in held.collect()}
        code = {term: n for n, term in enumerate(terms)}
        queries = [(item, [(code[t], weight[code[t]]) for t in sorted(ts) if code[t] in weight]) for item, ts in group.items()]
        dealt = blocks.repartition(count // BLOCKS + spark.sparkContext.defaultParallelism, F.xxhash64("ids"))
        part = _scan(dealt, spark.sparkContext.broadcast(queries), docs_held, terms_held, k, stride, short_list)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks' rows meet in groups first, so that no item's rows all meet in one task.
    near = Window.partitionBy("item_id", "near").orderBy(*order)
    near_best = found.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k)
    last = Window.partitionBy("item_id").orderBy(*order)
    return (
        near_best.withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= k)
        .select(F.col("item_id").cast(items.schema[item_id].dataType), F.col("rank").cast("int"), "doc_id", "score")
    )


def _scan(blocks: DataFrame, sent, total_docs: int, total_terms: int, k: int, stride: int, short_list: int) -> DataFrame:
    def work(batches):
        tops = None
        for batch in batches:
            tops = tops or [Top(k) for _ in sent.value]
            for number in range(batch.num_rows):
                block = Block(batch.slice(number, 1).to_pylist()[0], total_docs, total_terms, stride)
                for top, (_, query) in zip(tops, sent.value, strict=True):
                    top.add(block, *best(block, query, k, top.beat, short_list))
        rows = [
            (None if item is None else str(item), None if no_id else doc, -score)
            for (item, _), top in zip(sent.value, tops or [], strict=False)
            for score, no_id, doc in top.rows
        ]
        if rows:
            types = (pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "doc_id", "score"])

    best_of_tasks = blocks.mapInArrow(work, "item_id string, doc_id long, score long")
    return best_of_tasks.withColumn("near", F.spark_partition_id() % 64)
