"""Similarity join on word shingles with prefix filters under several global token orders.

Two shingle sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens
of each, whatever order all sets are sorted in. Three orders are used: rare tokens first with ties by
one hash, rare first with ties by another, and a plain hash. Tokens that one document alone has can
link nothing and leave the prefixes. Candidates meet in the prefixes of the first order; a pair is
verified on whole sets only if its other prefixes meet as well.

Rarity comes from all documents: distinct tokens are counted by ``blocks``, under shortened hashes. Any
function of a token is a valid order, so shortening costs speed at worst, never a link.

Components need no list of all pairs. Documents with equal sets are one node. Within the bucket of a
prefix token, a few members are compared with all others, then more in the next round, but only while
the bucket still holds more than one component. Members with the smallest share of tokens of their own
come first: the text from which the others were copied is among them and links most at once. A pair is
not even formed if the sets' sizes, the tokens that each has for itself alone, or the tokens counted by
hash in ``CELLS`` cells rule the similarity out: two sets share no more than the smaller count of each
cell. So a group of thousands of near copies costs about a comparison per member and bucket, and every link between nodes
not yet connected is still found.

Nodes are sets, not ids, so rows that share an id or have none are linked only by their texts.

Edge cases: without words or text a document has no shingles and is linked with nothing; one with
fewer words than a shingle has its whole sequence as its one shingle; equal documents are linked; rows
with one id and different texts are different documents; a row without an id links like any other, counts
as the greatest id and stays null in the result; an empty table gives no rows; further columns are ignored.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import blocks as B
from cellpulse.llm import words as W
from cellpulse.llm.components import components
from cellpulse.session import materialise

SETS = "doc_id long, mark long, n_shingles long, n_unique long, node binary, first array<long>, second array<smallint>, third array<smallint>, scale int, cells array<tinyint>, stairs array<long>, over long, tokens array<long>"
#: How many times more members are compared with the rest of their bucket in each further round.
GROWTH = 16
#: Cells in which a node's tokens are counted, for a bound on how many two nodes can share.
CELLS = 128
#: Bytes of text, and shingles, that a block is worked on at a time.
PIECE_BYTES, PIECE_TOKENS = 4 << 20, 1 << 19
#: Members of one token that are dealt to one task together, about.
SLICE = 500
#: Columns that a member carries for the bounds.
BOUNDS = ("n_shingles", "n_unique", "scale", "cells", "stairs", "over")


def stretches(edge: np.ndarray, most: int):
    """(lo, hi) of texts that lie one behind the other and together have at most ``most`` places, or one longer text."""
    lo = 0
    while lo < len(edge) - 1:
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def shingles(table: pa.Table, length: int):
    """Ids with marks, and per document the distinct shingle hashes: (ids, text number, hash), by text then hash.

    A block is taken some MB at a time, which bounds the memory beside its hashes.
    """
    ids, data, at = B.unpack(table)
    of_text, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in stretches(at, PIECE_BYTES):
        found = _shingles(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], length)
        of_text.append(found[0] + lo)
        key.append(found[1])
    return ids.reshape(-1, 2), np.concatenate(of_text), np.concatenate(key)


def _shingles(data: np.ndarray, at: np.ndarray, length: int):
    start, end, text = W.find_words(data, at, W.separators(W.SPACES))
    hashes = W.hash_pieces(data, start, end, W.hash_table(lower=True))
    of_text, key = [], []
    size = np.bincount(text, minlength=len(at) - 1)
    for n in range(1, length + 1):  # shorter ones for texts that are one short shingle
        window, inside = W.windows(hashes, text, n, seed=100 + n)
        inside &= (size[text[: len(window)]] == n) | (n == length)
        of_text.append(text[: len(window)][inside])
        key.append(W.mixed(window[inside]))
    of_text, key = np.concatenate(of_text), np.concatenate(key)
    order = in_order(of_text, len(at) - 1, key)
    of_text, key = of_text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(of_text) != 0) | (np.diff(key) != 0)
    return of_text[new], key[new]


def in_order(text: np.ndarray, texts: int, key: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
    """The order by text, then rarity where given, then hash: one sort of one number per token.

    The number holds the text, the rarity and what there is room for of the hash. Should two of them be
    equal with different hashes, all is sorted by the three keys instead.
    """
    bits = max(1, int(texts - 1).bit_length()) + (0 if rare is None else 8)
    packed = text.astype(np.uint64)
    if rare is not None:
        packed <<= np.uint64(8)
        packed |= rare
    packed <<= np.uint64(64 - bits)
    packed |= key >> np.uint64(bits)
    order = np.argsort(packed)
    packed = packed[order]
    same = np.flatnonzero(packed[1:] == packed[:-1])
    del packed
    if (key[order[same]] != key[order[same + 1]]).any():
        return np.lexsort((key, text) if rare is None else (key, rare, text))
    return order


def _count(codes, count, vals):
    """Number of documents with the token, coarser from 16 on, in one byte."""
    total = np.bincount(codes, weights=vals, minlength=count)
    coarse = np.where(total < 16, total, np.minimum(255, 16 + 8 * np.log2(np.maximum(total, 1) / 16)))
    return coarse.astype(np.uint8)[codes]


def _documents(table, right, length, percent, width):
    """Rows of ``SETS`` for one block."""
    ids, text, key = shingles(table, length)
    # Answers come in the order of the distinct shortened hashes; sorting needs less room than a hash table.
    order = np.argsort(key >> np.uint64(64 - width))
    short = key[order] >> np.uint64(64 - width)
    rare = np.zeros(len(key), np.uint8)
    if len(key):
        rare[order] = B.answers(right, 1, np.uint8)[np.cumsum(np.append(0, short[1:] != short[:-1]))]
    del order, short
    edge = np.searchsorted(text, np.arange(len(ids) + 1))
    size = np.diff(edge)
    prefix = size - -(-percent * size // 100) + 1
    kept: list[list] = [[], [], []]
    for lo, hi in stretches(edge, PIECE_TOKENS):
        here = slice(edge[lo], edge[hi])
        hashes, seldom, mine = key[here], rare[here], text[here] - lo
        rank = np.arange(len(mine)) - (edge[lo:hi] - edge[lo])[mine]
        other = W.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        orders = ((hashes, seldom), (other, seldom), (W.mixed(other), None))
        for found, (by, rarity) in zip(kept, orders, strict=True):
            first = in_order(mine, hi - lo, by, rarity)[rank < prefix[lo:hi][mine]]
            found.append(first[seldom[first] > 1] + edge[lo])
    kept = [np.concatenate([np.zeros(0, np.int64), *found]) for found in kept]
    met = np.ones(len(ids), bool)
    for mine in kept:
        met &= np.bincount(text[mine], minlength=len(ids)) > 0
    sums = np.zeros((len(ids), 2), np.uint64)
    np.add.at(sums[:, 0], text, W.mixed(key ^ np.uint64(0xD1342543DE82EF95)))
    np.add.at(sums[:, 1], text, W.mixed(key + np.uint64(0x2545F4914F6CDD1D)))

    def lists(mine, values, kind):
        mine = mine[met[text[mine]]]
        n = np.bincount(text[mine], minlength=len(ids))
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values[mine], kind), mask=pa.array(~met)
        )

    # Two bytes of a token are enough for a filter: tokens that are equal stay equal.
    small = (key >> np.uint64(48)).astype(np.uint16).view(np.int16)
    count = np.bincount(text * CELLS + (key >> np.uint64(57)).astype(np.int64), minlength=len(ids) * CELLS)
    count = count.reshape(-1, CELLS)
    # Counts up to 8 as stairs, one bit a step: two stairs have in common what the lower one has.
    stairs = np.packbits(np.arange(8) < count[met][:, :, None], axis=2).reshape(-1, CELLS).view(np.int64)
    stair_edge = np.concatenate([[0], np.cumsum(met * (CELLS // 8))])
    over = np.maximum(count - 8, 0).sum(1)
    # One byte a cell: counts are divided by the text's own scale and rounded up, so the bound still holds.
    scale = np.maximum(1, -(-count.max(1, initial=0) // 127))
    count = (-(-count // scale[:, None]))[met].ravel().astype(np.int8)
    cell_edge = np.concatenate([[0], np.cumsum(met * CELLS)])
    return pa.table(
        {
            "doc_id": pa.array(ids[:, 0], pa.int64()),
            "mark": pa.array(ids[:, 1], pa.int64()),
            "n_shingles": pa.array(size, pa.int64()),
            "n_unique": pa.array(np.bincount(text, weights=rare == 1, minlength=len(ids)).astype(np.int64)),
            "node": pa.array([s.tobytes() if n else None for s, n in zip(sums, size, strict=True)], pa.binary()),
            "first": lists(kept[0], key.view(np.int64), pa.int64()),
            "second": lists(kept[1], small, pa.int16()),
            "third": lists(kept[2], small, pa.int16()),
            "scale": pa.array(scale, pa.int32()),
            "cells": pa.ListArray.from_arrays(pa.array(cell_edge, pa.int32()), pa.array(count), mask=pa.array(~met)),
            "stairs": pa.ListArray.from_arrays(pa.array(stair_edge, pa.int32()), pa.array(stairs.ravel()), mask=pa.array(~met)),
            "over": pa.array(over, pa.int64()),
            "tokens": lists(np.flatnonzero(rare > 1), key.view(np.int64), pa.int64()),
        }
    )


def document_sets(docs: DataFrame, length: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: mark (hash of the text), set size, node (128-bit hash of the set), prefixes and those tokens of the
    set that some other document has: no others can be in an intersection.

    The lists are null where some prefix holds no token that another document has.
    """
    count, bits = B.block_count(docs, text)
    # Some 8 bits more than there are bytes of text keep accidental sharing of shortened hashes rare.
    width = min(64, 32 + bits)
    packed = B.pack(docs, doc_id, text, B.block_of(doc_id, text, count), F.xxhash64(text))

    def ask(key, table):
        _, _, hashes = shingles(table, length)
        found, count = np.unique(hashes >> np.uint64(64 - width), return_counts=True)
        asked = B.ask(key[0].as_py(), 1, found, count.astype(np.uint32), bits, width)
        del hashes, found, count
        W.release()
        return asked

    def build(key, table, right):
        rows = _documents(table, right, length, percent, width)
        W.release()
        return rows

    counted = B.settle(packed.groupBy("block").applyInArrow(ask, B.REQUEST), _count, np.uint32).filter("block >= 0")
    return packed.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(build, SETS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) that pass the further prefix filters and then the comparison of whole sets."""

    def beside(df, *columns):
        for s in ("a", "b"):
            df = df.join(sets.select(F.col("rep").alias(s), F.struct(*columns).alias(f"{s}_set")), s)
        return df

    # The short lists decide on most pairs, so whole sets travel for the rest only.
    both = beside(pairs, "second", "third")
    both = both.filter(F.arrays_overlap("a_set.second", "b_set.second") & F.arrays_overlap("a_set.third", "b_set.third"))
    both = beside(both.select("a", "b"), "n_shingles", "tokens")
    same = F.size(F.array_intersect("a_set.tokens", "b_set.tokens"))
    either = F.col("a_set.n_shingles") + F.col("b_set.n_shingles") - same
    return both.filter(100 * same >= percent * either).select("a", "b")


def _possible(percent: int):
    """Whether a member and a hub (h_...) can be similar enough, by the counts that they carry."""
    sizes = F.col("n_shingles") + F.col("h_n_shingles")
    enough = lambda most: 100 * most >= percent * (sizes - most)
    of_all = F.least(F.col("n_shingles") - F.col("n_unique"), F.col("h_n_shingles") - F.col("h_n_unique"))
    least = F.zip_with(
        "cells", "h_cells", lambda a, b: F.least(a.cast("int") * F.col("scale"), b.cast("int") * F.col("h_scale"))
    )
    by_cell = F.aggregate(least, F.lit(0), lambda t, c: t + c)
    # Two cells have in common at most what their stairs have, and of what is above these no more than either has.
    steps = [F.bit_count(F.get("stairs", F.lit(k)).bitwiseAND(F.get("h_stairs", F.lit(k)))) for k in range(CELLS // 8)]
    by_stairs = sum(steps[1:], steps[0]) + F.least("over", "h_over")
    # The cheap ones first.
    return enough(of_all) & enough(by_stairs) & enough(by_cell)


def link_components(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, label) for every node with a link; ``sets``: rep and the columns of ``SETS``, one row a node."""
    members = sets.select("rep", *BOUNDS, F.explode("first").alias("token"))
    shared = members.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    # A token of very many members is dealt to several tasks, and its hubs to all of these.
    slices = F.ceil(F.col("n") / SLICE).cast("int").alias("slices")
    shared = shared.filter("lo < hi").select("token", slices)
    left = members.join(shared, "token").withColumn("label", F.col("rep"))
    left = materialise(left.withColumn("slice", F.pmod(F.xxhash64("rep"), "slices")), "members")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links, labels = None, None
    hubs = 1
    while not left.isEmpty():
        part = F.pmod(F.xxhash64("rep", "token"), F.lit(hubs))
        own = F.col("n_unique") / F.col("n_shingles")
        least = F.min(F.struct(own.alias("own"), "rep", "slices", "label", *BOUNDS)).alias("hub")
        hub = materialise(left.groupBy("token", part.alias("part")).agg(least).select("token", "hub.*"), "hubs")
        h = hub.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        h = h.select("token", "slice", *(F.col(c).alias(f"h_{c}") for c in ("rep", "label", *BOUNDS)))
        # By number of rows, not of bytes: the work is in the pairs.
        met = left.repartition(tasks, "token", "slice").join(
            h,
            (left["token"] == h["token"])
            & (left["slice"] == h["slice"])
            & (F.col("rep") != F.col("h_rep"))
            & (F.col("label") != F.col("h_label"))
            & _possible(percent),
        )
        pairs = met.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b")).distinct()
        found = materialise(_verified(pairs, sets, percent), "links")
        left = left.join(hub.select("token", "rep"), ["token", "rep"], "left_anti")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
            new = labels.select(F.col("node").alias("rep"), F.col("label").alias("_label"))
            left = left.join(new, "rep", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")
        mixed = left.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        left = materialise(left.join(mixed.select("token"), "token"), "members")
        hubs *= GROWTH
    return labels.withColumnRenamed("node", "rep") if labels is not None else None


def _numbered(nodes: DataFrame) -> DataFrame:
    """Adds ``rep``, a number for every node: a hash under the first seed that gives no two nodes the same."""
    for seed in itertools.count():
        numbered = materialise(nodes.withColumn("rep", F.xxhash64("node", F.lit(seed))), "nodes")
        if numbered.groupBy("rep").count().filter("count > 1").isEmpty():
            return numbered


def near_groups(docs: DataFrame, length: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id (``NO_ID`` for null), mark, n_shingles and first, the least (doc_id, mark) reachable by links."""
    whole = materialise(document_sets(docs, length, percent, doc_id, text), "sets")
    able = whole.filter("tokens is not null")
    nodes = _numbered(able.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("first")))
    sets = able.drop("doc_id", "mark").dropDuplicates(["node"]).join(nodes.select("node", "rep"), "node")
    labels = link_components(materialise(sets.drop("node"), "node-sets"), percent)
    if labels is not None:
        linked = materialise(nodes.join(labels, "rep").select("rep", "label", "first"), "linked")
        least = linked.groupBy("label").agg(F.min("first").alias("_least"))
        nodes = nodes.join(linked.join(least, "label").select("rep", "_least"), "rep", "left")
        nodes = nodes.withColumn("first", F.coalesce("_least", "first"))
    rows = whole.select("doc_id", "mark", "n_shingles", "node").join(nodes.select("node", "first"), "node", "left")
    return rows.select("doc_id", "mark", "n_shingles", F.coalesce("first", F.struct("doc_id", "mark")).alias("first"))


def near_components(
    docs: DataFrame, length: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id reachable by links."""
    real = lambda c: F.when(F.col(c) != B.NO_ID, F.col(c))
    return near_groups(docs, length, percent, doc_id, text).select(
        real("doc_id").alias("doc_id"), "n_shingles", real("first.doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, length: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest id of each group of near duplicates, with all their columns.

    No id comes last; among different texts of one id the hash of the text decides. Of rows with the same
    id and text one stays, by the hash of all columns that are no maps; rows that have neither id nor words
    are linked with nothing and all stay.
    """
    found = near_groups(docs, length, percent, doc_id, text)
    mine = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    kept = found.filter(mine).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    bare = F.col(doc_id).cast("long").isNull() & (F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(W.SPACES.decode())) == "")
    # Equal rows meet before the shuffle, so a text that many rows without an id share is no hot key.
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(B.NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark")
    order = F.xxhash64(*(name for name, kind in docs.dtypes if "map<" not in kind))
    rows = docs.filter(~bare).groupBy(*key).agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return rows.join(kept, ["_id", "_mark"], "left_semi").select("_row.*").unionByName(docs.filter(bare))
