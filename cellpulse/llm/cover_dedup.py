"""Removal of repeated passages, found with difference-cover anchors.

A passage of ``length`` words that starts in two documents is found without hashing every position in
a common table: short windows (anchors) are hashed only where the word's place in its document, modulo
a period, lies in a difference cover. Any two places are at the same distance before two cover places,
so any two equal passages hold an equal anchor at the same offset. Anchors that only one document has
end there; windows around the others are compared whole, by two 64-bit hashes.

A word goes if a window over it also starts in a document with a smaller id; the input decides, not
what is left. Cost is linear: groups of copies are never paired.

Edge cases: null and empty texts have no words (the hash of nothing); a text shorter than a window
keeps everything; rows with one id never take words from each other; null ids come last; an empty
table gives no rows; further columns are ignored.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import blocks as B
from cellpulse.llm import words as W

#: A perfect difference cover: every distance modulo the period is one of two of its places.
PERIOD, COVER = 7, (0, 1, 3)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string{}"
#: What travels for a passage: its second hash and the smallest id that has it.
PASSAGE = np.dtype([("check", "<u8"), ("id", "<i8")])


class _Words:
    """A block's words with their hashes and places in their documents."""

    def __init__(self, table: pa.Table, length: int):
        self.ids, self.data, self.at = B.unpack(table)
        self.start, self.end, self.text = W.find_words(self.data, self.at, W.separators(W.SPACES))
        self.hash = W.hash_pieces(self.data, self.start, self.end, W.hash_table())
        self.place = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)
        self.length, self.short = length, length - PERIOD + 1

    def anchors(self):
        """Numbers of the anchored words and their keys."""
        key, inside = W.windows(self.hash, self.text, self.short)
        at = np.flatnonzero(inside & np.isin(self.place[: len(key)] % PERIOD, COVER))
        return at, W.mixed(key[at])

    def passages(self, shared: np.ndarray):
        """Numbers of the words where a passage with a shared anchor starts, with two hashes of it."""
        first, inside = W.windows(self.hash, self.text, self.length)
        near = np.concatenate([[0], np.cumsum(shared)])
        n = len(first)
        at = np.flatnonzero(inside & (near[PERIOD : PERIOD + n] > near[:n])) if n else np.zeros(0, np.int64)
        second, _ = W.windows(W.mixed(self.hash), self.text, self.length, seed=11)
        return at, W.mixed(first[at]), second[at]


def _several(codes, count, vals):
    """Whether a key is of several documents: some block says so, or several blocks have it."""
    out = np.bincount(codes, minlength=count) > 1
    out[codes[vals > 0]] = True
    return out[codes].astype(np.uint8)


def _smallest(codes, count, vals):
    """Smallest id with the same two hashes."""
    pair, _ = pd.factorize(codes * count + pd.factorize(vals["check"])[0])
    least = np.full(len(codes), B.NO_ID)
    np.minimum.at(least, pair, vals["id"])
    return least[pair]


def _shared_anchors(left: _Words, right: pa.Table) -> np.ndarray:
    at, key = left.anchors()
    _, code = B.distinct(key)
    shared = np.zeros(len(left.text) + PERIOD, bool)
    shared[at] = B.answers(right, 1, np.uint8)[code] > 0 if len(at) else False
    return shared


def drop_repeats(
    docs: DataFrame, length: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    if length < PERIOD:
        raise ValueError(f"a passage needs at least {PERIOD} words")
    count, bits = B.block_count(docs, text)
    packed = B.pack(docs, doc_id, text, B.block_of(doc_id, text, count))

    def ask_anchors(key, table):
        block = _Words(table, length)
        at, keys = block.anchors()
        found, code = B.distinct(keys)
        first, last = np.zeros((2, len(found)), np.int64)
        first[code[::-1]], last[code] = block.text[at][::-1], block.text[at]
        return B.ask(key[0].as_py(), 1, found, (first != last).astype(np.uint8), bits)

    def ask_passages(key, table, right):
        if not table.num_rows:
            return B.ask(0, 2, np.zeros(0, np.uint64), np.zeros(0, PASSAGE), bits)
        block = _Words(table, length)
        at, keys, check = block.passages(_shared_anchors(block, right))
        found, code = B.distinct(keys)
        vals = np.zeros(len(found), PASSAGE)
        vals["check"][code] = check
        vals["id"] = B.NO_ID
        np.minimum.at(vals["id"], code, block.ids[block.text[at]])
        return B.ask(key[0].as_py(), 2, found, vals, bits)

    def cut(key, table, right):
        if not table.num_rows:
            return pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_removed")]).empty_table()
        block = _Words(table, length)
        at, keys, _ = block.passages(_shared_anchors(block, right))
        _, code = B.distinct(keys)
        least = B.answers(right, 2, np.int64)
        repeated = at[least[code] < block.ids[block.text[at]]] if len(at) else at
        change = np.zeros(len(block.text) + length + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + length, -1)
        return _result(block, np.cumsum(change)[: len(block.text)] > 0, keep_text)

    anchor = B.settle(packed.groupBy("block").applyInArrow(ask_anchors, B.REQUEST), _several, np.uint8)
    anchor = anchor.filter("block >= 0")
    asked = packed.groupBy("block").cogroup(anchor.groupBy("block")).applyInArrow(ask_passages, B.REQUEST)
    passage = B.settle(asked, _smallest, PASSAGE).filter("block >= 0")
    both = anchor.unionByName(passage)
    schema = RESULT.format(", kept_text string" if keep_text else "")
    return packed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, schema)


def _result(block: _Words, gone: np.ndarray, keep_text: bool) -> pa.Table:
    """Counts and kept words of every document of a block."""
    docs = len(block.ids)
    n_words = np.bincount(block.text, minlength=docs)
    n_gone = np.bincount(block.text, weights=gone, minlength=docs).astype(np.int64)
    # Kept words and the byte after each; single spaces then stand where a separator or a gap was.
    keep = ~gone
    size = (block.end - block.start)[keep] + 1
    before = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 32, np.uint8)
    for k in range(0, len(size), W.STEP):
        part = slice(k, k + W.STEP)
        n = size[part] - 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        joined[step + np.repeat(before[part], n)] = block.data[step + np.repeat(block.start[keep][part], n)]
    edge = np.concatenate([[0], np.cumsum(np.bincount(block.text[keep], weights=size, minlength=docs))]).astype(np.int64)
    plain = joined.tobytes()
    kept = [plain[lo : max(lo, hi - 1)] for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
    out = {
        "doc_id": pa.array(block.ids, pa.int64(), mask=block.ids == B.NO_ID),
        "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_gone, pa.int64()),
        "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
    }
    if keep_text:
        out["kept_text"] = [k.decode() for k in kept]
    return pa.table(out)
