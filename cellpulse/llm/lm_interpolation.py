"""Language-model scores by deleted interpolation of word n-grams.

The probability of a token is a mixture of three estimates: the maximum-likelihood bigram, the
maximum-likelihood unigram, and one over V + 1 (the known words and one unknown). The weights depend
on a bucket of the context's frequency (its power of two) and are learned by expectation-maximisation
on held-out counts: the training documents of one fold are scored with their own counts deleted from
every count, so a document never vouches for itself.

Counts stay distributed. A block of documents asks once for each of its distinct words and bigrams and
gets corpus totals back; neither the vocabulary nor the bigrams are ever broadcast or collected. The
driver sees counts of (bucket, log-ratio cell) of the held-out fold, at most ``CELLS`` rows, and N and V.

Every document ends in one end token; the end token is also the context of the first word.

Edge cases: null and empty texts are one end token; a null id belongs to training; without training
documents each estimate but the uniform one is empty and has weight 0; rows with one id are scored each
for itself and count each; an empty table gives no rows; further columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import blocks as B
from cellpulse.llm import words as W
from cellpulse.session import materialise

WORD, BIGRAM = 1, 2
#: Hash of the end token.
END = np.uint64(0xA0761D6478BD642F)
#: Context-frequency buckets, and steps per power of two and range of a log-ratio cell.
BUCKETS, STEPS, RANGE = 42, 4, 80
SIDE = STEPS * RANGE + 2
CELLS = BUCKETS * SIDE * SIDE
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def remainder(ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of the id as text modulo ``folds``; a null id counts as no text."""
    return np.array([zlib.crc32(b"" if i == B.NO_ID else b"%d" % i) % folds for i in ids.tolist()], np.int64)


def spark_remainder(doc_id: str, folds: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


class _Tokens:
    """Tokens of a block with their distinct words and bigrams."""

    def __init__(self, table: pa.Table):
        self.ids, data, at = B.unpack(table)
        start, end, text = W.find_words(data, at, W.separators(W.SPACES))
        docs = len(self.ids)
        of_doc = np.bincount(text, minlength=docs)
        token = np.empty(len(text) + docs, np.uint64)
        token[np.arange(len(text)) + text] = W.mixed(W.hash_pieces(data, start, end, W.hash_table(lower=True)))
        token[np.cumsum(of_doc + 1) - 1] = W.mixed(np.array([END]))[0]
        self.doc = np.repeat(np.arange(docs), of_doc + 1)
        before = np.concatenate([W.mixed(np.array([END])), token[:-1]])
        self.words, self.word = B.distinct(token)
        self.context = np.concatenate([[self.word[-1]], self.word[:-1]])  # the last token of all is an end token
        self.bigrams, self.bigram = B.distinct(W.mixed(before * np.uint64(0x9FB21C651E98DF25) + token))


def _ask(table, block, bits, folds, held_out):
    t = _Tokens(table)
    train = (remainder(t.ids, folds) != held_out)[t.doc]
    word = np.bincount(t.word[train], minlength=len(t.words)).astype(np.uint32)
    bigram = np.bincount(t.bigram[train], minlength=len(t.bigrams)).astype(np.uint32)
    return pa.concat_tables(
        [B.ask(block, WORD, t.words, word, bits), B.ask(block, BIGRAM, t.bigrams, bigram, bits)]
    )


def _total(codes, count, vals):
    total = np.bincount(codes, weights=vals, minlength=count)
    if total.max(initial=0) > np.iinfo(np.uint32).max:
        raise OverflowError("a token's total does not fit in 32 bits")
    return total[codes].astype(np.uint32)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the floor of its count's binary logarithm."""
    return np.frexp(context.astype(np.float64))[1].clip(0, BUCKETS - 1)


def _estimates(t, bigram, word, context, total):
    """Bigram and unigram estimates of every token, 0 where there is none."""
    two = np.divide(bigram, context, out=np.zeros(len(bigram)), where=context > 0)
    one = np.divide(word, total, out=np.zeros(len(word)), where=total > 0)
    return two, one


def _own(t, code: np.ndarray, kinds: int) -> np.ndarray:
    """How often each token's word or bigram occurs in the token's own document."""
    _, same = B.distinct((t.doc * kinds + code).astype(np.uint64))
    return np.bincount(same)[same]


def _cell(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of 0, else its binary logarithm in steps, from -RANGE/2 on."""
    log = np.log2(np.maximum(ratio, 1e-300))
    return np.where(ratio > 0, 1 + np.clip(np.rint((log + RANGE / 2) * STEPS), 0, SIDE - 2), 0).astype(np.int64)


def _held_out_cells(table, right, total, vocabulary):
    """Counts of (bucket, bigram cell, unigram cell) in a block of the tuning fold, its documents deleted."""
    t = _Tokens(table)
    word, bigram = B.answers(right, WORD, np.uint32), B.answers(right, BIGRAM, np.uint32)
    own_word = _own(t, t.word, len(t.words))
    first = np.concatenate([[True], np.diff(t.doc) != 0])
    own_context = np.concatenate([[1], own_word[:-1]])
    own_context[first] = 1  # the end token of the document itself
    context = word[t.context].astype(np.int64) - own_context
    length = np.bincount(t.doc)[t.doc]
    two, one = _estimates(
        t, bigram[t.bigram] - _own(t, t.bigram, len(t.bigrams)), word[t.word] - own_word, context, total - length
    )
    cell = (_bucket(context) * SIDE + _cell(two * (vocabulary + 1))) * SIDE + _cell(one * (vocabulary + 1))
    found, n = np.unique(cell, return_counts=True)
    return pa.table({"cell": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})


def fit_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) per bucket by expectation-maximisation.

    A bucket that the tuning fold never meets takes the weights of the next lower one it meets.
    """
    bucket, rest = np.divmod(cells, SIDE * SIDE)
    ratio = lambda c: np.where(c > 0, 2.0 ** ((c - 1) / STEPS - RANGE / 2), 0)
    part = np.stack([ratio(rest // SIDE), ratio(rest % SIDE), np.ones(len(rest))])
    weights = np.tile(np.array([[0.4], [0.5], [0.1]]), BUCKETS)
    weights[:, 0] = (0, 0.8, 0.2)
    met = np.bincount(bucket, weights=counts, minlength=BUCKETS)
    for _ in range(rounds):
        share = part * weights[:, bucket]
        share *= counts / share.sum(0)
        new = np.stack([np.bincount(bucket, weights=s, minlength=BUCKETS) for s in share])
        weights = np.where(met > 0, new / np.maximum(met, 1), weights)
    for b in range(1, BUCKETS):
        if not met[b] and met[1:b].any():
            weights[:, b] = weights[:, b - 1]
    weights = np.maximum(weights, [[0], [1e-9], [1e-9]])
    return weights / weights.sum(0)


def _scores(table, right, folds, held_out, total, vocabulary, weights):
    t = _Tokens(table)
    word, bigram = B.answers(right, WORD, np.uint32), B.answers(right, BIGRAM, np.uint32)
    context = word[t.context].astype(np.int64)
    two, one = _estimates(t, bigram[t.bigram], word[t.word], context, total)
    w = weights if total else np.tile(np.array([[0.0], [0.0], [1.0]]), BUCKETS)
    b = _bucket(context)
    probability = w[0, b] * two + w[1, b] * one + w[2, b] / (vocabulary + 1)
    base = (word[t.word] + 0.5) / (total + 0.5 * (vocabulary + 1))
    n = len(t.ids)
    add = lambda values: np.bincount(t.doc, weights=values, minlength=n)
    return pa.table(
        {
            "doc_id": pa.array(t.ids, pa.int64(), mask=t.ids == B.NO_ID),
            "held_out": pa.array(remainder(t.ids, folds) == held_out),
            "n_tokens": pa.array(np.bincount(t.doc, minlength=n), pa.int64()),
            "n_known": pa.array(add(word[t.word] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, total), pa.int64()),
            "base_score": pa.array(add(np.log10(base))),
            "score": pa.array(add(np.log10(probability))),
        }
    )


def score_documents(
    docs: DataFrame, folds: int = 5, held_out: int = 1, tuning: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Documents whose id's crc32 modulo ``folds`` is ``held_out`` teach nothing; of the others, those with
    remainder ``tuning`` are the fold on which the weights are learned.
    """
    if tuning == held_out:
        raise ValueError("the tuning fold must be one of the training folds")
    count, bits = B.block_count(docs, text)
    # Blocks of the tuning fold come after the others, so that they can be read alone.
    is_tuning = spark_remainder(doc_id, folds) == tuning
    few = -(-count // folds)
    block = F.when(is_tuning, count + B.block_of(doc_id, text, few)).otherwise(B.block_of(doc_id, text, count))
    packed = B.pack(docs, doc_id, text, block)
    asked = packed.groupBy("block").applyInArrow(
        lambda key, table: _ask(table, key[0].as_py(), bits, folds, held_out), B.REQUEST
    )
    counts = materialise(B.settle(asked, _total, np.uint32), "counts")
    known = counts.filter(f"block = -1 and channel = {WORD}").agg(F.sum("distinct"), F.sum("total")).first()
    vocabulary, total = known[0] or 0, int(known[1] or 0)
    replies = counts.filter("block >= 0")

    def learn(key, table, right):
        if not table.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return _held_out_cells(table, right, total, vocabulary)

    held = B.pack(docs.filter(is_tuning), doc_id, text, block)
    cells = (
        held.groupBy("block")
        .cogroup(replies.filter(F.col("block") >= count).groupBy("block"))
        .applyInArrow(learn, "cell long, n long")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = fit_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))

    def score(key, table, right):
        return _scores(table, right, folds, held_out, total, vocabulary, weights)

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, RESULT)
