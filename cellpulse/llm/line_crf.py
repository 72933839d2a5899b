"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What speaks for one or the other are features of the line and of the lines
before and after it (shares of character classes, word lengths, words that repeat their neighbour), and
neighbouring lines' states pull on each other. Forward-backward gives each line's probability of being
good; their mean, weighted by the lines' lengths, is the document's quality.

The field is fitted on labelled documents, every line taking its document's label, by gradient ascent
on the conditional likelihood. The fit sees a bounded sample of labelled lines: of at most ``sample``
labelled documents (those whose ids hash lowest) at most ``chains`` chains of ``chain`` lines each, evenly
spread over the document; it runs on the driver on that table of numbers. Scoring covers whole texts of all documents, row by row, without a
shuffle.

Edge cases: null and empty texts are one empty line and get its probability; null labels and labels of
unknown documents teach nothing; without any label every score is 0.5; repeated rows are scored each
for itself; an empty table gives no rows; further columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellpulse.llm import words as W

#: Lines of a chain and chains of a labelled document that teach, unless the caller sets other bounds.
CHAIN, CHAINS = 64, 4
TEXT_BYTES = 1 << 20
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:'\"-()?", b"!", b"|", b"#$%&*+<=>@\\^_`~/[]{}")
OWN = len(CLASSES) + 8
FEATURES = 3 * OWN + 3


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)  # letters and all else
    table[:32] = len(CLASSES) + 1  # control characters
    for number, chars in enumerate(CLASSES):
        table[list(chars)] = number
    return table


def lines_of(data: np.ndarray, at: np.ndarray):
    """Start, end and text number of all lines; a text has one more than it has line breaks."""
    breaks = np.flatnonzero(data == 10)
    text = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, "right") - 1])
    start = np.concatenate([at[:-1], breaks + 1])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    last = np.append(text[1:] != text[:-1], True)
    end = np.where(last, at[text + 1], np.append(start[1:], 0) - 1)
    return start, end, text


def features(data: np.ndarray, at: np.ndarray):
    """Rows of ``FEATURES`` numbers for all lines, their lengths and text numbers."""
    start, end, text = lines_of(data, at)
    size, kinds = end - start, len(CLASSES) + 2
    count, table = np.zeros((len(start), kinds)), _class_table()
    reach, lo = np.cumsum(size), 0
    while lo < len(start):  # about a MB at a time
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + (1 << 20), "right")))
        line = np.repeat(np.arange(hi - lo), size[lo:hi])
        byte = np.arange(len(line)) + np.repeat(start[lo:hi] - (np.cumsum(size[lo:hi]) - size[lo:hi]), size[lo:hi])
        flat = np.bincount(line * kinds + table[data[byte]], minlength=(hi - lo) * kinds)
        count[lo:hi] = flat.reshape(-1, kinds)
        lo = hi
    first, stop, _ = W.find_words(data, at, W.separators(W.SPACES))
    hashes = W.hash_pieces(data, first, stop, W.hash_table(lower=True))
    mine = np.searchsorted(start, first, "right") - 1
    # An empty text's line may start where the next text's does; words belong to the later one.
    again = np.zeros(len(first), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (mine[1:] == mine[:-1])
    words = np.bincount(mine, minlength=len(start))
    safe, some = np.maximum(size, 1), np.maximum(words, 1)
    own = np.zeros((len(start), OWN))
    own[:, :kinds] = count / safe[:, None]
    own[:, kinds] = np.log1p(size) / 5
    own[:, kinds + 1] = np.bincount(mine, weights=stop - first, minlength=len(start)) / some / 10
    own[:, kinds + 2] = np.bincount(mine, weights=again, minlength=len(start)) / some
    own[:, kinds + 3] = np.bincount(mine, weights=stop - first == 1, minlength=len(start)) / some
    letters = count[:, len(CLASSES)] + count[:, 0]
    own[:, kinds + 4] = count[:, 0] / np.maximum(letters, 1)
    own[:, kinds + 5] = (size == 0) * 1.0
    begins = np.append(True, text[1:] != text[:-1])
    ends = np.append(begins[1:], True)
    row = np.zeros((len(start), FEATURES))
    row[:, :OWN] = own
    row[1:, OWN : 2 * OWN] = own[:-1] * ~begins[1:, None]
    row[:-1, 2 * OWN : 3 * OWN] = own[1:] * ~ends[:-1, None]
    row[:, 3 * OWN], row[:, 3 * OWN + 1], row[:, 3 * OWN + 2] = begins, ends, 1
    return row, size, text


class Field:
    """Weights of good against bad for the features, and of the four pairs of neighbouring states."""

    def __init__(self, weights=None, pairs=None, mean=None, scale=None):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs
        self.mean = np.zeros(FEATURES) if mean is None else mean
        self.scale = np.ones(FEATURES) if scale is None else scale

    def states(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def chains(self, score: np.ndarray, chain: np.ndarray):
        """Log-odds of good before and after each line, all chains stepping together.

        ``before`` holds what a line and those ahead of it say, ``after`` what those behind it say.
        """
        size = np.bincount(chain)
        first = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        most = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
        before, after = score.copy(), np.zeros(len(score))
        bad, good = self.pairs[:, 0], self.pairs[:, 1]

        def onward(odds, to_good, to_bad):
            return np.logaddexp(odds + to_good[1], to_good[0]) - np.logaddexp(odds + to_bad[1], to_bad[0])

        for step in range(1, len(most)):
            at = first[order[: most[step]]] + step
            before[at] += onward(before[at - 1], good, bad)
        for step in range(1, len(most)):
            here = order[: most[step]]
            at = first[here] + size[here] - 1 - step
            after[at] = onward(score[at + 1] + after[at + 1], self.pairs[1], self.pairs[0])
        return before, after

    def fit(self, rows: np.ndarray, label: np.ndarray, chain: np.ndarray, rounds: int = 300, decay: float = 1e-3):
        """Gradient ascent (with running moments) on the mean log-likelihood per line."""
        self.mean, self.scale = rows.mean(0), rows.std(0)
        self.mean[-1], self.scale = 0, np.where(self.scale > 1e-9, self.scale, 1)
        rows = (rows - self.mean) / self.scale
        linked = np.flatnonzero(chain[1:] == chain[:-1]) + 1
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[linked - 1].astype(int), label[linked].astype(int)), 1)
        value = np.concatenate([self.weights, self.pairs.ravel()])
        mean, square = np.zeros_like(value), np.zeros_like(value)
        for step in range(1, rounds + 1):
            self.weights, self.pairs = value[:-4], value[-4:].reshape(2, 2)
            score = rows @ self.weights
            before, after = self.chains(score, chain)
            good = _sigmoid(before + after)
            # Expected pairs, from what is known on either side of each link.
            left, right = before[linked - 1], score[linked] + after[linked]
            table = self.pairs + np.stack([np.zeros_like(left), left], 1)[:, :, None] + np.stack([np.zeros_like(right), right], 1)[:, None, :]
            table = np.exp(table - table.max((1, 2), keepdims=True))
            expected = (table / table.sum((1, 2), keepdims=True)).sum(0)
            slope = np.concatenate([rows.T @ (label - good), (seen - expected).ravel()]) / len(rows) - decay * value
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            value = value + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.pairs = value[:-4], value[-4:].reshape(2, 2)
        return self

    def quality(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability of good lines for every text."""
        rows, size, text = features(data, at)
        before, after = self.chains(self.states(rows), text)
        weight = size + 1
        docs = len(at) - 1
        good = np.bincount(text, weights=_sigmoid(before + after) * weight, minlength=docs)
        return good / np.bincount(text, weights=weight, minlength=docs)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


TABLE = f"label double, chain_id string, place int, {', '.join(f'f{k} float' for k in range(FEATURES))}"


def _training_lines(batches, chains: int, chain: int):
    """Feature rows of labelled texts, in chains."""
    for batch in batches:
        for piece in W.slices(batch, 1, TEXT_BYTES):
            data, at = W.flat(piece.column(1))
            rows, _, text = features(data, at)
            place = np.arange(len(text)) - np.searchsorted(text, text)
            count = np.bincount(text)[text] // chain + 1
            part = place // chain
            use = part % np.maximum(1, -(-count // chains)) == 0
            ids, labels = piece.column(0).to_pylist(), piece.column(2).to_numpy(zero_copy_only=False)
            out = {
                "label": pa.array(labels[text[use]], pa.float64()),
                "chain_id": [f"{ids[t]}:{p}" for t, p in zip(text[use], part[use], strict=True)],
                "place": pa.array(place[use], pa.int32()),
            }
            yield pa.RecordBatch.from_pydict(out | {f"f{k}": pa.array(rows[use, k].astype(np.float32)) for k in range(FEATURES)})


def fit_field(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    chains: int = CHAINS, chain: int = CHAIN,
) -> Field:
    """Fits on at most ``sample`` of the labels (id, 0 or 1), those whose ids hash lowest, and of each text on
    at most ``chains`` chains of ``chain`` lines."""
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label"))
        .filter("_id is not null and _label is not null")
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample)
    )
    # Only the two columns in question, so further ones may have any names. At most ``sample`` labels.
    own = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text"))
    taught = own.join(F.broadcast(chosen), F.col("_own") == F.col("_id")).select("_id", "_text", "_label")
    lines = taught.mapInArrow(lambda batches: _training_lines(batches, chains, chain), TABLE)
    table = lines.toPandas().sort_values(["chain_id", "place"])
    if table.empty:
        return Field()
    of_chain = pd.factorize(table["chain_id"])[0]
    rows = table[[f"f{k}" for k in range(FEATURES)]].to_numpy(np.float64)
    return Field().fit(rows, table["label"].to_numpy(), of_chain)


def _batch_quality(field: Field, batch, place: int) -> np.ndarray:
    """Quality of every text of an Arrow batch, about a MB of text at a time."""
    parts = [field.quality(*W.flat(p.column(place))) for p in W.slices(batch, place, TEXT_BYTES)]
    return np.concatenate(parts) if parts else np.zeros(0)


def quality_column(field: Field, text):
    """Column with the quality of a text column."""

    @F.arrow_udf(DoubleType())
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(_batch_quality(field, pa.RecordBatch.from_arrays([texts], names=["text"]), 0))

    return quality(text)


def good_rows(docs: DataFrame, field: Field, least: float, text: str = "text") -> DataFrame:
    """The documents of at least this quality, with all their columns.

    The rows themselves pass through Python, so nothing keeps a second copy of them beside it.
    """
    place = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            yield batch.filter(pa.array(_batch_quality(field, batch, place) >= least))
        W.release()

    return docs.mapInArrow(work, docs.schema)
