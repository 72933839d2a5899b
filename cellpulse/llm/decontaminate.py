"""Benchmark decontamination: one Aho-Corasick automaton, one scan of each text.

Benchmark texts are cut into windows of consecutive normalised words (an item with fewer words is one
window). The automaton of all windows runs once over each document's normalised text; matches are
mapped back to words and to places in the original text.

The windows travel to the executors. Their size is checked: the automaton is built in slices of at
most ``slice_bytes`` of benchmark text, one after the other over the same batch, and a benchmark of
more than ``most_bytes`` is refused, because each executor would hold it.

Edge cases: null, empty and wordless texts have no words and no hits; items without words are never
found; equal items are all reported; repeated rows are judged each for itself; an empty table on
either side gives no hits; further columns are ignored.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import words as W

#: Bytes that end a word: all ASCII but digits and letters.
ENDS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Separators become spaces, A-Z become a-z, everything else stays.
NORMAL = bytes(32 if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id {}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def normalise(text: str | None) -> str:
    """Words with one space before and after each; one character per byte."""
    inner = b" ".join((text or "").encode().translate(NORMAL).split())
    return f" {inner.decode('latin-1')} " if inner else ""


def windows_of(items, length: int) -> dict[str, set[str]]:
    """Normalised window to the ids of the items that contain it."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normalise(text).split()
        for k in range(max(1, len(words) - length + 1) if words else 0):
            found.setdefault(f" {' '.join(words[k : k + length])} ", set()).add(str(item))
    return found


def automaton(items, length: int):
    built = ahocorasick.Automaton()
    for window, ids in windows_of(items, length).items():
        built.add_word(window, (len(window), sorted(ids)))
    if len(built):
        built.make_automaton()
    return built


def scan(text: str | None, built) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, numbers of the hit words, ids of the items found."""
    normal = normalise(text)
    if not normal:
        return 0, np.zeros(0, np.int64), set()
    spans, items = [], set()
    if len(built):
        for end, (size, ids) in built.iter(normal):
            spans.append((end - size + 1, end))
            items.update(ids)
    if not spans:
        return normal.count(" ") - 1, np.zeros(0, np.int64), items
    gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    edges = np.searchsorted(gaps, np.array(spans))
    change = np.zeros(len(gaps) + 1, np.int64)
    np.add.at(change, edges[:, 0], 1)
    np.add.at(change, edges[:, 1], -1)
    return len(gaps) - 1, np.flatnonzero(np.cumsum(change) > 0), items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code-point spans (end exclusive) of runs of hit words."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = W.find_words(data, np.array([0, len(data)]), W.separators(ENDS))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": int(points[start[r[0]]]), "end": int(points[end[r[-1]]])} for r in runs]


class Scanner:
    """Scans batches with the automata of all slices; that of a single slice is built once."""

    def __init__(self, slices, length: int):
        self.slices, self.length = slices, length
        self.only = automaton(slices[0], length) if len(slices) == 1 else None

    def scan(self, texts):
        """``scan`` of every text, over all slices."""
        whole = None
        for items in self.slices:
            built = self.only if self.only is not None else automaton(items, self.length)
            part = [scan(t, built) for t in texts]
            if whole is None:
                whole = part
            else:
                whole = [(n, np.union1d(h, g), i | j) for (n, h, i), (_, g, j) in zip(whole, part, strict=True)]
        return whole


def send_benchmark(benchmark: DataFrame, item_id: str, item_text: str, slice_bytes: int, most_bytes: int):
    """Broadcast of the items in slices, after a check of their size."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"benchmark of {size} bytes; at most {most_bytes} can be held by an executor")
    slices, room = [[]], slice_bytes
    for row in items.toLocalIterator():
        if room <= 0:
            slices.append([])
            room = slice_bytes
        slices[-1].append((row["item"], row["text"]))
        room -= len((row["text"] or "").encode())
    return benchmark.sparkSession.sparkContext.broadcast(slices)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    slice_bytes: int = 8 << 20,
    most_bytes: int = 256 << 20,
) -> DataFrame:
    """Per document: n_words, n_hit, the items found, and the hit spans of the original text."""
    sent = send_benchmark(benchmark, item_id, item_text, slice_bytes, most_bytes)

    def work(batches):
        scanner = Scanner(sent.value, length)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = list(zip(texts, scanner.scan(texts), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for _, (n, _, _) in found], pa.int64()),
                    pa.array([len(hit) for _, (_, hit, _) in found], pa.int64()),
                    pa.array([sorted(ids) for _, (_, _, ids) in found], pa.list_(pa.string())),
                    pa.array(
                        [original_spans(p, hit) if len(hit) else [] for p, (_, hit, _) in found],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(work, SCHEMA.format(slim.schema["doc_id"].dataType.simpleString()))


def clean_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    slice_bytes: int = 8 << 20,
    most_bytes: int = 256 << 20,
) -> DataFrame:
    """The documents without any hit, with all their columns."""
    sent = send_benchmark(benchmark, item_id, item_text, slice_bytes, most_bytes)
    place = docs.columns.index(text)

    def work(batches):
        scanner = Scanner(sent.value, length)
        for batch in batches:
            found = scanner.scan(batch.column(place).to_pylist())
            yield batch.filter(pa.array([len(hit) == 0 for _, hit, _ in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
