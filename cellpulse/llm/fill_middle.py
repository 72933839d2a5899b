"""Fill-in-the-middle transformation: texts cut at two token ranks and put in another order.

Tokens are runs of ASCII letters and single other code points. The cuts and the form depend on the
document's id and a seed alone, so a repeated run gives the same texts. Both ranks are found by descent in
an indexable skip list (``skip_list``). The transformation works on each document alone: no shuffle.

Edge cases: a null text counts as empty, which is plain, as is a text that holds a sentinel; a null id is
written as ``null`` for the draw; texts of any length are taken whole, one at a time, at some 40 bytes of
memory per code point; repeated rows give repeated results; an empty table gives no rows; further columns
are ignored.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm import words as W
from cellpulse.llm.skip_list import SkipList

# The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
#: Documents in a hundred that are transformed, and transformed ones in a hundred with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of text worked on at a time.
PIECE_BYTES = 8 << 20
SCHEMA = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, output string"


def token_widths(text: str) -> np.ndarray:
    """Code points of every token of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    first = np.ones(len(points), bool)
    first[1:] = ~(letter[1:] & letter[:-1])
    return np.diff(np.flatnonzero(first), append=len(points))


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers for a document."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id, text: str | None, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST):
    """Tokens, form, code points of prefix and middle (None if plain), output."""
    text = text or ""
    widths = token_widths(text)
    one, two, keep, turn = draws(doc_id, seed)
    if not text or keep % 100 >= changed or SENTINEL.search(text):
        return len(widths), "plain", None, None, text
    tokens = SkipList(widths)
    low, high = sorted((one % (len(widths) + 1), two % (len(widths) + 1)))
    start, end = tokens.at_unit(low), tokens.at_unit(high)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if turn % 100 < suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return len(widths), form, start, end - start, output


def fill_middle(
    docs: DataFrame,
    seed: int = 1,
    changed: int = CHANGED,
    suffix_first: int = SUFFIX_FIRST,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: n (tokens), form, prefix_chars, middle_chars and the output text."""

    def work(batches):
        for batch in (piece for whole in batches for piece in W.slices(whole, 1, PIECE_BYTES)):
            ids = batch.column(0).to_pylist()
            rows = [transform(d, t.as_py(), seed, changed, suffix_first) for d, t in zip(ids, batch.column(1), strict=True)]
            n, form, start, middle, output = zip(*rows, strict=True)
            numbers = [pa.array(values, pa.int64()) for values in (n, start, middle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), numbers[0], pa.array(form, pa.string()), *numbers[1:], pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(work, SCHEMA.format(slim.schema["doc_id"].dataType.simpleString()))


def restored(output, form):
    """Column with the text that an output of that form was made from.

    The first sentinel of a kind is the one set: a text that is not plain holds none, and none can arise
    where text and sentinel meet.
    """

    def split(rest, mark):
        head = F.substring_index(rest, mark, 1)
        return head, F.substr(rest, F.length(head) + F.lit(len(mark) + 1))

    inner = F.substr(output, F.lit(4))
    prefix, rest = split(inner, SUFFIX)
    suffix, middle = split(rest, MIDDLE)
    ahead, later = split(inner, PREFIX)
    before, between = split(later, MIDDLE)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(before, between, ahead))
        .otherwise(output)
    )
