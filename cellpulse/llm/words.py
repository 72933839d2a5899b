"""Words of whole blocks of text as NumPy arrays: byte positions, 64-bit hashes, window hashes.

A block is the UTF-8 of many texts laid end to end, as Arrow stores it. Words are maximal runs of
bytes outside a separator set and never cross a text's end. All work is per block, never per word.
Hashes are sums of random numbers drawn for (place in the word, byte), so that two different words
agree with probability 2**-64.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes at which words end: space and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Places in a word with random numbers of their own; later ones reuse them times an odd factor.
PLACES = 64
#: Words hashed at a time, which bounds the memory beside the block.
STEP = 100_000


def _random(seed: int, *shape: int) -> np.ndarray:
    """Fixed random 64-bit numbers, the same in every process."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, shape, np.uint64)


def hash_table(seed: int = 1, lower: bool = False) -> np.ndarray:
    """Random numbers by place * 256 + byte; ``lower`` gives A-Z the numbers of a-z."""
    table = _random(seed, PLACES, 256)
    if lower:
        table[:, 65:91] = table[:, 97:123]
    return table.ravel()


def separators(chars: bytes) -> np.ndarray:
    """Look-up by byte: True where a word ends."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets at which they start; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks])
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, at: np.ndarray, ends: np.ndarray):
    """Start, end and text number of every word. ``ends``: the look-up of separators."""
    inside = ~ends[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def hash_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every pair; none is empty."""
    out = np.empty(len(start), np.uint64)
    for k in range(0, len(start), STEP):
        s, n = start[k : k + STEP], (end - start)[k : k + STEP]
        before = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(before, n)
        byte = data[place + np.repeat(s, n)]
        value = table[((place & (PLACES - 1)) << 8) | byte]
        if n.max() > PLACES:
            odd = np.full(int(n.max()) // PLACES + 1, 0x9E3779B97F4A7C15, np.uint64)
            odd[0] = 1  # a word's hash must not depend on the longest word beside it
            odd = np.cumprod(odd)
            value = value * odd[place // PLACES]
        out[k : k + STEP] = np.add.reduceat(value, before)
    return out


def windows(hashes: np.ndarray, text: np.ndarray, length: int, seed: int = 7):
    """Hash of each run of ``length`` words and whether the run lies within one text.

    The arrays have one entry per word at which such a run could start.
    """
    count = max(0, len(hashes) - length + 1)
    factor = _random(seed, length) | np.uint64(1)
    out = np.zeros(count, np.uint64)
    for k in range(length):
        out += hashes[k : k + count] * factor[k]
    return out, text[:count] == text[length - 1 : length - 1 + count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Values spread evenly over 64 bits, so that ranges of them are of even size."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch, column: int, most: int):
    """Pieces of an Arrow batch with at most ``most`` bytes in a text column, or one longer text."""
    size = flat(batch.column(column))[1][1:]
    lo = 0
    while lo < batch.num_rows:
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def release() -> None:
    """Gives memory that is no longer used back to the machine: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
