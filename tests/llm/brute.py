"""Plain single-process versions of the operators' results, written from their contracts."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def base_scores(rows):
    tokens = {d: [*words(t, True), "\n"] for d, t in rows}
    count = Counter(w for d, ws in tokens.items() if crc(d) % 5 != 1 for w in ws)
    total, kinds = sum(count.values()), len(count)
    return {
        d: (
            crc(d) % 5 == 1,
            len(ws),
            sum(count[w] > 0 for w in ws),
            total,
            sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws),
        )
        for d, ws in tokens.items()
    }


def jump(key, shards):
    """The published algorithm, one key at a time."""
    at, ahead, key = -1, 0, key % 2**64
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def shards(rows, count=8, cells=1024):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row (id, text)."""

    def hashed(*values):
        seed = 42
        for v in values:
            seed = seed if v is None else xxhash.xxh64(int(v).to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return seed

    slim = []
    for d, t in rows:
        data = (t or "").encode()
        crc32, size = zlib.crc32(data), len(data) + 1
        cell = (hashed(d, crc32, size) + 2**63) % 2**64 - 2**63
        slim.append((jump(hashed(d), count), cell % cells, d is not None, d or 0, crc32, size, jump(hashed(d), count + 1)))
    out, at = [], Counter()
    for shard, _, known, d, crc32, size, grown in sorted(slim):
        out.append((d if known else None, size, crc32, "key", shard, at[shard], grown))
        at[shard] += 1
    return out


def cut_repeats(rows, length=13):
    texts = [(d, words(t)) for d, t in sorted(rows, key=lambda r: r[0])]
    first = {}
    for d, ws in texts:
        for i in range(len(ws) - length + 1):
            first.setdefault(tuple(ws[i : i + length]), d)
    out = {}
    for d, ws in texts:
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return out


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def strong_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        moved = len(text) // 4
        out[d] = (len(text), sha(text[: len(text) - moved] + following[:moved]))
    return out


def components(rows, length=3, percent=90):
    sets = {}
    for d, t in rows:
        ws = words(t, True)
        sets[d] = (
            {tuple(ws[i : i + length]) for i in range(len(ws) - length + 1)}
            if len(ws) >= length
            else ({tuple(ws)} if ws else set())
        )
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaks(rows, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = ITEM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(ws) - length + 1) if ws else 0):
            windows[tuple(ws[i : i + length])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in rows:
        ws = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out[d] = (len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def token_rows(rows, tokenizer):
    out, at = {}, 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def conversations(rows):
    """Results of a formatted table of (conv_id, turn, role, text), by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted(
            (x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        )]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def middles(rows):
    out = {}
    for d, text in rows:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
        n = len(units)
        h = [int(sha(f"1:{'null' if d is None else d}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
        if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out[d] = (n, "plain", None, None, sha(text), sha(text))
        elif h[3] % 100 < 20:
            out[d] = (n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
        else:
            out[d] = (n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))
    return out


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranks(rows, items, k=10):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in rows]
    terms = [(d, ws) for d, ws in terms if ws]
    docs, total = len(terms), sum(len(ws) for _, ws in terms)
    df = Counter(w for _, ws in terms for w in set(ws))
    counts = [(d, len(ws), Counter(ws)) for d, ws in terms]
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, words_asked in asked.items():
        found = []
        for d, n, tf in counts:
            m = 100 - 90 + (90 * n * docs) // total
            score = 0
            for w in words_asked & tf.keys():
                weight = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else d, -score))
    return out


WEAK = {
    "login": re.compile(r"""(?:user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{2,})""", re.I | re.A),
    "secret": re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}"),
    "endpoint": re.compile(r"""(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+)"""),
}
RANK = ["assign", "access", "hex", *WEAK]


def linked_spans(text, reach=200):
    """All spans: strong ones, and weak ones of pairs, found by looking at every pair."""
    strong = [(s, kind, e) for s, _, kind, e in strong_spans(text)]
    weak = []
    for kind, pattern in WEAK.items():
        weak += [(m.start(1) if kind == "endpoint" else m.start(), kind, m.end()) for m in pattern.finditer(text or "")]

    def near(a, b):
        apart = a[2] <= b[0] or b[2] <= a[0]
        return apart and a[0] - b[2] <= reach and b[0] - a[2] <= reach

    every = strong + weak
    members = set()
    for a in every:
        for b in every:
            if a[1] in ("access", "login") and b[1] in ("assign", "hex", "secret") and near(a, b):
                members |= {a, b}
    members |= {e for e in every if e[1] == "endpoint" and any(near(m, e) for m in members)}
    found = strong + [m for m in members if m[1] in WEAK]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, RANK.index(k), k, e) for s, k, e in found))
