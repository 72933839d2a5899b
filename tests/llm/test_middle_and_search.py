"""Fill-in-the-middle over skip lists, and ranked search, against plain versions."""

import os
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from cellpulse.llm import fill_middle, hybrid_search, queries  # noqa: E402
from cellpulse.llm.skip_list import SkipList  # noqa: E402

TEXTS = [
    None,
    "",
    "one",
    "One two, THREE",
    " \n\t\r\n ",
    "naïve Ünïcode 日本語 😀😀 done end",
    "has <P> inside",
    "almost <P <S <M and <<P",
    "<S" * 9 + ">",
    "x" * 70_000,
    "a b" * 100_000,
    "same text",
    "same text",
]
ROWS = [(i * 7 - 14, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (5, "twice"), (5, "twice")]
MADE = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@pytest.mark.parametrize("count", [0, 1, 8, 9, 1000, 20_000])
def test_skip_list(count):
    rng = random.Random(count)
    widths = np.array([rng.randint(1, 9) for _ in range(count)], np.int64)
    found, ends = SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    ranks = {0, count, *(rng.randint(0, count) for _ in range(200))}
    assert all(found.at_unit(r) == ends[r] for r in ranks)
    assert all(found.at_point(int(p)) == np.searchsorted(ends, p, "right") - 1 for r in ranks for p in (ends[r], max(0, ends[r] - 1)))
    if count > 100:
        assert len(found.lanes) > 2 and len(found.lanes[-1][0]) < 100
    for (units, points, _), (upper_units, upper_points, down) in zip(found.lanes, found.lanes[1:]):
        assert units.sum() == upper_units.sum() == count and points.sum() == upper_points.sum() == widths.sum()
        assert down[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <PSM>é😀\n", max_size=40), st.integers(0, 10_000))
def test_transform(text, doc_id):
    n, form, prefix, middle, output = fill_middle.transform(doc_id, text)
    expected = brute.middles([(doc_id, text)])[doc_id]
    assert (n, form, prefix, middle, brute.sha(output)) == expected[:5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, 9, "out", "form") for d, t in reversed(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, output string, form string").repartition(4)


def digests(made):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.withColumns(
        {"output_sha256": sha(F.col("output")), "restored_sha256": sha(fill_middle.restored(F.col("output"), F.col("form")))}
    )


def test_middles_of_awkward_texts(docs):
    got = digests(fill_middle.fill_middle(docs)).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: tuple(r[c] for c in MADE) for r in got} == brute.middles(ROWS)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(docs.filter("n < 0")).count() == 0


def test_middles_of_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_skip_list_fim(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in MADE) for r in got} == brute.middles(rows)


WORDS = [f"w{i}" for i in range(40)] + ["Straße", "ÉCOLE", "x1", "日本"]


def corpus(seed, count):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [
        (rng.randint(-50, 50) * 3, rng.choice([" ", "-", "\n"]).join(rng.choices(WORDS, weights, k=rng.randint(1, 30))))
        for _ in range(count)
    ]
    return rows + [(None, "w0 w1 w39"), (7, None), (8, ""), (9, " -- "), (10, "w39 " * 5000), rows[0], rows[0]]


ITEMS = [
    (1, "w0 W1 w2"),
    (2, "w39 w38 straße nowhere"),
    (3, None),
    (4, " ., "),
    (5, "nowhere"),
    (None, "w20"),
    (6, "w3 w3 w3"),
    (6, "w30"),
    (7, " ".join(WORDS)),
    (8, "École école 日本"),
]


@pytest.mark.parametrize(("stride", "short", "block"), [(256, 64, 8 << 20), (4, 3, 2000), (16, 0, 500), (8, 10_000, 4000)])
def test_search_equals_plain_scores(spark, stride, short, block):
    rows = corpus(stride, 700)
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, rank int, score string").repartition(3)
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id int, text string, doc_id int")
    sizes = {"stride": stride, "short_list": short, "block_bytes": block}
    got = hybrid_search.search(docs, items, k=7, **sizes)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "bigint", "bigint"]
    key = lambda row: [(v is None, v) for v in row]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.ranks(rows, ITEMS, 7), key=key)
    in_groups = hybrid_search.search(docs, items, k=7, group_bytes=1, **sizes)
    assert sorted(map(tuple, in_groups.collect()), key=key) == sorted(map(tuple, got.collect()), key=key)
    for some_docs, some_items in ((docs.filter("rank = 0"), items), (docs, items.filter("doc_id = 0"))):
        assert hybrid_search.search(some_docs, some_items).count() == 0


def test_strides_are_skipped_and_nothing_is_lost():
    """Blocks alone, where what is skipped can be counted, with every threshold that may be carried in."""
    rows = corpus(1, 3000)
    vocabulary = hybrid_search.Vocabulary(sorted(hybrid_search.terms_of(" ".join(WORDS))))
    texts = [t or "" for _, t in rows]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    lengths, place, code, count = vocabulary.postings(data, at)
    codes, sizes = np.unique(code, return_counts=True)
    ids = np.arange(len(rows))
    shrunk = [hybrid_search._shrunk(x) for x in (np.stack([ids, np.ones_like(ids)]), lengths, place, count)]
    row = dict(zip(("ids", "lengths", "places", "counts"), shrunk), codes=codes.tolist(), sizes=sizes.tolist())
    block = hybrid_search.Block(row, int((lengths > 0).sum()), int(lengths.sum()))
    query = [(int(c), 1000 + 10 * int(c)) for c in codes[:30]]
    plain = np.zeros(len(rows), np.int64)
    for term, weight in query:
        where, gain = block.whole(term)
        plain[where] += gain * weight
    order = np.lexsort([ids, -plain])[:10]
    for beat in (0, int(plain[order[-1]]) - 1, int(plain[order[-1]]), int(plain[order[-1]]) + 1, int(plain.max()) + 1):
        places, scores = hybrid_search.best(block, query, 10, beat)
        assert (plain[places] == scores).all()
        top = places[np.lexsort([places, -scores])][:10]
        assert top.tolist() == [i for i in order.tolist() if plain[i] >= max(1, beat)]


def test_search_over_a_whole_table(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    expected = brute.ranks(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert sorted(map(tuple, queries.op13_hybrid_search(spark, sf_dir).collect())) == sorted(expected)
