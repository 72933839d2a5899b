"""Look-ups on stored token files against plain lists."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellpulse.llm import wavelet, wavelet_lookup
from cellpulse.session import scratch_dir


@pytest.fixture(scope="module")
def stored(spark):
    """Files of many small shards, and the tokens that they hold."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta 1", "😀"], k=rng.randint(0, 60)))) for i in range(300)]
    rows[7] = (7, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = scratch_dir(spark, "lookup")
    wavelet.write_shards(docs, folder, path, shard_ids=500)
    coder = Tokenizer.from_file(path)
    tokens = [t for _, text in rows for t in [*coder.encode(text or "", add_special_tokens=False).ids, 0]]
    assert spark.read.parquet(folder).count() > 10
    return folder, tokens


def test_counts(spark, stored):
    folder, tokens = stored
    asked = [*sorted(set(tokens))[:20], 65_535, 0, 0]
    got = {r["token"]: r["n"] for r in wavelet_lookup.count_of(spark, folder, asked).collect()}
    assert got == {t: tokens.count(t) for t in asked}
    with pytest.raises(ValueError, match="65535"):
        wavelet_lookup.count_of(spark, folder, [1 << 16])


def test_occurrences(spark, stored):
    folder, tokens = stored
    asked = [0, max(set(tokens), key=tokens.count), 65_535]
    got = sorted((r["token"], r["place"]) for r in wavelet_lookup.places_of(spark, folder, asked).collect())
    assert got == sorted((t, p) for p, t in enumerate(tokens) if t in asked)


def test_access(spark, stored):
    folder, tokens = stored
    rng = random.Random(1)
    asked = [0, len(tokens) - 1, len(tokens), -1, None, 5, 5, *rng.choices(range(len(tokens)), k=200)]
    places = spark.createDataFrame([(p,) for p in asked], "place long")
    got = sorted((r["place"], r["token"]) for r in wavelet_lookup.tokens_at(spark, folder, places).collect())
    assert got == sorted({(p, tokens[p]) for p in asked if p is not None and 0 <= p < len(tokens)})


def test_no_shards(spark):
    folder = scratch_dir(spark, "none")
    docs = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert wavelet_lookup.count_of(spark, folder, [3]).collect()[0]["n"] == 0
    assert wavelet_lookup.places_of(spark, folder, [3]).count() == 0
    assert wavelet_lookup.tokens_at(spark, folder, spark.createDataFrame([(0,)], "place long")).count() == 0
