"""What the methods promise beyond their results on one table."""

import os
import re
import sys

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from cellpulse.llm import cover_dedup, jump_shards, line_crf, lm_interpolation, mixing, order_minhash, queries, wavelet  # noqa: E402
from cellpulse.llm import words as W  # noqa: E402


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 200))
def test_jump_matches_the_published_loop(keys, shards):
    assert jump_shards.jump(np.array(keys, np.uint64), shards).tolist() == [brute.jump(k, shards) for k in keys]


def test_jump_moves_only_into_new_shards():
    keys = np.random.default_rng(0).integers(0, 2**63, 20_000)
    for shards in (1, 7, 64):
        before, after = jump_shards.jump(keys, shards), jump_shards.jump(keys, shards + 1)
        moved = before != after
        assert (after[moved] == shards).all()
        assert moved.mean() == pytest.approx(1 / (shards + 1), abs=0.02)


def test_cover_meets_every_distance():
    for distance in range(cover_dedup.PERIOD):
        assert any((c + distance) % cover_dedup.PERIOD in cover_dedup.COVER for c in cover_dedup.COVER)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabé日'1.", max_size=30)), max_size=6))
def test_words_match_a_regular_expression(texts):
    data, at = W.flat(pa.array(texts, pa.string()))
    start, end, text = W.find_words(data, at, W.separators(W.SPACES))
    raw = data.tobytes()
    found = [(int(t), raw[s:e].decode()) for s, e, t in zip(start, end, text, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
    hashes = W.hash_pieces(data, start, end, W.hash_table())
    assert len(set(hashes.tolist())) == len({w for _, w in found})


def test_hash_of_a_word_does_not_depend_on_its_neighbours():
    table, ends = W.hash_table(), W.separators(W.SPACES)

    def hashes(text):
        data, at = W.flat(pa.array([text]))
        start, end, _ = W.find_words(data, at, ends)
        return W.hash_pieces(data, start, end, table).tolist()

    assert hashes(f"short {'x' * 1000}")[0] == hashes("short")[0]
    assert len({*hashes(" ".join("ab" * n for n in range(1, 200)))}) == 199


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=400), st.data())
def test_wavelet_matrix(ids, data):
    built = wavelet.WaveletMatrix.build(np.array(ids, np.uint16))
    read = wavelet.WaveletMatrix.from_bytes(built.to_bytes())
    assert read.ids().tolist() == ids
    place = data.draw(st.integers(0, len(ids) - 1))
    token = ids[place]
    assert read.access(place) == token
    assert read.count(token) == ids.count(token)
    assert read.rank(token, place) == ids[:place].count(token)
    assert read.select(token, ids[:place].count(token)) == place
    with pytest.raises(IndexError):
        read.select(token, ids.count(token))


def test_wavelet_matrix_over_several_blocks():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * wavelet.BLOCK + 17).astype(np.uint16) % 700
    read = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (read.ids() == ids).all()
    for place in (0, wavelet.BLOCK - 1, wavelet.BLOCK, len(ids) - 1):
        token = int(ids[place])
        before = int((ids[:place] == token).sum())
        assert (read.access(place), read.rank(token, place), read.select(token, before)) == (token, before, place)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=" \n  ab'sé!1<|>", max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_tokenizers_ids(texts):
    coder = wavelet.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, counts = coder.encode(pa.array(texts))
    whole = [[*e.ids, 0] for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(whole, [])
    assert counts.tolist() == [len(w) for w in whole]


def test_weights_follow_the_evidence():
    side = lm_interpolation.SIDE
    cell = lambda b, two, one: (b * side + two) * side + one
    middle = 1 + lm_interpolation.STEPS * lm_interpolation.RANGE // 2
    high = middle + 8 * lm_interpolation.STEPS
    cells = np.array([cell(5, high, middle), cell(5, 0, middle), cell(1, 0, high)])
    weights = lm_interpolation.fit_weights(cells, np.array([900.0, 100.0, 50.0]))
    assert weights.sum(0) == pytest.approx(1)
    assert weights[0, 5] > 0.8 and weights[0, 1] < 0.01 and weights[0, 0] == 0
    assert (weights[:, 9] == weights[:, 5]).all()


def test_held_out_rows_teach_nothing(spark):
    """Counts, and so all scores, are the same with and without the held-out rows."""
    train = [(i, "a b a c b a") for i in range(200) if brute.crc(i) % 5 != 1]
    held = [(i, "c c zzz") for i in range(200) if brute.crc(i) % 5 == 1]
    score = lambda rows: {
        r["doc_id"]: r for r in lm_interpolation.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    alone, both = score(train), score(train + held)
    assert all(both[d]["score"] == pytest.approx(r["score"]) for d, r in alone.items())
    assert all(both[d]["n_known"] == 3 and both[d]["held_out"] for d, _ in held)


def test_held_out_scores_beat_the_base(spark, sf_dir):
    rows = queries.op1_lm_interpolation(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_field_learns_from_neighbours():
    """A neutral line between bad ones is bad, between good ones good."""
    rng = np.random.default_rng(0)
    rows, label, chain = [], [], []
    for c in range(300):
        y = c % 2
        for place in range(3):
            row = np.zeros(line_crf.FEATURES)
            row[0] = 0 if place == 1 else (2 * y - 1) + rng.normal(0, 0.3)
            row[-1] = 1
            rows.append(row)
            label.append(y)
            chain.append(c)
    field = line_crf.Field().fit(np.array(rows), np.array(label, float), np.array(chain))
    before, after = field.chains(field.states(np.array(rows[:6])), np.array(chain[:6]))
    assert before[1] + after[1] < -1 and before[4] + after[4] > 1


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    field = line_crf.Field(pairs=rng.normal(size=(2, 2)))
    sizes = [1, 4, 2]
    score, chain = rng.normal(size=7), np.repeat([0, 1, 2], sizes)
    before, after = field.chains(score, chain)
    lo = 0
    for n in sizes:
        odds = np.zeros((n, 2))
        for states in np.ndindex(*[2] * n):
            value = sum(score[lo + i] * s for i, s in enumerate(states))
            value += sum(field.pairs[a, b] for a, b in zip(states, states[1:], strict=False))
            for i, s in enumerate(states):
                odds[i, s] += np.exp(value)
        assert np.log(odds[:, 1] / odds[:, 0]) == pytest.approx((before + after)[lo : lo + n])
        lo += n


def test_quality_on_held_out_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = queries.op10_line_crf(spark, sf_dir).filter("held_out").join(labels, "doc_id")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    kept = scored.filter("quality = 1").agg(F.avg(F.col("predicted").cast("double"))).first()[0]
    assert right > 0.95 and kept > 0.97


def test_rates_meet_reachable_targets(spark):
    rows = [(100, [0.9, 0.1]), (50, [0.2, 0.8]), (400, [0.5, 0.5]), (0, [1.0, 0.0])]
    members = spark.createDataFrame(rows, "n_tokens long, posteriors array<double>")
    targets = np.array([250.0, 90.0])
    steps = mixing.fit_rates(members, targets)
    rates = [r[0] for r in members.select(mixing.rate_of(F.col("posteriors"), steps)).collect()]
    met = np.array([[n * r * p for p in ps] for (n, ps), r in zip(rows, rates, strict=True)]).sum(0)
    assert met == pytest.approx(targets, rel=1e-4) and min(rates) >= 0


def test_mixing_query_meets_its_shares(spark, sf_dir):
    rows = queries.op8_mixing(spark, sf_dir)
    for name, share in queries.SHARES.items():
        part = F.col("n_tokens") * F.col(f"p_{name}")
        whole, kept = rows.agg(F.sum(part), F.sum(part * F.col("rate"))).first()
        assert kept == pytest.approx(share * whole, rel=0.05)


def plain_sketch(spark, texts, bins=32, take=2):
    """Tuples of every text by part, from (word pair, occurrence number) hashed one by one."""
    rows = []
    for t, text in enumerate(texts):
        ws, seen = brute.words(text), {}
        for place, pair in enumerate(zip(ws, [*ws[1:], None], strict=True)):
            seen[pair] = seen.get(pair, -1) + 1
            rows.append((t, place, *pair, seen[pair]))
    last = F.xxhash64(F.xxhash64("a"), F.lit(1).cast("long"))
    kmer = F.when(F.col("b").isNull(), last).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    key = F.shiftrightunsigned(kmer, 31)
    key = F.when(F.col("n") > 0, F.shiftrightunsigned(F.xxhash64(key, F.col("n") - 1), 31)).otherwise(key)
    frame = spark.createDataFrame(rows, "t int, place int, a string, b string, n int").select("t", "place", key.alias("key"))
    parts = [{} for _ in texts]
    for r in sorted(frame.collect(), key=lambda r: (r["key"], r["place"])):
        members = parts[r["t"]].setdefault(r["key"] * bins >> 33, [])
        if len(members) < take:
            members.append((r["place"], r["key"]))
    return [{b: tuple(k for _, k in sorted(m)) for b, m in p.items()} for p in parts]


def test_repeated_lines_count_in_fingerprints(spark):
    line = "the same line over and over again with little else"
    other = "another line that stands between the repeated ones"
    texts = [" ".join([line] * n) for n in (1, 3, 300, 301)]
    texts += [" ".join([line] * 40 + [other] * 40), " ".join([other] * 40 + [line] * 40), "a a a a b a a", "a", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    rows = order_minhash.with_sketch(order_minhash.with_kmers(docs, "text", "keys", 2), "keys", "sketch", 32, 2)
    got = {r["t"]: {s >> 32: s for s in r["sketch"]} for r in rows.select("t", "sketch").collect()}
    plain = plain_sketch(spark, texts)
    for a in range(len(texts)):
        assert got[a].keys() == plain[a].keys()
        for b in range(len(texts)):
            shared = got[a].keys() & got[b].keys()
            assert [got[a][p] == got[b][p] for p in shared] == [plain[a][p] == plain[b][p] for p in shared]
    assert got[1] != got[2] and got[4] != got[5]


def test_dealt_documents_meet_the_shares_of_every_domain(spark):
    """Kept expected tokens of the pipeline's stage, by the same model, against its targets."""
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    shares = corpus_pipeline.SHARES
    members, model, steps = mixing.mix(docs, labels, mixing.label_domain(), shares)
    kept = corpus_pipeline.mixing(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    totals = mixing.expected_tokens(members, len(shares))
    left = mixing.expected_tokens(members.join(kept.select("doc_id"), "doc_id", "left_semi"), len(shares))
    print({n: (t, k, k / t) for n, t, k in zip(shares, totals, left, strict=True)})
    for name, total, part in zip(shares, totals, left, strict=True):
        assert part == pytest.approx(shares[name] * total, rel=0.15), name


def test_features_that_fall_on_one_slot_all_count(spark):
    features = [5 + k * mixing.SLOTS for k in range(2)] + [-7, -7 - mixing.SLOTS] + [9 + (k << 40) for k in range(3)]
    shares = np.array([[0.5 + 0.05 * k, 0.1] for k in range(len(features))])
    model = mixing.Domains(["a", "b"], np.log([0.5, 0.5]), features, shares, 1.0)
    rows = spark.createDataFrame([([f], 1) for f in features], "_features array<long>, _n_tokens long")
    got = [r[0] for r in rows.select(model.posteriors()).collect()]
    for k, p in enumerate(got):
        chance = np.where(np.arange(len(features))[:, None] == k, shares, 1 - shares).prod(0)
        assert p == pytest.approx((chance / chance.sum()).tolist())


def test_mixing_reads_small_tables_and_compiles_the_dropping_of_repeats(spark):
    model = mixing.Domains(["a", "b"], np.log([0.5, 0.5]), [1, 2, 3], np.full((3, 2), 0.5), 1.0)
    assert len(model.slots) <= 64
    docs = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    plan = mixing.with_features(docs, "text").select("doc_id", model.posteriors().alias("p"))
    plan = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    distinct = [line for line in plan if "array_distinct(" in line]
    # Below the look-ups it would run one value at a time, without compiled code.
    assert len(distinct) == 1 and "filter(_features" not in distinct[0]


def test_mixing_features_are_words_ends_and_repeats(spark):
    texts = [None, "", " \t\n", "Ab", " ab\x0bAB ab\r\nxyzab ", "a a a", "a a b c d e", "a\xa0b \x1cc", "\u00c4\u00dc \u00e4\u00fc\U0001f600 \u0130x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = mixing.with_features(docs, "text").select("doc_id", "_n_tokens", F.sort_array("_features").alias("f")).orderBy("doc_id").collect()
    lowered = [r[0] for r in docs.orderBy("doc_id").select(F.lower(F.coalesce("text", F.lit("")))).collect()]
    words = [[w for w in re.split(r"[ \t-\r]+", t) if w] for t in lowered]
    pieces = {(w,) for ws in words for w in ws} | {("end", w[-2:]) for ws in words for w in ws}
    hashed = {p: spark.range(1).select(F.xxhash64(*map(F.lit, p))).first()[0] for p in pieces}
    for ws, row in zip(words, rows, strict=True):
        repeated = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
        wanted = {hashed[(w,)] for w in ws} | {hashed[("end", w[-2:])] for w in ws}
        wanted |= ({1} if repeated else set()) | ({2} if 4 * repeated > len(ws) else set())
        assert (row["_n_tokens"], row["f"]) == (len(ws), sorted(wanted))


def test_rates_that_cannot_meet_their_targets_say_so(spark):
    members = spark.createDataFrame([(100, [1.0, 0.0])], "n_tokens long, posteriors array<double>")
    with pytest.warns(UserWarning, match="miss"):
        mixing.fit_rates(members, np.array([50.0, 10.0]), rounds=3)


def test_dealt_documents_keep_columns_of_any_name(spark):
    names = ["_features", "_n_tokens", "_plain", "_words", "_hashes", "_posteriors", "_text", "_rate", "doc", "rate", "posteriors"]
    docs = spark.createDataFrame([(i, f"word{i % 3} and more") for i in range(40)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", *[F.lit(k).alias(name) for k, name in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = mixing.mixed_rows(docs, labels, mixing.label_domain(), {"good": 1.0, "poor": 1.0})
    assert kept.columns == docs.columns and kept.count() <= 40
    assert kept.exceptAll(docs).isEmpty()
