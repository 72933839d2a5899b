"""Mixing to target weights with soft membership: a rate for every document.

A classifier learned from labelled documents gives each document a probability for every domain. Then
document rates x >= 0 are fitted so that the expected tokens of each domain, the sum over documents of
rate * tokens * probability, meet the domain's target. Of all such rates those near 1 are sought.

Classifier: naive Bayes on the presence and absence of features (hashed words, word ends, words repeated at once).
It counts documents per feature and domain on at most ``sample`` labelled documents and keeps those
features whose share in some domain differs clearly from the rest, so the many rare words add no noise.

Fit: projected gradient descent on the least squares of the domain totals. Steps are preconditioned with
the small matrix of domain overlaps, so a few suffice. Every iteration is one distributed sum of as many
numbers as domains. A document's rate is a function of its probabilities and the residuals so far, so no
column of rates is ever stored or shuffled.

Only DataFrame functions run; the driver sees the kept features (at most ``most``) and sums.

Edge cases: null and empty texts have no tokens and the prior as probabilities; labels that are null or
of unknown documents teach nothing; without labels all domains are equally likely; a domain that no
document can belong to keeps its target unmet and does no harm; repeated rows count each; an empty table
gives no rows; further columns are kept by ``with_rates``, those named like its results are replaced.
"""

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.session import materialise

#: Kept features at most, unless the caller sets another bound; slots at first of the table that finds them by
#: hash, fewer if there are that many times fewer features.
FEATURES, SLOTS, ROOM = 1 << 13, 1 << 16, 4


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``_n_tokens`` and ``_features``, the distinct hashes of a text's features."""
    # What later steps use twice gets a column of its own, so that it is worked out once.
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+")
    docs = docs.withColumn("_words", F.array_remove(words, ""))  # white space at either end leaves an empty one
    docs = docs.withColumn("_n_tokens", F.size("_words").cast("long"))
    docs = docs.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_features", F.transform("_words", lambda w: F.xxhash64(F.lit("end"), F.right(w, F.lit(2)))))
    again, none = F.lit(1).cast("long"), F.array().cast("array<long>")  # ``again``: some word is repeated by the next
    repeated = F.size(F.filter("_hashes", lambda h, i: h == F.get("_hashes", i + 1)))
    mostly = lambda n: F.when(n * 4 > F.col("_n_tokens"), F.array(again, again + 1)).when(n > 0, F.array(again)).otherwise(none)
    repeats = F.get(F.transform(F.array(repeated), mostly), F.lit(0))
    distinct = F.concat(F.array_distinct("_hashes"), F.array_distinct("_features"), repeats)
    return docs.withColumn("_features", distinct).drop("_words", "_hashes")


class Domains:
    """Posterior of every domain as a column, from prior log-odds and the kept features' shares.

    A feature counts whether it is there or not; in texts with fewer tokens than ``typical``, its absence
    counts in proportion.
    """

    def __init__(self, names: list[str], prior: np.ndarray, features: list[int], shares: np.ndarray, typical: float):
        self.names, self.prior, self.typical = names, prior, max(1.0, typical)
        self.absent = np.zeros(len(names))
        # Each feature has two slots to choose from (cuckoo hashing), so none is left out.
        # Every task reads the table, so it is no larger than it must be.
        size = SLOTS
        while size >= 2 * ROOM * max(1, len(features)):
            size //= 2
        while (taken := self._placed(features, size)) is None:
            size *= 2
        self.slots, self.table = np.zeros(size, np.int64), np.zeros((len(names), size))
        share = dict(zip(features, shares, strict=True))
        for slot, feature in taken.items():
            self.slots[slot] = feature
            self.table[:, slot] = np.log(share[feature]) - np.log1p(-share[feature])
            self.absent += np.log1p(-share[feature])

    @staticmethod
    def _placed(features: list[int], size: int) -> dict[int, int] | None:
        """Slot to feature, or None if the table is too small."""
        taken: dict[int, int] = {}
        for feature in dict.fromkeys(features):
            slot = feature % size
            for _ in range(100):
                out = taken.get(slot)
                taken[slot], feature = feature, out
                if feature is None:
                    break
                one, two = feature % size, (feature % 2**64 >> 32) % size
                slot = two if slot == one else one
            else:
                return None
        return taken

    @staticmethod
    def _array(values: np.ndarray, kind: str) -> Column:
        """One literal of many numbers; it travels as text, which the optimiser turns into numbers once."""
        return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast(f"array<{kind}>")

    def posteriors(self) -> Column:
        """Array of the domains' probabilities."""
        # The number of slots is a power of two, so the low bits are the remainder.
        slots, low = self._array(self.slots, "long"), F.lit(len(self.slots) - 1).cast("long")
        one = lambda f: f.bitwiseAND(low).cast("int")
        two = lambda f: F.shiftrightunsigned(f, 32).bitwiseAND(low).cast("int")
        found = lambda f, slot: F.get(slots, slot(f)) == f
        # Two look-ups, so that features are used twice and stay a column of their own: below a function with
        # a lambda nothing is compiled, and dropping repeats there is slow. No feature is found twice.
        first = F.transform(F.filter("_features", lambda f: found(f, one)), one)
        second = F.transform(F.filter("_features", lambda f: found(f, two) & ~found(f, one)), two)
        known = F.concat(first, second)
        reach = F.least(F.lit(1.0), F.col("_n_tokens") / self.typical)

        # A sum of plain numbers for each domain: one sum of arrays would build an array for every feature.
        def total(k: int, at: Column) -> Column:
            table, start = self._array(self.table[k], "double"), F.lit(float(self.prior[k])) + reach * float(self.absent[k])
            return F.aggregate(at, start, lambda t, slot: t + F.get(table, slot))

        # In steps of their own, so that each is worked out once.
        odds = F.transform(F.array(known), lambda at: F.array(*(total(k, at) for k in range(len(self.names)))))
        shifted = F.transform(odds, lambda o: F.transform(o, lambda v: F.exp(v - F.array_max(o))))
        return F.get(
            F.transform(shifted, lambda o: F.transform(o, lambda v: v / F.aggregate(o, F.lit(0.0), lambda t, w: t + w))), F.lit(0)
        )


def learn_domains(
    docs: DataFrame, labels: DataFrame, domain: Column, names: list[str], sample: int = 20_000, doc_id: str = "doc_id",
    text: str = "text", clear: float = 4.0, most: int = FEATURES,
) -> Domains:
    """Learns from at most ``sample`` labels, those whose ids hash lowest. ``domain``: a name from the labels' columns.

    A feature is kept if its share of some domain's documents lies ``clear`` standard errors from its share
    of the others and is at least twice or at most half as large; the ``most`` clearest, as they go to the driver.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), domain.alias("_domain"))
        .filter(F.col("_id").isNotNull() & F.col("_domain").isin(*names))
        .orderBy(F.xxhash64("_id"), "_id", "_domain")
        .limit(sample)
    )
    # At most ``sample`` rows of an id and a name.
    taught = docs.select(F.col(doc_id), F.col(text)).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))
    number = [F.sum((F.col("_domain") == n).cast("long")).alias(f"n{k}") for k, n in enumerate(names)]
    # Written once (``sample`` rows at most): a filter on exploded features would else be pushed below the join.
    taught = with_features(taught, text).select("_domain", "_n_tokens", "_features")
    taught = materialise(taught, "taught")
    sums = taught.agg(*number, F.avg("_n_tokens")).first()
    documents, typical = np.array([v or 0 for v in sums[:-1]], float), sums[-1] or 0.0
    # A domain that no label shows has no members, unless no label shows any.
    prior = np.log((documents + 1) / (documents.sum() + len(names)))
    if documents.any():
        prior = np.where(documents > 0, prior, -1e4)
    seen = taught.select("_domain", F.explode("_features").alias("feature")).groupBy("feature").agg(*number)
    everywhere = sum(F.col(f"n{k}") for k in range(len(names)))
    clearness = []
    for k, mine in enumerate(documents):
        others = documents.sum() - mine
        if mine and others:
            a, b = (F.col(f"n{k}") + 0.5) / (mine + 1), (everywhere - F.col(f"n{k}") + 0.5) / (others + 1)
            error = F.sqrt(a * (1 - a) / (mine + 1) + b * (1 - b) / (others + 1)) + 1e-9
            clearness.append(F.when(F.greatest(a / b, b / a) >= 2, F.abs(a - b) / error).otherwise(0.0))
    if not clearness:
        return Domains(names, prior, [], np.zeros((0, len(names))), typical)
    kept = seen.withColumn("clear", F.greatest(*clearness) if len(clearness) > 1 else clearness[0]).filter(F.col("clear") > clear)
    rows = kept.orderBy(F.desc("clear"), "feature").limit(most).collect()
    counts = np.array([[r[f"n{k}"] for k in range(len(names))] for r in rows], float).reshape(-1, len(names))
    # Shares lean towards the common share by as much as two documents say; absent domains have none of their own.
    common = (counts.sum(1, keepdims=True) + 0.5) / (documents.sum() + 1)
    share = (counts + 2 * common) / (documents + 2)
    return Domains(names, prior, [r["feature"] for r in rows], share, typical)


def rate_of(posteriors: Column, steps: list[list[float]]) -> Column:
    """The rate after the given steps, starting from 1 and never below 0."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    move = lambda s: F.aggregate(F.zip_with(s, posteriors, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    table = F.array(*(F.array(*map(F.lit, map(float, s))) for s in steps))
    return F.aggregate(table, rate, lambda x, s: F.greatest(F.lit(0.0), x - move(s)))


def fit_rates(
    members: DataFrame, targets, n_tokens: str = "n_tokens", posteriors: str = "posteriors", rounds: int = 30, close: float = 1e-6
) -> list[list[float]]:
    """Steps of projected gradient descent towards the targets (tokens per domain).

    Goes on until the totals are close, or until ``rounds`` rounds have not halved the miss; then a warning
    gives what each domain's total misses.
    """
    count = len(targets)
    p = [F.get(F.col(posteriors), F.lit(k)) for k in range(count)]
    overlap = [F.sum(F.col(n_tokens) * p[k] * p[j]).alias(f"o{k}_{j}") for k in range(count) for j in range(count)]
    sums = members.agg(*overlap).first()
    matrix = np.array([v or 0.0 for v in sums], float).reshape(count, count)
    scale = np.linalg.pinv(matrix, rcond=1e-9, hermitian=True)
    steps: list[list[float]] = []
    best, since = math.inf, 0
    while True:
        rate = rate_of(F.col(posteriors), steps)
        now = members.select(n_tokens, posteriors, rate.alias("_rate")).agg(
            *(F.sum(F.col(n_tokens) * F.col("_rate") * p[k]) for k in range(count))
        ).first()
        miss = np.array([v or 0.0 for v in now], float) - np.array(targets, float)
        if np.abs(miss).max() <= close * max(1.0, float(np.abs(targets).max())):
            return steps
        if np.abs(miss).max() <= best / 2:
            best, since = np.abs(miss).max(), 0
        elif since >= rounds:
            warnings.warn(f"totals miss their targets by {miss.tolist()} tokens", stacklevel=2)
            return steps
        since += 1
        steps.append((scale @ miss).tolist())


def expected_tokens(members: DataFrame, count: int) -> list[float]:
    """Expected tokens per domain at rate 1."""
    sums = [F.sum(F.col("n_tokens") * F.get(F.col("posteriors"), F.lit(k))) for k in range(count)]
    return [v or 0.0 for v in members.agg(*sums).first()]


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, shares: dict[str, float], doc_id: str = "doc_id", text: str = "text",
    sample: int = 20_000, most: int = FEATURES,
) -> tuple[DataFrame, Domains, list[list[float]]]:
    """Fits rates so that each domain keeps the given share of its expected tokens.

    ``most``: features kept at most. Returns the members (doc_id, n_tokens, posteriors; a written table), the classifier and the steps.
    """
    names = _checked(shares)
    model = learn_domains(docs, labels, domain, names, sample, doc_id, text, most=most)
    members = with_features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
    members = members.select("doc_id", F.col("_n_tokens").alias("n_tokens"), model.posteriors().alias("posteriors"))
    members = materialise(members, "members")
    return members, model, _fitted(members, names, shares)


def _checked(shares: dict[str, float]) -> list[str]:
    if any(not math.isfinite(s) or s < 0 for s in shares.values()):
        raise ValueError("shares must be finite and not negative")
    return list(shares)


def _fitted(members: DataFrame, names: list[str], shares: dict[str, float]) -> list[list[float]]:
    targets = [shares[n] * t for n, t in zip(names, expected_tokens(members, len(names)), strict=True)]
    return fit_rates(members, np.array(targets))


def with_rates(docs: DataFrame, model: Domains, steps: list[list[float]], text: str = "text", name: str = "rate") -> DataFrame:
    """The documents with their rates, computed row by row from the text."""
    rows = with_features(docs, text).withColumn("_posteriors", model.posteriors())
    return rows.withColumn(name, rate_of(F.col("_posteriors"), steps)).drop("_features", "_n_tokens", "_posteriors")


def whole_members(docs: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """doc (all columns of a document), n_tokens, posteriors; a written table, so features are derived once."""
    rows = with_features(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("_text")), "_text")
    rows = rows.select("doc", F.col("_n_tokens").alias("n_tokens"), model.posteriors().alias("posteriors"))
    return materialise(rows, "members", compression="zstd")


def deal(members: DataFrame, steps: list[list[float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``whole_members`` that stand for the rates, with their columns.

    A document stays if a hash of its id and text, as a number in [0, 1), lies below its rate. So a rate
    under 1 is the chance that it stays and a domain keeps its total in expectation; one of 1 or more keeps
    the document once.
    """
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("dealt"), F.col("doc")[doc_id], F.col("doc")[text]), 11) / float(1 << 53)
    return members.filter(chance < rate_of(F.col("posteriors"), steps)).select("doc.*")


def dealt(docs: DataFrame, model: Domains, steps: list[list[float]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``deal`` for a model and steps that are known."""
    return deal(whole_members(docs, model, text), steps, doc_id, text)


def mixed_rows(
    docs: DataFrame, labels: DataFrame, domain: Column, shares: dict[str, float], doc_id: str = "doc_id", text: str = "text",
    sample: int = 20_000, most: int = FEATURES,
) -> DataFrame:
    """``mix`` and ``deal`` in one: the documents that are kept so that each domain keeps its share."""
    names = _checked(shares)
    model = learn_domains(docs, labels, domain, names, sample, doc_id, text, most=most)
    members = whole_members(docs, model, text)
    return deal(members, _fitted(members, names, shares), doc_id, text)


def label_domain() -> Column:
    """Domain from the labelled table's marks, the worse first; null where neither says anything."""
    return (
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    )
