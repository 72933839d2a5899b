"""Order MinHash: fingerprints that notice edits and moves, not only which words a text has.

Of every text the k-mers (k words in a row) are numbered by occurrence and put in one random order: by a
hash of the k-mer and its number together. The order's range is cut into ``bins`` equal parts. Of each
part the ``take`` minimal members are selected, put back into their order in the text and hashed as a
tuple; the tuples are the fingerprint. Cutting one order instead of drawing many sorts a text once. The
likeness of two fingerprints is the share of equal tuples among the parts that either text fills.

For the numbers, the k-mers are sorted by a hash of their own first: occurrences of one k-mer then stand
together in text order. First occurrences keep that hash, the few others get one with their number, and
the keys are sorted again.

Only DataFrame functions run. Documents are dealt to ranges of ids cut at quantiles; within a range a
window looks at the next document, and each range gets a copy of the first row of the next one, so no
task sees more than a range.

Edge cases: null counts as empty; a text without words has an empty fingerprint, alike only to another
such (1.0); a single row is its own next document; rows with one id are ordered by their texts' hashes,
then arbitrarily among equals; null ids come first; an empty table gives no rows; further columns are
ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a sorted key that number the k-mer's place; the others are its hash.
PLACE_BITS = 30
RANGE_BYTES = 8 << 20
#: Quantiles that are looked up; further ranges split the space between two of them evenly.
CUTS = 128


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("long")


def _hash_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, PLACE_BITS)


def with_kmers(rows: DataFrame, text: str, name: str, k: int) -> DataFrame:
    """Adds ``name``: the text's k-mers as sorted keys of (hash of k-mer and occurrence number, place)."""
    spaces = " \t\n\x0b\x0c\r"
    trimmed = F.btrim(F.col(text), F.lit(spaces))
    # The split texts get columns of their own, so that functions over them see finished arrays.
    rows = rows.withColumn(name, F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    for step in range(1, k):
        rows = rows.withColumn(
            name, F.zip_with(name, F.slice(name, 2, F.size(name)), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(step))))
        )
    keyed = lambda h, place: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(place)
    rows = rows.withColumn(name, F.sort_array(F.transform(name, lambda h, i: keyed(h, i.cast("long")))))
    again, starts = f"{name}_again", f"{name}_starts"
    follows = lambda keys, key, i: (i > 0) & (_hash_of(F.get(F.col(keys), i - 1)) == _hash_of(key))
    rows = rows.withColumn(again, F.filter(name, lambda key, i: follows(name, key, i)))
    # Where in them each k-mer's further occurrences start, and the end; a slice of them gives their numbers.
    begin = F.transform(again, lambda key, i: F.when(~follows(again, key, i), i))
    rows = rows.withColumn(starts, F.array_append(F.array_compact(begin), F.size(again)))

    def numbered(start, j):
        run = F.slice(again, start + 1, F.get(F.col(starts), j + 1) - start)
        return F.transform(run, lambda key, n: keyed(F.xxhash64(_hash_of(key), n), key.bitwiseAND(_mask(PLACE_BITS))))

    runs = F.flatten(F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), numbered))
    first = F.filter(name, lambda key, i: ~follows(name, key, i))
    both = F.when(F.size(again) == 0, F.col(name)).otherwise(F.sort_array(F.concat(first, runs)))
    rows = rows.withColumn(name, both).drop(again, starts)
    return rows.withColumn(name, F.when(trimmed == "", F.array().cast("array<long>")).otherwise(F.col(name)))


def with_sketch(rows: DataFrame, keys: str, name: str, bins: int, take: int) -> DataFrame:
    """Adds ``name``: for every bin that has k-mers its number and, in the lower 32 bits, its tuple's hash."""
    bits = (bins - 1).bit_length()
    if 1 << bits != bins:
        raise ValueError("the number of bins must be a power of two")
    part = lambda key: F.shiftrightunsigned(key, 63 - bits)
    first = F.filter(keys, lambda key, i: (i < take) | (part(F.get(F.col(keys), i - take)) != part(key)))
    rows = rows.withColumn(name, first)
    chosen = F.col(name)

    def tuple_hash(members):
        """Hash of the members of one bin, which come in order, put into text order."""
        placed = F.transform(
            members,
            lambda key: F.struct(key.bitwiseAND(_mask(PLACE_BITS)).alias("place"), _hash_of(key).alias("hash")),
        )
        return F.xxhash64(F.transform(F.array_sort(placed), lambda m: m["hash"]))

    def entry(key, i):
        # The members are bound to a variable, so that they are picked once.
        members = F.array(F.filter(F.slice(chosen, i + 1, F.lit(take)), lambda o: part(o) == part(key)))
        value = F.get(F.transform(members, tuple_hash), F.lit(0)).bitwiseAND(_mask(32))
        return F.when((i == 0) | (part(F.get(chosen, i - 1)) != part(key)), F.shiftleft(part(key), 32).bitwiseOR(value))

    return rows.withColumn(name, F.array_compact(F.transform(chosen, entry)))


def as_text(sketch) -> Column:
    """The fingerprint: ten hex digits for every filled bin, its number and its tuple's hash."""
    return F.array_join(F.transform(sketch, lambda t: F.lpad(F.lower(F.hex(t)), 10, "0")), "")


def likeness(one, two) -> Column:
    """Share of equal tuples among the bins that either sketch fills; 1 if none does."""
    number = lambda sketch: F.transform(sketch, lambda t: F.shiftright(t, 32))
    either = F.size(F.array_union(number(one), number(two)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, two)) / either)


def by_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``range``: consecutive numbers of ranges of a whole-number key, of about ``RANGE_BYTES`` each."""
    known = docs.agg(F.sum(F.octet_length(text)), F.min(key), F.max(key)).first()
    size, low, high = known[0] or 0, known[1], known[2]
    wanted = size // RANGE_BYTES + 1
    if low is None or wanted == 1:
        return docs.withColumn("range", F.lit(0).cast("long"))
    shares = [k / CUTS for k in range(1, CUTS)]
    cuts = sorted({low, high + 1, *docs.approxQuantile(key, shares, 1 / (4 * CUTS))})
    cuts = [int(c) for c in cuts]
    each = -(-wanted // max(1, len(cuts) - 1))
    table = F.array(*(F.lit(c).cast("long") for c in cuts))
    at = F.size(F.filter(table, lambda c: c <= F.col(key))) - 1
    width = F.get(table, F.col("_at") + 1) - F.get(table, F.col("_at"))
    inner = F.floor((F.col(key) - F.get(table, F.col("_at"))) / width * each)
    return (
        docs.withColumn("_at", F.when(F.col(key).isNotNull(), at))
        .withColumn("range", F.coalesce(F.col("_at") * each + F.least(inner, F.lit(each - 1)) + 1, F.lit(0)).cast("long"))
        .drop("_at")
    )


def fingerprint_documents(
    docs: DataFrame, k: int = 2, bins: int = 32, take: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; see the query's columns.

    The edited text has its last quarter replaced by the start of the next document.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("_hash"),
        F.lit(False).alias("_copy"),
    )
    rows = by_ranges(rows, "doc_id", "text")
    # The first id of each range (as many rows as ranges), and the range before it; the first follows the last.
    order = Window.orderBy("range")
    firsts = rows.groupBy("range").agg(F.min("doc_id").alias("_first"))
    firsts = firsts.withColumn("_before", F.lag("range").over(order))
    last = F.max("range").over(Window.partitionBy())
    firsts = firsts.select("range", "_first", F.coalesce("_before", last).alias("_before"))
    heads = rows.alias("r").join(
        F.broadcast(firsts).alias("f"),
        (F.col("r.range") == F.col("f.range")) & F.col("r.doc_id").eqNullSafe(F.col("f._first")),
    )
    heads = heads.groupBy("_before").agg(F.min(F.struct("r._hash", "r.text")).alias("head"))
    heads = heads.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("head.text").alias("text"),
        F.col("head._hash").alias("_hash"),
        F.lit(True).alias("_copy"),
        F.col("_before").alias("range"),
    )
    both = rows.unionByName(heads)
    both = with_sketch(with_kmers(both, "text", "_kmers", k), "_kmers", "_sketch", bins, take).drop("_kmers")
    next_row = Window.partitionBy("range").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "_hash")
    both = both.withColumn("_next", F.lead(F.struct("text", "_sketch")).over(next_row)).filter(~F.col("_copy"))
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    both = both.withColumn(
        "_edited", F.concat(F.substring("text", F.lit(1), n - moved), F.substring("_next.text", F.lit(1), moved))
    )
    both = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"),
        "_edited",
        "_sketch",
        F.col("_next._sketch").alias("_next_sketch"),
    )
    both = with_sketch(with_kmers(both, "_edited", "_kmers", k), "_kmers", "_edited_sketch", bins, take)
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("_sketch").alias("fingerprint"),
        as_text("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"),
        likeness("_sketch", "_next_sketch").alias("near_next"),
    )
