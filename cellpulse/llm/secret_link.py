"""Secret scan with linking of the parts of a credential.

Strong kinds are reported wherever they stand: assignments to a secret's name, access identifiers and
long runs of hex digits. Weak kinds (a login name, a free-standing run that looks like a key, an address)
mean nothing alone. An interval join within each document brings identifiers (access, login) together
with secrets (assign, hex, secret) at most ``reach`` characters apart; weak members of such pairs are
reported, and addresses within reach of either member of a pair.

Only DataFrame functions run. Places of matches come from the texts between them: ``split`` and
``regexp_extract_all`` with one pattern give gaps and matches in turn, and a window adds up their
lengths. One scan of the texts writes what was found; all joins work on that small table. The interval
join meets on (document, bin of ``reach`` characters), so a document with thousands of parts
costs what its close pairs cost.

Edge cases: null and empty texts have no spans; texts of any length are scanned whole, in time linear in their
length whatever they hold; overlapping spans of different kinds are all reported;
repeated rows are scanned each for itself; an empty table gives no rows; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellpulse.session import materialise

# The strong kinds. Their order also breaks ties between spans with one start.
STRONG = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]{16,})",
    "hex": r"([0-9a-f]{24,})",
}
#: Characters that the group of an assignment has at least.
LEAST_ASSIGNED = 6
WEAK = {
    "login": r"(?i:user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]{2,})",
    "secret": r"(?<![A-Za-z0-9+/])((?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,})",
    # A run of scheme characters is taken once, from its beginning; the scheme starts at its first letter.
    "endpoint": r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D\"'<>]+)",
}
KINDS = [*STRONG, *WEAK]
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "secret")


def _worth_reading(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match fulfils; weak kinds also need their partners."""
    assigns = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    access = F.contains(text, F.lit("AKIA"))
    return {
        "assign": assigns,
        "access": access,
        "hex": text.rlike("[0-9a-f]{24}"),
        "login": assigns,
        "secret": access | assigns,
        "endpoint": F.contains(text, F.lit("://")),
    }[kind]


def _parts(kind: str, pattern: str, text: Column) -> Column:
    """Matches of a kind with the lengths of the gaps before them; null if there are none."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    all_of = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), all_of.alias("all"), group.alias("group")),
        lambda r: F.struct(
            F.lit(kind).alias("kind"),
            r["gap"].alias("gap"),
            F.length(r["all"]).alias("size"),
            F.length(r["group"]).alias("group"),
        ),
    )
    return F.when(_worth_reading(kind, text), F.filter(rows, lambda r: r["size"].isNotNull()))


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs of spans of one document at most ``reach`` characters apart, met by bins."""
    bins = lambda s, e: F.sequence((s / reach).cast("long") - 1, (e / reach).cast("long") + 1)
    one = left.select("uid", *(F.col(c).alias(f"a_{c}") for c in ("kind", "start", "end")))
    one = one.withColumn("bin", F.explode(bins(F.col("a_start"), F.col("a_end"))))
    two = right.select("uid", *(F.col(c).alias(f"b_{c}") for c in ("kind", "start", "end")))
    two = two.withColumn("bin", F.explode(F.sequence((F.col("b_start") / reach).cast("long"), (F.col("b_end") / reach).cast("long"))))
    met = one.join(two, ["uid", "bin"]).filter(
        (F.col("a_start") - F.col("b_end") <= reach) & (F.col("b_start") - F.col("a_end") <= reach)
    )
    # A span is no partner of itself or of what lies inside it.
    return met.filter((F.col("a_end") <= F.col("b_start")) | (F.col("b_end") <= F.col("a_start"))).drop("bin").distinct()


def find_secrets(docs: DataFrame, reach: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and ``spans``, an array of (start, rank of the kind, kind, end) in that order."""
    value = F.col(text)
    found = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(doc_id).alias("doc_id"),
        *(_parts(kind, pattern, value).alias(kind) for kind, pattern in (STRONG | WEAK).items()),
    )
    # Written once: the row numbers are then settled and the texts are read only once.
    found = materialise(found, "secrets")
    all_kinds = F.concat(*(F.coalesce(F.col(k), F.array().cast(found.schema[k].dataType)) for k in KINDS))
    parts = found.filter(F.coalesce(*map(F.col, KINDS)).isNotNull()).select("uid", F.posexplode(all_kinds).alias("at", "part"))
    parts = parts.select("uid", "at", "part.*")
    so_far = Window.partitionBy("uid", "kind").orderBy("at")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far)
    # An endpoint is its group; what stands before it in the match are digits and signs of the same run.
    size = F.when(F.col("kind") == "endpoint", F.col("group")).otherwise(F.col("size"))
    spans = parts.withColumn("end", end).withColumn("start", F.col("end") - size)
    spans = spans.filter((F.col("kind") != "assign") | (F.col("group") >= LEAST_ASSIGNED))
    spans = materialise(spans.select("uid", "kind", "start", "end"), "spans")

    pairs = _near(spans.filter(F.col("kind").isin(*IDENTIFIERS)), spans.filter(F.col("kind").isin(*SECRETS)), reach)
    side = lambda s: pairs.select("uid", *(F.col(f"{s}_{c}").alias(c) for c in ("kind", "start", "end")))
    members = side("a").union(side("b")).distinct()
    ends = _near(members, spans.filter("kind = 'endpoint'"), reach)
    linked = members.union(ends.select("uid", F.col("b_kind"), F.col("b_start"), F.col("b_end")))
    weak = linked.filter(F.col("kind").isin(*WEAK)).distinct()
    strong = spans.filter(F.col("kind").isin(*STRONG))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by_doc = (
        strong.union(weak)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    )
    rows = found.select("uid", "doc_id").join(by_doc, "uid", "left")
    none = F.array().cast(by_doc.schema["spans"].dataType)
    return rows.select("doc_id", F.coalesce("spans", none).alias("spans"))
