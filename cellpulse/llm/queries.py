"""Registered queries of the operators; ``ORACLE`` has the DuckDB SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.llm.chat_format import format_conversations, turn_digests
from cellpulse.llm.cover_dedup import drop_repeats
from cellpulse.llm.decontaminate import decontaminate
from cellpulse.llm.fill_middle import fill_middle, restored
from cellpulse.llm.hybrid_search import search
from cellpulse.llm.jump_shards import shard_index
from cellpulse.llm.line_crf import fit_field, quality_column
from cellpulse.llm.lm_interpolation import score_documents
from cellpulse.llm.mixing import label_domain, mix, rate_of
from cellpulse.llm.ngram_join import near_components
from cellpulse.llm.oracle import ORACLE
from cellpulse.llm.order_minhash import fingerprint_documents
from cellpulse.llm.secret_link import STRONG, find_secrets
from cellpulse.llm.wavelet import token_index
from cellpulse.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_interpolation(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), folds=5, held_out=1)


def op2_jump_shards(spark, sf_dir):
    return shard_index(table(spark, sf_dir, "documents"), shards=8)


def op3_cover_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents"), length=13)


def op4_secret_link(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"), reach=200)
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in STRONG),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op5_wavelet(spark, sf_dir):
    return token_index(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"), k=2, bins=32, take=2)


def op7_ngram_join(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"), length=3, percent=90)


#: Share of its expected tokens that each domain keeps.
SHARES = {"good": 1.0, "poor": 0.25, "toxic": 0.1}


def op8_mixing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    members, model, steps = mix(docs, labels, label_domain(), SHARES)
    return members.select(
        "doc_id",
        "n_tokens",
        *(F.get("posteriors", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(model.names)),
        rate_of(F.col("posteriors"), steps).alias("rate"),
    )


def op9_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_line_crf(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    field = fit_field(docs, labels.filter(fold != 2), sample=4000)
    scored = docs.select("doc_id", (fold == 2).alias("held_out"), quality_column(field, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


#: A conversation whose texts hold control strings.
HARD = (-7, r"\### Assistant: </turn> ok")


def op11_template_compiler(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    hard = spark.range(2).select(
        F.lit(HARD[0]).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD[1]).alias("text"),
    )
    rendered = format_conversations(turns.select("conv_id", "turn", "role", "text").union(hard))
    return turn_digests(materialise(rendered, "conversations", compression="zstd"))


def op12_skip_list_fim(spark, sf_dir):
    made = fill_middle(table(spark, sf_dir, "documents"), seed=1)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_hybrid_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


REGISTRY = {
    f.__name__: f
    for f in (
        op1_lm_interpolation,
        op2_jump_shards,
        op3_cover_dedup,
        op4_secret_link,
        op5_wavelet,
        op6_order_minhash,
        op7_ngram_join,
        op8_mixing,
        op9_decontaminate,
        op10_line_crf,
        op11_template_compiler,
        op12_skip_list_fim,
        op13_hybrid_search,
    )
}
