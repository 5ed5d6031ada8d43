"""The registered queries of this folder, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .base import held_out, table
from .dartminhash import near_duplicates
from .decontaminate import contamination
from .htmltext import extract_pages
from .mixing import mix_plan
from .periodic import find_runs, words_of
from .pieces import recode
from .projections import near_vectors
from .quality import fit_quality, quality
from .repair import Repair
from .secrets import BlobLedger, scan_documents
from .tokenids import read_token_files, write_token_files
from .toxicity import fit_toxicity, toxicity
from .warc import read_archives, write_archives


def model_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, their checksum, and whether decoding gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = docs.select("doc_id", "text", recode(F.col("text"), model_path("piece_bpe_32k.model")).alias("r"))
    return both.select(
        "doc_id", "r.ids", F.size("r.ids").cast("long").alias("n_ids"), "r.ids_crc32",
        (F.col("r.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op2_projections(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(table(spark, folder, "documents").select("doc_id", "text"), BlobLedger(spark))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id")))
    return docs.select("doc_id", quality(F.col("text"), model).alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contamination(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text_key")


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    got = extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, model_path("word_bpe_49k.json"), end_id=1))


def op8_dartminhash(spark: SparkSession, folder: str) -> DataFrame:
    got = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return got.select("doc_id", "class_id", "kept", "n_texts")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id")))
    return docs.select("doc_id", toxicity(F.col("text"), model).alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    got = read_archives(write_archives(table(spark, folder, "pages").select("page_id", "url", "html")))
    return got.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def with_planted_repeats(words, doc_id):
    """In one of ten documents, by the checksum of the id, the words from some place on repeat a first few of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("long"), F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    planted = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(words)


def op11_periodic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", words_of(F.col("text")).alias("words"))
    found = docs.select("doc_id", find_runs(with_planted_repeats(F.col("words"), F.col("doc_id"))).alias("r"))
    runs, smallest = F.col("r.runs"), F.array_sort(
        F.transform("r.runs", lambda r: F.struct((-r.length).alias("longest"), r.start.alias("start"), r.period.alias("period")))
    )
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    best = F.get(F.col("sorted"), F.lit(0))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), smallest.alias("sorted"), lines.alias("lines"), "r.collapsed"
    ).select(
        "doc_id", "n_runs", best.start.alias("start"), (-best.longest).alias("length"), best.period.alias("period"),
        F.floor(-best.longest * 1000 / best.period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by the checksum of conversation and turn; dropped rows are marked. Nulls of role and text become one space."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fault = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        (fault == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    return Repair(damaged(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))).report()


QUERIES = {
    f.__name__: f for f in (
        op1_pieces, op2_projections, op3_secrets, op4_quality, op5_decontaminate, op6_html, op7_token_ids,
        op8_dartminhash, op9_toxicity, op10_warc, op11_periodic, op12_mixing, op13_repair,
    )
}
ORACLE = {"op5_decontaminate": sql.DECONTAMINATE, "op12_mixing": sql.MIXING, "op13_repair": sql.REPAIR}
