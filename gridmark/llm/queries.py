"""The queries op1 to op13: thin applications of the operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embedding_dedup, html_text, language_id, license_scan, media, mixing, near_dedup, quality_model, quality_rules, resampling, warc_zip
from .oracles import ORACLES  # noqa: F401  (read with QUERIES)
from .store import read, small_batches


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id", 3, 1))
    model = language_id.train(docs.where("NOT held_out"))
    guess = docs.select("doc_id", "held_out", language_id.identify(model, spark, "text").alias("g"))
    return guess.select("doc_id", "held_out", "g.lang_pred", "g.score", "g.bits_per_byte")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, plan = mixing.mix(docs, F.array("source"))
    return mixing.with_targets(mixed, plan, "source").select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def vocabulary() -> str:
    """The vocabulary file that op5 names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document."""
    docs = bpe.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return docs.select("row.doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    small_batches(spark)
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html_text.main_text("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on four-word shingles as its contract asks."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC records in ZIP packages, and read back."""
    return warc_zip.read_back(warc_zip.write(read(spark, sf_dir, "pages")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text kept as media, and as an interleaved page: its paragraphs, a reference to the media as the cover and
    another one in a figure in the middle.  References resolve by digest; ``in_order``: the text pieces are the text's
    paragraphs in order, and both references stand, captioned, at their places, and resolve alike."""
    raw, text = F.coalesce("text", F.lit("")).cast("binary"), F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), raw.alias("raw"), F.sha2(raw, 256).alias("digest"))
    figures = media.features(media.store(docs, "digest", "raw"))
    cut = docs.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), "digest", media.paragraphs(F.col("text")).alias("lines"))
    pages = cut.select("doc_id", "n_bytes", "digest", F.xxhash64("lines").alias("said"), F.size("lines").alias("n"), media.sequence(media.page(F.col("lines"), F.col("digest"), F.lit("whole text"))).alias("pieces"))
    told = F.xxhash64(F.transform(F.filter("pieces", lambda p: p["kind"] == "text"), lambda p: p["text"]))
    named = F.transform(F.filter("pieces", lambda p: p["kind"] != "text"), lambda p: F.concat_ws(" ", p["position"].cast("string"), p["ref"], p["caption"]))
    places = (("0", "cover"), ((1 + F.floor(F.col("n") / 2)).cast("string"), "whole text"))
    due = F.array(*(F.concat_ws(" ", F.lit(at) if isinstance(at, str) else at, F.concat(F.lit("sha256:"), "digest"), F.lit(caption)) for at, caption in places))
    references = F.filter("pieces", lambda p: p["kind"] != "text")
    checked = pages.select("doc_id", "n_bytes", F.xxhash64("digest").alias("of"), ((F.col("said") == told) & (named == due)).alias("placed"), F.size("pieces").alias("n_pieces"), references.alias("pieces"))
    resolved = media.resolve(checked, "pieces", figures)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    cover = F.col("caption") == "cover"
    folded = resolved.groupBy("doc_id", "n_bytes", "of", "placed", "n_pieces").agg(
        F.count_if(~cover).alias("times"), F.count_if(cover).alias("covers"), F.count_if(F.col("payload_bytes").isNull()).alias("open"), F.max(F.when(~cover, F.struct("position", *names))).alias("m"),
    )
    in_order = (F.col("placed") & (F.col("covers") == F.col("times")) & (F.col("open") == 0)).alias("in_order")
    return folded.select("doc_id", "n_bytes", *(F.col(f"m.{c}") for c in names), "n_pieces", "m.position", in_order, F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels of the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language_id.held_out("doc_id", 5, 0))
    labels = read(spark, sf_dir, "labels").where(~language_id.held_out("doc_id", 5, 0))
    model = quality_model.train(docs.where("NOT held_out"), labels, corpus=docs)
    scored = docs.select("doc_id", "held_out", quality_model.score(model, spark, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the texts of ``benchmark``."""
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_mixing, op3_quality_rules, op4_license_scan, op5_bpe, op6_html_text, op7_near_dedup, op8_warc_zip, op9_media, op10_quality_model,
        op11_resampling, op12_divergence, op13_embedding_dedup,
    )
}
