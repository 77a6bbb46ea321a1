"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import answers, attention_lm, bpe, contamination, epsilon_grid, jaccard, language, merkle, mixing, pages, repeats, secrets, suffix_array, suffix_tree, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and class of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fold 1 of 3 is never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    model = language.fit(docs, ~held_out)
    got = docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that stand anywhere else too."""
    got = suffix_array.repeated_bytes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n_units").alias("n_bytes"), repeats.n_removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word windows that stand earlier in the corpus."""
    got = suffix_tree.repeated_words(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n_units").alias("n_words"), repeats.n_removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the attention model and the word unigram model; fold 2 of 7 is never learned from."""
    import public_tokenizers

    training = fold(F.col("doc_id"), 7) != 2
    return attention_lm.score(table(spark, sf_dir, "documents"), training, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability under the raked mix, whether it is kept, and its weight."""
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return got.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"), F.round("_weight", 6).alias("weight"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = docs.select("doc_id", contamination.find(docs, table(spark, sf_dir, "benchmark")).alias("h"))
    h = F.col("h")
    return got.select(
        "doc_id", h["n_words"].alias("n_words"), contamination.n_hit(h).alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"), contamination.contaminated(h).alias("contaminated"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, scanned once per distinct text."""
    got, _ = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_found", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return got.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("_found")).alias("spans"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector at cosine 0.95."""
    return epsilon_grid.near_copies(table(spark, sf_dir, "embeddings"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    got = table(spark, sf_dir, "pages").select("page_id", "url", pages.page_text(F.col("html")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document; where 7 divides the id's checksum, one character more is claimed."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = F.when(fold(F.col("doc_id"), 7) == 0, merkle.leaf([more if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    got = merkle.manifest(docs, claimed=tampered)
    proof = F.array_join(F.transform("proof", lambda s: F.substring(s, 2, 64)), "")
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = table(spark, sf_dir, "documents").select("doc_id", bpe.encode_and_decode(F.col("text"), path).alias("b"))
    return got.select("doc_id", bpe.n_tokens(F.col("b.ids")).alias("n_tokens"), F.sha2("b.ids", 256).alias("ids_sha256"), F.sha2(F.col("b.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join, "op2_language_id": op2_language_id, "op3_repeated_bytes": op3_repeated_bytes, "op4_repeated_words": op4_repeated_words, "op5_lm_score": op5_lm_score, "op6_source_mix": op6_source_mix, "op7_decontamination": op7_decontamination, "op8_secret_scan": op8_secret_scan,
    "op9_embedding_dedup": op9_embedding_dedup, "op10_page_text": op10_page_text, "op11_merkle_manifest": op11_merkle_manifest, "op12_bpe": op12_bpe, "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {"op1_jaccard_join": answers.JACCARD, "op6_source_mix": answers.source_mix(), "op7_decontamination": answers.DECONTAMINATION, "op8_secret_scan": answers.secret_scan(), "op11_merkle_manifest": answers.MERKLE}
