"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import bpe, chat, decontaminate, html_main, idstore, language, licences, near_dup, pieces, resample, sort_means, toxicity, vector_dup
from brindle.llm.sampling import id_hash
from brindle.session import scratch


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, shingle=3, percent=85)


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")
    return rows.select("conv_id", "participant", "piece", "n_turns", "text", spans.alias("mask_spans"))


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idstore")
    idstore.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return idstore.verify_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn(language.training_rows(docs))
    held_out = F.coalesce(F.pmod(id_hash("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out")  # false for a null doc_id
    return language.identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held_out, "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(id_hash("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out")  # false for a null doc_id
    return toxicity.score_texts(docs, net).select("doc_id", held_out, "score", "predicted")


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))


def op7_hyperplane_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no file names: a document of which a licence is the greater part stands for its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"))
    found = licences.scan(docs.select(F.concat(folder, F.col("doc_id").cast("string")).alias("path"), "text"), F.col("whole") >= licences.MOSTLY)
    doc_id = F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id")
    return found.select(doc_id, "path", "licence", F.round("score", 6).alias("score"), "origin", "source_path")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_automaton_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, file = table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json")
    return bpe.encode_decode(docs, file, lexicon=bpe.build_lexicon(docs, file))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample.resample(docs.select("doc_id", "text"), items.select("text"))


QUERIES = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_content_store": op2_content_store,
    "op3_minhash_near_dup": op3_minhash_near_dup,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_spaced_seed_decontamination": op6_spaced_seed_decontamination,
    "op7_hyperplane_near_dup": op7_hyperplane_near_dup,
    "op8_sentencepiece_codec": op8_sentencepiece_codec,
    "op9_licence_scan": op9_licence_scan,
    "op10_html_main_text": op10_html_main_text,
    "op11_sort_means": op11_sort_means,
    "op12_automaton_bpe_codec": op12_automaton_bpe_codec,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {
    "op1_perspective_rotation": chat.ORACLE,
    "op6_spaced_seed_decontamination": decontaminate.oracle(),
    "op11_sort_means": sort_means.oracle(),
}
