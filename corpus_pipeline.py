"""The corpus pipeline: toxicity, language, near duplicates, decontamination, SentencePiece, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.llm import decontaminate, language, near_dup, pieces, toxicity
from brindle.llm.queries import table, vocabulary
from brindle.session import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the network learns from the labels of the documents at hand.

    Null and empty texts score 0 and stay; with labels of one class only, none or all are rejected as that class says.
    Rows that repeat a doc_id are scored each on its own; a null doc_id teaches nothing but is scored. No documents give none."""
    net = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs.select(COLUMNS), net).where("predicted = 0").select(COLUMNS)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: those without a letter, or too unlike every language for their length, go.

    Where no document has a language to learn from, nothing can be told and all stay. Null and empty texts hold no letter
    and go. Each row is judged by its text alone, so rows that repeat a doc_id are kept or dropped on their own."""
    training = language.training_rows(docs)
    prototypes = language.learn(training)
    if not prototypes:
        return docs.select(COLUMNS)
    floors = language.learn_floors(training, prototypes)
    return language.identify(docs.select(COLUMNS), prototypes, floors).where(F.col("lang_pred") != language.UND).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates (five-word shingles, similarity 0.8).

    Texts without words are alike to none and stay. Rows that repeat a doc_id are one document, judged by the text that
    sorts first and kept or dropped together; rows with a null doc_id are compared with none and stay."""
    gone = near_dup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no stretch with a benchmark item.

    Null and empty texts and rows with a null doc_id share none and stay; of rows that repeat a doc_id all go if one of
    them shares a stretch. An empty benchmark drops nothing."""
    return decontaminate.clean_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them: one row for each row; a null text is an empty one."""
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("minhash_near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained network and a learnt tokenizer's merges can't be told in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared folder and read again, and deleted after the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
