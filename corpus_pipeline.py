"""Corpus cleaning: five text operators applied one after another to ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents. ``run`` applies
the stages in order, each result written to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillcast.llm import bpe, decontam, langid, pii, simhash
from tillcast.llm.common import Scratch, col, crc_mod, fresh, read

MIN_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of MIN_POSTERIOR or more; ``und`` goes.

    The model learns from the given documents with a language, those whose crc32 mod 3 is 1 left out.
    """
    model = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = langid.identify(spark, docs, model, names=names)
    return (told.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= MIN_POSTERIOR))
            .select(*map(col, docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose fingerprints are linked the document of the smallest id.

    Fingerprints and links are those of op2_simhash. All texts without a word, null and
    empty ones among them, have one fingerprint and are one component. Rows without a
    doc_id stay.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    name = fresh(docs, "leaks")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.size(name) == 0).select(*map(col, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span replaced by its kind, n_chars brought up to date; all documents stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(col, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them.

    Reads the columns doc_id, text, lang, source and n_chars; others are left out.
    """
    import public_tokenizers
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, vocabulary).drop("text")
    back = bpe.decode(encoded, vocabulary)
    return back.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("tokens", tokens),
]

ORACLE_SQL = None  # a trained model, fingerprints and tokenization have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
