"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the next one's docs.

toxicity drops documents that score 0.5 or more; ngram_join keeps one document of each class of near copies (the one that
names it); substring_dedup takes repeated passages out of the texts; mixing repeats and leaves out documents so that
sources meet their target weights; byte_bpe encodes what is left and decodes it again. All but the last return the columns
of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import toxicity
from tickloom.llm.bpe import encode
from tickloom.llm.common import fresh, settle, table
from tickloom.llm.mixing import RESULTS, mix_sources
from tickloom.llm.ngram_join import ngram_components
from tickloom.llm.substrings import substring_dedup

#: Near copies are documents whose word n-grams agree so far: five words, 0.8.
NGRAM, PERCENT = 5, 80
#: Words of a passage that counts as repeated. Documents that lose all their words go.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    (score,) = fresh(docs, "score")
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stays if its class has its doc_id, or it is in none (no doc_id); of rows with the same doc_id and text one stays."""
    id_, hash_, drop = fresh(docs, "id", "hash", "drop")
    classes = ngram_components(docs, NGRAM, PERCENT, hashes=True)
    other = F.coalesce(F.bool_or(F.col("doc_id") != F.col("component_id")), F.lit(False))
    keys = classes.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(other.alias(drop), F.count("*").alias("n"))
    keys = settle(keys.where(F.col(drop) | (F.col("n") > 1)).select(id_, hash_, drop))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    again = docs.join(keys.where(~F.col(drop)), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(keys, same, "left_anti").unionByName(again)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, n, removed = fresh(docs, "kept", "n_words", "n_removed")
    cut = substring_dedup(docs, PASSAGE, (kept, n, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(n)))
    own = {"text": F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col(removed) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return cut.select(*(own[c].alias(c) if c in own else F.col(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    names = tuple(fresh(docs, *RESULTS))
    copies = names[3]
    mixed = mix_sources(docs, names=names).where(F.col(copies) > 0)
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs must be read from files or a checkpoint, as each stage's docs are."""
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True, settled=True).withColumn("decoded", F.col("decoded").cast("string"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix),
    ("byte_bpe", encode_bytes),
]
#: SQL can't express the first stage's model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)  # later stages read their input more than once
    return docs
