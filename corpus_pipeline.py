"""A corpus through five operators: toxicity, near copies, contamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that its predecessor
kept and, but for the last, returns the columns of its input.  Whole rows travel as one
struct, so columns of any name come through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronbase.llm import decontam, mixing, rans, simhash, toxicity
from heronbase.llm.common import doc_key, materialize, table, vocabulary

ROW = "__row"


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row in one."""
    return docs.select(*[docs[n] for n in names], F.struct(*[docs[c] for c in docs.columns]).alias(ROW))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on this corpus's labelled rows, does not call toxic."""
    scored = toxicity.score(carried(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(f"{ROW}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.representatives(carried(docs, "doc_id", "text"), ROW).select(f"{ROW}.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any whole window of a benchmark item, of which less than a twentieth lies in shorter items."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated OR whole_window").select("doc", "version").distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(ROW), doc_key().alias("doc"), F.xxhash64("text").alias("version"))
    return keyed.join(decontam.small(materialize(found, "contaminated")), ["doc", "version"], "left_anti").select(f"{ROW}.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(carried(docs, "doc_id", "source", "text"), keep=[ROW])
    return mixed.where("copies > 0").select(F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), ROW).select(f"{ROW}.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in ascending order of id, read back."""
    return rans.round_trip(docs, vocabulary("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]
#: A trained model and a public tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
