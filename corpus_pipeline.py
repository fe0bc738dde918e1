"""A corpus through five of the text operators: toxic documents go, one document of each group of near
duplicates stays, repeated passages are cut out, documents with benchmark passages go, and the rest is
encoded. Every stage is written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import default_tokenizer, encode
from millrace.llm.common import filter_rows, stored
from millrace.llm.decontaminate import without_passages
from millrace.llm.jaccard import jaccard_classes
from millrace.llm.substrings import shared_passages
from millrace.llm.suffixes import remove_repeats
from millrace.llm.toxicity import fit_toxicity

TOXIC_FROM = 0.5

HAD_BENCHMARK = "\ufdd0benchmark passage cut\ufdd0"
"""Ends a text with a benchmark passage that lost repeated passages, maybe this one. U+FDD0 is kept by Unicode
for use inside programs; the next stage takes out any document with this mark."""

PASSAGE_WORDS = 51
PASSAGE_GRAM = 26
"""Words of the grams that passages are looked up by first, see `millrace.llm.substrings.levels`."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below `TOXIC_FROM`. NULL, empty and blank texts have no words and stay whatever
    the model says of them. Ties, repeated rows and columns of any name pass through; texts are scored whole."""
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")

    def make():
        score = model.scorer()
        return lambda texts: [not x.strip() or s < TOXIC_FROM for x, s in zip(texts, score(texts).tolist())]

    return filter_rows(docs, "text", make)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the document with the smallest id. Documents without words all stay. Rows
    that repeat a document, id and text, count as one; rows that share only an id stay or go by their id."""
    about = stored(spark, jaccard_classes(spark, docs, "doc_id", "text")[0], "classes")
    stay = about.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_stay"))
    stay = stay.distinct().hint("shuffle_hash")
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
    repeated = about.groupBy("doc_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 400-byte strings that also start elsewhere, and without the passages of
    more than 50 words that another document has too, whatever their bytes; both are judged on the
    input. A text that loses passages of words and would have a benchmark passage with them ends in
    `HAD_BENCHMARK`, so that the next stage still finds it. A character that is cut through goes; a document that loses
    everything stays with an empty text."""
    passages = shared_passages(spark, docs, "doc_id", "text", PASSAGE_WORDS, PASSAGE_GRAM)
    cut = remove_repeats(spark, docs, "doc_id", "text", as_text=True, more=passages)
    cut = stored(spark, cut.dropDuplicates(["doc_id", "text_key"]), "cut")
    without = cut.where("kept_without != kept").select("doc_id", "text_key", F.col("kept_without").alias("text"))
    clean = drop_contaminated(spark, without, sf_dir).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.lit(True).alias("_clean")
    )
    same = (cut["text_key"] == clean["_key"]) & cut["doc_id"].eqNullSafe(clean["_id"])
    note = F.when((cut["kept_without"] != cut["kept"]) & clean["_clean"].isNull(), HAD_BENCHMARK).otherwise("")
    cut = cut.join(clean, same, "left").select(
        cut["doc_id"].alias("_id"), cut["text_key"].alias("_key"), F.concat(cut["kept"], note).alias("_kept")
    )
    cut = stored(spark, cut, "noted").hint("shuffle_hash")
    same = (F.xxhash64(docs["text"]) == cut["_key"]) & docs["doc_id"].eqNullSafe(cut["_id"])
    whole = cut["_key"].isNull()
    made = {"text": F.when(whole, docs["text"]).otherwise(cut["_kept"])}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(whole, docs["n_chars"]).otherwise(F.length(cut["_kept"]))
    return docs.join(cut, same, "left").select(
        *[
            (made[c].cast(kind) if c in made else docs[c]).alias(c)
            for c, kind in ((f.name, f.dataType) for f in docs.schema)
        ]
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near to a benchmark item, now or before their repeated passages were cut."""
    docs = docs.where(~F.coalesce(F.col("text").contains(HAD_BENCHMARK), F.lit(False)))
    return without_passages(docs, "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `ids`, `n_tokens`."""
    return encode(docs, "doc_id", "text", default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("encoding", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
