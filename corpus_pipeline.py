"""A corpus from raw documents: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs is the table that the stage before has written, and works on all of it. All but
the last return the columns of docs, whatever their names are: rows are carried as a struct.

In every stage a null text is as an empty one, an empty table gives an empty table, repeated rows and ties of doc_id are rows of
their own (of rows that are copies of each other the smallest doc_id stays, null after all others, then the first by place), and
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.llm.decontaminate import decontaminate
from helix.llm.exact_dedup import exact_groups
from helix.llm.langid import crc_part, predict, train
from helix.llm.near_dedup import near_classes
from helix.llm.pack import pack
from helix.llm.queries import tokenizer_path
from helix.llm.shared import load, located, texts_at, written
from helix.shipping import ship

#: A document is rejected if it has no letters, or if no language is more likely than this.
LEAST_SCORE = 0.5


def _as_rows(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its text, so that columns of any name are carried through."""
    return docs.select("text", F.struct("*").alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; it learns from the labelled two thirds of docs, as op7 does. Null, empty and texts without letters go; without
    any labelled document all go."""
    ship(spark)
    model = train(docs.filter(crc_part(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    said = predict(_as_rows(docs), model, carry=("row",))
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def _only(places: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a located table that are kept."""
    kept = rows.filter("kept").select("_file", "_row")
    return places.join(kept, ["_file", "_row"], "left_semi").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    places = located(docs)
    return _only(places, exact_groups(texts_at(places, "doc_id", "text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship(spark)
    places = located(docs)
    return _only(places, near_classes(texts_at(places, "doc_id", "text")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; without benchmark items all stay, and so do texts without words."""
    ship(spark)
    found = decontaminate(_as_rows(docs), load(spark, sf_dir, "benchmark"), carry=("row",))
    return found.filter("NOT contaminated").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; a null or empty text is its end token."""
    ship(spark)
    return pack(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: A learned language model and sketches are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
