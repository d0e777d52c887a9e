"""Training-data pipeline over ``documents``: each stage's rows are written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import langid, linededup, mixing, packing, tgm
from offerloom.llm.queries import tokenizer_path
from offerloom.llm.store import Workspace
from offerloom.llm.text import boxed, unboxed
from offerloom.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A document goes when its best language covers less of it than this, or it has no letters.
LEAST_LANGUAGE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing ``lang`` is filled in.

    The model learns from the labelled rows. Where there are none, nothing can be rejected.
    """
    ship(spark)
    model = langid.fit(docs)
    if not model.langs:
        return docs
    found = F.col("_found.lang")
    rows, box = boxed(docs)
    lang = F.coalesce(F.col(f"{box}.lang"), found).alias("lang")
    return (
        rows.withColumn("_found", langid.language(F.col(f"{box}.text"), model))
        .where((found != langid.UNDETERMINED) & (F.col("_found.score") >= LEAST_LANGUAGE))
        .select(*[lang if c == "lang" else unboxed(box, [c])[0] for c in docs.columns])
    )


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in three documents or more stay in one of them; no document goes."""
    new = {
        "text": F.col("kept_text").alias("text"),
        "n_chars": F.length("kept_text").cast("long").alias("n_chars"),
    }
    return linededup.drop_repeated_lines(docs).select(
        *[new.get(c, F.col(f"`{c}`")) for c in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % of their five-word shingles."""
    ship(spark)
    return tgm.one_per_component(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids, and a checksum of these."""
    ship(spark)
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and tokenizers have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
