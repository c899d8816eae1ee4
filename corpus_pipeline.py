"""The corpus pipeline: quality rules, near-duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; n_chars is the table's
own figure and isn't counted again. Null texts and texts under 50 words go in the first stage; rows
without id or source are judged, grouped, mixed and encoded like others; an empty table passes
all stages empty. Once the result is written, tessera.llm.common.clear(spark) deletes the tables
between the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, nbest, quality, simhash
from tessera.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or line frequencies reject go, and frequent lines leave the others' texts.

    Exact copies count once here: the next stage takes them down to one, so a text isn't template for being copied.
    """
    return quality.cleaned(docs, copies_once=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; at most one of a source is cut, where its budget ends."""
    return mixing.sampled(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's n best segmentations, with their scores; the columns but the text stay."""
    import public_tokenizers

    return nbest.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("sentencepiece", pieces),
]

#: SQL has no XXH64 fingerprints and no piece lattice; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
