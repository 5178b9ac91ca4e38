"""A corpus pipeline: each stage reads what the one before has written.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, with n_chars kept true. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import Workspace, table
from loomlake.llm.decontaminate import remove_spans
from loomlake.llm.line_dedup import dedup_lines
from loomlake.llm.near_dedup import one_of_each
from loomlake.llm.pieces import MODEL, load_pieces, piece_digest
from loomlake.llm.quality import THRESHOLD, fit_quality, score_quality

#: Near duplicates here, as elsewhere without a contract: five words, similarity 0.8.
WORDS, PERCENT = 5, 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of THRESHOLD or more, by a net fitted on these documents' labels.

    Null and empty texts are judged as a chunk of zeros; repeated rows return alike.
    Without labels of both kinds every text gets the share of label 1 (0.5 without labels,
    so that all stay).
    """
    net = fit_quality(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    rows = docs.select("text", F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    return score_quality(rows, net).where(F.col("score") >= THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and similar lines; documents that had nothing else go.

    Null and empty texts stay as they are. Rows equal in id and text count as one and return
    alike; of equal lines the one of the least id stays.
    """
    return _counted(dedup_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least id, and of rows equal in id and text one.

    Documents without words are in no group and all stay, nulls too.
    """
    return one_of_each(docs, WORDS, PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such go.

    Null and empty texts stay as they are; repeated rows return alike; without items all stay.
    """
    return _counted(remove_spans(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids (as a digest), scores, round trip and n best segmentations.

    Null and empty texts have no pieces; repeated rows return alike; of equally good
    segmentations the one whose ids come first is the better one.
    """
    return piece_digest(docs, load_pieces(MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: Most stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.cut(stage(spark, docs, sf_dir), str(k))
    return STAGES[-1][1](spark, docs, sf_dir)
