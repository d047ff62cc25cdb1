"""The corpus pipeline: quality rules, near-dedup, decontamination, secret masking, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.decontam import drop_contaminated
from quarry.llm.neardup import drop_near_copies
from quarry.llm.packing import pack, token_pieces
from quarry.llm.quality import judge
from quarry.llm.secrets import scan_secrets
from quarry.llm.tokens import tokenizer_path


def _beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``docs`` whose columns but doc_id and text have other names meanwhile.

    So an input column that is called as a column of an operator passes through as it came.
    """
    names = {c: c if c in ("doc_id", "text") else f"k_in_{i}" for i, c in enumerate(docs.columns)}
    found = work(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees.

    A null, empty or wordless text fails the base rules and goes. Rows are judged by their text alone,
    so repeated rows and ids stay or go together; null ids are judged like others. Without labels of
    both kinds the base rules decide. An empty table stays empty. All columns pass through.
    """
    labels = table(spark, sf_dir, "labels")
    return _beside(docs, lambda d: judge(d, labels).where("kept"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies (five-word shingles, Jaccard >= 0.8): that with the smallest doc_id.

    Null ids come last; of rows with the same id any one stays. Null and wordless texts are copies of
    each other. Rows of one id with different texts are different documents. An empty table stays empty.
    All columns pass through.
    """
    return _beside(docs, drop_near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark.

    Null and wordless texts hold none and stay, as all do beside an empty benchmark; null items have no
    phrases. Repeated rows are judged each. An empty table stays empty. All columns pass through.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _beside(docs, lambda d: drop_contaminated(d, items))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, where there is one, counted anew.

    Null texts stay null, with their n_chars null. Repeated rows are masked alike. Without base spans to
    learn from, base spans alone are masked. An empty table stays empty. Other columns pass through.
    """
    masked = _beside(docs, lambda d: scan_secrets(d, redact=True))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with their ids' checksum.

    A null or empty text is one piece of its end id. Repeated rows are packed each, null ids stay null.
    An empty table gives no pieces. Only doc_id and text enter.
    """
    pieces = token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)
    packed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("packing", packing),
]

#: Learned models, tokenizers and XXH64 are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
