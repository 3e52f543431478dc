"""Cleaning and packing a corpus: toxicity, language, near copies, sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, langid, packing, toxicity
from quire.llm.common import materialise, remainder, table


#: Near copies: shingles of five words, a similarity of 80 per cent.
WORDS, PERCENT = 5, 80


def where(docs: DataFrame, judge: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows whose result of ``judge(docs, keep=...)`` meets the condition.

    Other columns than doc_id and text pass it under names of their own, so that none clashes with a result.
    """
    plain, names = renamed(docs)
    kept = judge(plain, keep=tuple(n for n in names.values() if n != "doc_id")).where(condition)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with further columns named passing_0, passing_1 and so on, and the new name of each column."""
    names = {c: c if c in ("doc_id", "text") else f"passing_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts stay unless the class prior alone rejects; null ids, repeated rows and further columns of
    any name are kept as they are; an empty table stays empty.
    """
    training = F.coalesce(remainder("doc_id", 5) != 0, F.lit(True))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), training)
    return where(docs, lambda d, keep: toxicity.classify(d, model, keep), "predicted = 0")


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the calibrated models reject go; without a model all stay.

    Null and empty texts, and texts without a letter, have no language and go. Null ids, repeated rows and further
    columns of any name are kept as they are; an empty table stays empty.
    """
    training = F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))
    model = langid.train(docs, training)
    if not model.languages:
        return docs
    return where(docs, lambda d, keep: langid.identify(d, model, keep), "not rejected")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row of the smallest id, then text fingerprint, stays.

    Documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Rows without a
    word link with nothing and stay. Rows that repeat id and text stay once; different texts of one id, or of null
    ids, are different documents. Further columns may have any name; an empty table stays empty.
    """
    # partial sums drop repeats before the shuffle, whose keys the join then has too
    keys = ["near_copies_id", "near_copies_no_id", "near_copies_fingerprint"]
    keyed = lambda df, fingerprint: df.withColumns(dict(zip(keys, [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), fingerprint], strict=True)))
    kept = keyed(jaccard.representatives(docs, words=WORDS, percent=PERCENT), F.col("fingerprint")).select(*keys)
    plain, names = renamed(docs)
    rows = keyed(plain, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(keys)
    return rows.join(kept, keys, "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences; null texts are empty ones, and each row is its own document."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_copies", drop_near_copies), ("packing", pack_sequences)]

#: No stage can be put in SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
