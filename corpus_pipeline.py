"""A corpus from raw documents to token ids, as stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``; other columns, whatever their names,
are dropped at the start of each. An empty table stays empty in every stage. Rows are told apart by all their columns, never
by doc_id alone, which may be null or repeat.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import langid, mixing, simhash, substring
from trackframe.llm.common import cut, ensure_checkpoint_dir
from trackframe.llm.queries import bpe_digests, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with some certainty.

    Null and empty texts and those without a letter go. Repeated rows and null or repeated ids are judged each by its own
    text; texts are read whole, however long. A tie between languages is certain enough only by LEAST_SCORE. A null lang teaches
    nothing; where no row has a lang there is nothing to reject by, and every text with a letter stays.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, ~langid.held_out())
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.identify(docs, model, carry=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


#: What tells rows apart: doc_id, which may be null or repeat, and two hashes of the whole row.
ROW = ("doc_id", "_h1", "_h2")


def _marked(docs: DataFrame) -> DataFrame:
    """The documents with the hashes of ROW; only rows that are equal in full have the same."""
    parts = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return docs.select(*COLUMNS, *(F.xxhash64(F.lit(seed), *parts).alias(h) for seed, h in enumerate(ROW[1:])))


def _joined(docs: DataFrame, picked: DataFrame, how: str) -> DataFrame:
    """Marked documents joined with ``picked``, which has each row once, and ``n``, how often it is there."""
    if not picked.where("n > 1").isEmpty():
        docs = docs.dropDuplicates(list(ROW))  # equal in full, so it does not matter which one stays
    other = picked.drop("n").withColumnsRenamed({c: f"{c}_" for c in ROW})
    return docs.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ROW], how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, null last; of several with it the one whose row hashes least.

    Null, empty and blank texts are one group. Rows of one doc_id with unlike texts, and rows without one, are kept apart; rows
    that are equal in full are one. Long texts count by all their shingles.
    """
    docs = _marked(docs)
    found = simhash.near_duplicates(docs, carry=ROW[1:])
    rows = found.groupBy("root", *ROW).agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW, "n")).alias("r")
    first = cut(rows.groupBy("root").agg(least).select(*(f"r.{c}" for c in (*ROW, "n"))), docs.count())
    return _joined(docs, first, "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has; documents of which nothing is left go.

    Null, empty and short texts stay as they are, and so does a text that loses nothing, with its spaces. A null doc_id comes
    after every other: such a row loses what others have and costs them none. Rows of one doc_id are no reason
    against each other, so repeated rows stay.
    """
    out = substring.dedup_substrings(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), tidy=False)
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept").cast("string"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words, so the mix takes none or all of them as it takes others, by their place in the order.
    A null source is a source. Rows that are equal in full count by their number, wherever they tie; rows of one doc_id
    or of none are taken each.
    """
    docs = _marked(docs)
    taken = mixing.mix(docs, carry=ROW[1:]).groupBy(*ROW).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    rows = _joined(docs, cut(taken.where("copies > 0"), docs.count()), "inner")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded bytes.

    Null and empty texts have no ids, a null doc_id stays null, and repeated rows have a row each.
    """
    return bpe_digests(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express language ID, SimHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what comes between is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
