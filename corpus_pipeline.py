"""A training corpus in five stages: quality, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), reads what the one before kept and returns documents (the last one: pieces with
their sequences). `run` applies them to the documents table, each stage's result written to the shared folder and read
again. A stage's result must be written before the next stage starts, as that deletes the tables it was made from; the
result of `run` may be read at any time, after later runs too.
SQL can express neither the classifier nor the packing, so ORACLE_SQL is None. Tests hold the first stage against its labels
and the others against brute force on what each was given.

Defined results: a null text is empty, is scored like one and, if kept, is a copy of any other empty text; documents left
empty by the third stage go; null and repeated doc_ids are documents of their own; of equal documents the one read first
stays; texts of any length are read whole; an empty table gives an empty result; further columns are left out, whatever they
are called.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

from evtlake.llm import decontam, packing, quality, simhash, substrings
from evtlake.llm.store import delete, recorded, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application and thread: the number of the stage that ran last and the tables that it wrote on its way.
_former: dict[tuple[str, int], tuple[int, list[str]]] = {}


def stage(number: int) -> Callable[[Stage], Stage]:
    """A stage that deletes the tables of the one before it, whose result is written by then. Those of the last stage stay
    until the application ends, so what `run` has returned can be read whenever it is wanted; so do those of a stage that
    another than the next one follows."""

    def staged(f: Stage) -> Stage:
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            key = spark.sparkContext.applicationId, get_ident()
            former, paths = _former.pop(key, (None, []))
            if former == number - 1:
                delete(spark, paths)
            with recorded() as paths:
                result = f(spark, docs.select(*COLUMNS), sf_dir)
            _former[key] = number, paths
            return result

        return run

    return staged


@stage(0)
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, labels).where("predicted = 1").select(*COLUMNS)


@stage(1)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    return simhash.deduplicated(docs)


@stage(2)
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that stand elsewhere too."""
    return substrings.deduplicated(docs)


@stage(3)
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("near copies", drop_near_copies), ("repeats", drop_repeats), ("benchmark", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, keep in STAGES[:-1]:
        docs = written(keep(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
