"""Token counts kept by signed deltas: inserts, deletes and revised counts add to totals by source, language and tokenizer.

A change is one row: op ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens, and for 'revise' the former
old_source, old_lang, old_tokenizer, old_n_tokens. `signed` turns it into additive rows (+1 or -1 document, plus or minus
its tokens), `Rollup.commit` sums a batch before it is written, each batch in a folder of its own. It is written under a name of
its own first and then renamed, which one of several writers can do: a batch that was committed is skipped, one that broke
off is written anew, so repeating any batch changes nothing. The rename is atomic on HDFS and local disks; on an object store
only as the store's own is. `Rollup.compact` replaces the first batches by their sums and removes what broken writers left.

Defined results: null source, lang or tokenizer form groups of their own; a null count is 0; other ops are ignored; an
empty batch or table commits nothing but counts as committed; repeated rows count each time; further columns are ignored
by `signed` and kept by `token_counts`. Groups whose documents and tokens both sum to 0 are left out of the totals. A very
long text is tokenized alone, in its task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import at, bounded, lean
from .textarrays import slices, text_column
from .tokens import SLICE, encoder

KEYS = ["source", "lang", "tokenizer"]


def token_counts(docs: DataFrame, column: str = "text", vocabulary: str = "byte_bpe_50k.json", to: str = "n_tokens") -> DataFrame:
    """docs without the text, plus its number of ids; a null text has none."""
    kept = [f for f in docs.schema.fields if f.name not in (column, to)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{to}` bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, SLICE):
            _, offsets = encoder(vocabulary).encode(text_column(batch, column))
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(offsets))], names=[*(f.name for f in kept), to])
        encoder(vocabulary).rest()

    return bounded(docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`").cast("string").alias(column))).mapInArrow(lean(count), schema)


def signed(changes: DataFrame) -> DataFrame:
    """One additive row for an insert or delete, two for a revised count."""
    cols = set(changes.columns)

    def side(sign: int, prefix: str) -> Column:
        values = [F.col(prefix + k) if prefix + k in cols else F.lit(None).cast("string") for k in KEYS]
        n = F.col(f"{prefix}n_tokens") if f"{prefix}n_tokens" in cols else F.lit(None)
        return F.struct(*(v.cast("string").alias(k) for k, v in zip(KEYS, values)), F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(n.cast("long"), F.lit(0))).alias("n_tokens"))

    plus, minus, old = side(1, ""), side(-1, ""), side(-1, "old_")
    rows = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(old, plus))
    return changes.select(F.explode(rows).alias("r")).select("r.*")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class Rollup:
    """Totals in a folder of the shared store: one sub-folder of summed deltas for each committed batch, and sums of the
    batches up to a number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        system, where = at(self.spark, f"{self.path}/{name}")
        return system.exists(where)

    def _put(self, name: str, rows: DataFrame) -> bool:
        """Writes rows and gives them the name at once; False if another writer did before."""
        trial = f"{self.path}/trial-{uuid.uuid4().hex}"
        rows.write.parquet(trial)
        system, where = at(self.spark, trial)
        _, final = at(self.spark, f"{self.path}/{name}")
        # A rename onto a folder that exists fails or moves below it, as the file system has it.
        if not system.exists(final) and system.rename(where, final):
            _, below = at(self.spark, f"{self.path}/{name}/{where.getName()}")
            if not system.exists(below):
                return True
            system.delete(below, True)
        system.delete(where, True)
        return False

    def _compacted(self) -> int:
        """The number up to which batches are summed; -1 if none are."""
        system, where = at(self.spark, self.path)
        names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        return max((int(n.removeprefix("upto=")) for n in names if n.startswith("upto=")), default=-1)

    def committed(self, batch_id: int) -> bool:
        return int(batch_id) <= self._compacted() or self._exists(f"batch={int(batch_id)}")

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Adds a batch once; False if it had been committed before. Batch numbers count from 0."""
        return not self.committed(batch_id) and self._put(f"batch={int(batch_id)}", summed(signed(changes)))

    def totals(self, batch_ids: list[int]) -> DataFrame:
        """Totals over those of the given batches that were committed, and all that were compacted."""
        upto = self._compacted()
        names = [f"upto={upto}"] if upto >= 0 else []
        names += [f"batch={b}" for b in dict.fromkeys(map(int, batch_ids)) if b > upto and self._exists(f"batch={b}")]
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], SCHEMA)
        return summed(rows).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, batch_id: int) -> None:
        """Replaces all batches up to this one by their sums, while no other writer is at work. ValueError if one of them is
        missing."""
        batch_id = int(batch_id)
        ids = list(range(self._compacted() + 1, batch_id + 1))
        if missing := [b for b in ids if not self.committed(b)]:
            raise ValueError(f"batches {missing} are not committed")
        if ids:
            former = [f"upto={ids[0] - 1}"] * (ids[0] > 0) + [f"batch={b}" for b in ids]
            self._put(f"upto={batch_id}", self.totals(ids))
            for name in former:
                system, where = at(self.spark, f"{self.path}/{name}")
                system.delete(where, True)
        system, where = at(self.spark, self.path)
        for name in [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []:
            if name.startswith("trial-"):
                system.delete(at(self.spark, f"{self.path}/{name}")[1], True)
