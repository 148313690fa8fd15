import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as p
from evtlake.llm import queries, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def test_stages(spark, tmp_path):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if i < len(p.STAGES) - 1:
            assert docs.columns == p.COLUMNS
        if i == 0:
            assert sum(labels[d] for d in ids if d in labels) >= 0.97 * sum(labels.values())
        if i == 1:
            shingles = {}
            for r in before.collect():
                w = (r["text"] or "").encode().lower().split()
                shingles[r["doc_id"]] = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)}
            near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
            order = sorted(ids)
            assert not any(near(shingles[a], shingles[b]) for k, a in enumerate(order) for b in order[:k])
            gone = set(shingles) - ids
            assert all(any(x != g and near(shingles[x], shingles[g]) for x in shingles) for g in gone)
        own = {r["doc_id"]: r["text"] or "" for r in before.collect()}
        if i == 2:
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == without_repeats(own)
        if i == 3:
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == {d: t for d, t in own.items() if not contaminated(t, items)}
        if i == 4:
            check_packing(own, docs.collect())


def without_repeats(texts, n=35):
    """Texts without the words of windows that start more than once; those left empty go."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, t in texts.items()}
    starts = Counter(tuple(w[i : i + n]) for w in words.values() for i in range(len(w) - n + 1))
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - n + 1) if starts[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept = texts[d] if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)
        if kept.split():
            out[d] = kept
    return out


def contaminated(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own = f" {' '.join(words(text))} "
    return any(f" {' '.join(w[i : i + n])} " in own for w in map(words, items) if w for i in range(max(1, len(w) - n + 1)))


def check_packing(texts, rows, capacity=2048):
    """Every id of every document once, in sequences that are full but for their ends, hardly more than there must be."""
    encode = tokens.encoder().whole.encode
    ids = {d: [*encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[d][at : at + length], "<u4").tobytes())
            assert length == capacity or k == 0
            at += length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / capacity + 2


def test_results_outlive_later_runs(spark):
    first = p.run(spark, SF)
    second = p.run(spark, SF)
    assert first.count() == second.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))


def test_winnowing_sees_half_of_short_documents(spark):
    rows = queries.op3_winnowing(spark, SF).where("n_chars BETWEEN 38 AND 190").collect()
    assert rows and all(r["near_edited"] > 0 for r in rows)
