"""The registered queries without SQL against brute force on small tables; hot keys of rows without an id."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evtlake.llm import packing, quality, queries, token_rollup, tokens, winnow
from tests.llm.test_training import LONG, TEXTS, brute_components

rng = random.Random(9)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, held_out string, score string, y string, at string, row bigint, h bigint"
OWN = [t for i, t in enumerate(TEXTS) if i != 4] + [LONG[:900], LONG[:902], "a b c", "A B C", "日本語 の テキスト です"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(3 * i + 1, t, "en", "s", 0, "x", "y", "z", "w", 1, 2) for i, t in enumerate(OWN)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3 * i + 1, i % 2, 0) for i in range(len(OWN))], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_op2_query(spark, folder):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in ([w] if 0 < len(w) < 3 else zip(w, w[1:], w[2:]))]
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [fingerprint(t) for t in OWN]
    groups = brute_components(len(OWN), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    got = sorted(map(tuple, queries.op2_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == [(3 * i + 1, f"{prints[i]:016x}", 3 * groups[i] + 1) for i in range(len(OWN))]


def brute_winnow(text, k=10, w=10):
    """Hashes by the definition: of each window the smallest, the rightmost of equal ones."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    if not len(codes):
        return []
    k = min(k, len(codes))
    h = [int(winnow.span_hashes(codes, np.array([i]), np.array([i + k]))[0]) >> 32 for i in range(len(codes) - k + 1)]
    w = min(w, len(h))
    return [h[j] for j in sorted({min(range(i, i + w), key=lambda j: (h[j], -j)) for i in range(len(h) - w + 1)})]


def test_op3_query(spark, folder):
    short = [t if t is None or len(t) < 1500 else t[:1500] for t in OWN]
    path = f"{folder}/short"
    spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(short)], "doc_id bigint, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    rows = queries.op3_winnowing(spark, path).orderBy("doc_id").collect()
    assert len(rows) == len(short)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    for i, r in enumerate(rows):
        own, following = short[i] or "", short[(i + 1) % len(short)] or ""
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        a, b, c = map(brute_winnow, (own, edited, following))
        spelled = ["".join(f"{h:08x}" for h in x) for x in (a, b)]
        want = (3 * i + 1, len(own), hashlib.sha256(edited.encode()).hexdigest(), *spelled)
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == want
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_op3_rows_without_an_id_are_split(spark):
    """2,000 documents without a doc_id and 500 of one doc_id go to many ranges; each still meets the next by the hash of its text."""
    texts = [f"text {i} {'x' * (i % 50)}" for i in range(2500)]
    docs = spark.createDataFrame([(None if i < 2000 else 7, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        bounds = winnow.range_bounds(docs, 16)
        out = winnow.edited_fingerprints(docs, 10, 10)
        held = out.groupBy(F.spark_partition_id()).count().collect()
        got = [(r["doc_id"], r["edited_sha256"]) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(bounds) >= 12 and len(held) >= 10 and max(r["count"] for r in held) <= 2 * 2500 / 16 * 1.5
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i >= 2000, hashed[t], t) for i, t in enumerate(texts)))
    want = []
    for k, (some, _, t) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        want.append((7 if some else None, hashlib.sha256((t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op5_query(spark, folder):
    rows = queries.op5_packing(spark, folder).collect()
    encode = tokens.encoder().whole.encode
    ids = {3 * i + 1: [*encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(OWN)}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [i for r in own for i in ids[d][r["start"] : r["start"] + r["length"]]] == ids[d] and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
        assert all(r["length"] == 2048 for r in own[1:])
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op5_repeated_rows_without_an_id(spark, monkeypatch):
    """3,000 equal rows are spread over all salts, each packed once."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    docs = spark.createDataFrame([(None, "the same text", "x")] * 3000, "doc_id bigint, text string, row string")
    rows = packing.packed(docs).collect()
    assert len(rows) == 3000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    plan = packing.packed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(row" in plan


def test_quality_with_clashing_columns_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame([(1, "again", "en", "s", 0, "x", "y", "z", "w", 1, 2)] * 50 + [(None, None, None, None, 0, "x", "y", "z", "w", 1, 2)], DOCS))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.scored(docs, labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0)], labels.schema)), max_rows=10)
    rows = out.collect()
    assert len(rows) == len(OWN) + 51 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {c for c in docs.columns if c not in ("held_out", "score")} <= set(out.columns) and {r["y"] for r in rows} == {"z"}
    assert len({r["score"] for r in rows if r["text"] == "again"}) == 1 and all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.scored(docs.where("false"), labels).count() == 0
    assert quality.scored(docs, labels.where("false")).select("score").distinct().collect()[0][0] == 0.5
    other = quality.scored(docs.repartition(7), labels, max_rows=10)
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:50], round(r["score"], 9)) for r in df.collect())
    assert key(other) == key(quality.scored(docs.coalesce(1), labels, max_rows=10))


def test_rollup_leaves_no_trials(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    (tmp_path / "trial-broken").mkdir()
    changes = spark.createDataFrame([("insert", "s", "en", "t", 3)], "op string, source string, lang string, tokenizer string, n_tokens bigint")
    for b in (0, 1, 1):
        rollup.commit(b, changes)
    rollup.compact(1)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("trial-")]
    assert [tuple(r) for r in rollup.totals([]).collect()] == [("s", "en", "t", 2, 6)]
