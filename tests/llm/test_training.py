"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import os
import random
import re
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evtlake.llm import components, decontam, licenses, packing, quality, simhash, substrings, token_rollup, tokens, url_rules, warc, winnow

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, hashes string, score string, uid bigint, node string"
rng = random.Random(5)
WORDS = ["the", "of", "Alpha", "beta", "gamma", "É", "x1", "don't", "zeta,", "MIT", "license"]
LONG = " ".join(rng.choice(WORDS) for _ in range(4000))
TEXTS = [LONG, None, "", " \n\t", "one", "one", LONG, "Released under the MIT License.", " ".join(LONG.split()[:300]), " ".join(LONG.split()[100:420]), *(" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) for n in (2, 34, 35, 80, 200))]
TEXTS.append(" ".join(TEXTS[-1].split()[:-1] + ["other"]))


def table(spark, texts=TEXTS):
    rows = [(i if i != 4 else None, t, None if i % 3 else "en", None, None, "h", "s", 1, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder()


def plain_ids(encoder, text):
    return encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(encoder):
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "re", "a", "É", "日本", "🙂", "1", "²", "!", "...", "　", " ", "<|endoftext|>", "\x00", "'ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + TEXTS
    ids, offsets = encoder.encode(pa.array(texts))
    assert all(plain_ids(encoder, t) == ids[offsets[i] : offsets[i + 1]].tolist() for i, t in enumerate(texts))


def test_rollup(spark, tmp_path, encoder):
    counted = token_rollup.token_counts(table(spark)).select("doc_id", "lang", "source", "n_tokens", F.lit("v1").alias("tokenizer"))
    assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(len(plain_ids(encoder, t)) for t in TEXTS)
    r = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    assert r.totals([0]).count() == 0
    assert r.commit(0, counted.withColumn("op", F.lit("insert"))) and not r.commit(0, counted.withColumn("op", F.lit("insert")))
    want = {(x["lang"]): (x["n"], x["t"]) for x in counted.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    assert {x["lang"]: (x["n_docs"], x["n_tokens"]) for x in r.totals([0]).collect()} == want
    moved = counted.where("lang = 'en'").select(F.lit("revise").alias("op"), "source", "lang", F.lit("v2").alias("tokenizer"), F.lit(3).alias("n_tokens"), *(F.col(c).alias(f"old_{c}") for c in ("source", "lang", "tokenizer", "n_tokens")))
    assert r.commit(1, moved)
    assert {(x["lang"], x["tokenizer"]) for x in r.totals([0, 1]).collect()} == {(None, "v1"), ("en", "v2")}
    r.commit(2, counted.where("lang IS NULL").withColumn("op", F.lit("delete")))
    assert [x["tokenizer"] for x in r.totals([0, 1, 2]).collect()] == ["v2"]
    assert r.commit(3, counted.where("false").withColumn("op", F.lit("insert")))
    # Compacted batches count as committed; what another writer put first stays.
    before = sorted(map(tuple, r.totals([0, 1, 2, 3]).collect()))
    r.compact(2)
    assert sorted(map(tuple, r.totals([3]).collect())) == before and not r.commit(1, moved)
    assert not r._put("batch=3", counted.select("source", "lang", "tokenizer", F.lit(1).alias("n_docs"), "n_tokens")) and sorted(map(tuple, r.totals([3]).collect())) == before
    with pytest.raises(ValueError):
        r.compact(5)


def brute_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_simhash(spark):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in ([w] if 0 < len(w) < 3 else zip(w, w[1:], w[2:]))]
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    texts = [t for i, t in enumerate(TEXTS) if i != 4]
    want = [fingerprint(t) for t in texts]
    rows = simhash.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).select("doc_id", simhash.hex_digits().alias("f"), "component_id").orderBy("doc_id").collect()
    assert [r["f"] for r in rows] == [f"{x:016x}" for x in want]
    assert [r["component_id"] for r in rows] == brute_components(len(texts), lambda i, j: bin(want[i] ^ want[j]).count("1") <= 3)
    assert simhash.near_duplicates(table(spark)).count() == len(TEXTS)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(5)
    for n in (0, 1, 4, 5, 31, 32, 33, 90, 700, 5000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for changed in sorted({0, 1, n // 10, n // 9, n // 8, n // 2, n}):
            other = np.unique(np.concatenate([base[changed:], rng.integers(0, 2**63, changed * 7 // 8).astype(np.uint64)]))
            sizes = np.array([len(base), len(other)])
            bits = int(simhash.sketch_bits(sizes).min())
            blob = pa.py_buffer(simhash.sketch(base) + simhash.sketch(other))
            a, b = rows = simhash.fold_sketches(blob, sizes, bits)
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(base, other))
            both = len(np.intersect1d(base, other))
            alike = bool(simhash._alike(rows, sizes, np.array([0]), np.array([1]), 0.8)[0])
            assert alike or both < 0.8 * (sizes.sum() - both)
            if n == 5000 and both < 0.6 * (sizes.sum() - both):
                assert not alike


@pytest.mark.parametrize("tile", [2, 4096])
def test_simhash_links_of_many_near_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for b in base for _ in range(8)})
    signed = [int.from_bytes(v.to_bytes(8, "little"), "big", signed=True) for v in values]
    nodes = spark.createDataFrame([(n, v.to_bytes(8, "little"), 0) for n, v in zip(signed, values)], "node bigint, fp binary, size int")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(nodes, 64, 3)).collect()}
    want = brute_components(len(values), lambda i, j: bin(values[i] ^ values[j]).count("1") <= 3)
    assert brute_components(len(values), lambda i, j: got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])) == want


def test_wide_near_duplicates_keep_one(spark):
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(6)]
    texts = base + [" ".join([*b.split()[:150], "new", *b.split()[151:]]) for b in base[:3]] + [base[5]]
    kept = simhash.deduplicated(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(6))


def test_long_texts_are_folded_in_parts(monkeypatch):
    texts = [LONG, "a b", "", " ".join(WORDS) + "\n" * 50, LONG[:900]]
    for n in (1, 3, 5):
        whole = [simhash.shingle_hashes(t, n) for t in texts]
        prints = simhash.fold(whole, 128)
        with monkeypatch.context() as m:
            m.setattr(simhash, "CHUNK", 7)
            m.setattr(simhash, "FOLD", 10)
            parts = [simhash.shingle_hashes(t, n) for t in texts]
            assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and np.array_equal(simhash.fold(parts, 128), prints)


def test_rounds_that_run_out_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u bigint, v bigint"), max_rounds=1)


def test_near_copies_keep_columns_of_any_name(spark):
    rows = simhash.deduplicated(spark.createDataFrame([(1, "a b c", 5, "n", 7), (2, "a b c", 6, "n", 7), (3, "d", 6, "n", 7)], "doc_id bigint, text string, row bigint, node string, component int"))
    assert rows.columns == ["doc_id", "text", "row", "node", "component"] and sorted(r["row"] for r in rows.collect()) == [5, 6]
    kept = decontam.decontaminated(spark.createDataFrame([(1, "a b c", 5, "n"), (2, "d", 6, "n")], "doc_id bigint, text string, row bigint, terms string"), spark.createDataFrame([(1, "b c")], "item_id bigint, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "d", 6, "n")]


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


def test_winnow_definition():
    for text in (LONG[:700], "a" * 300, "short", "x" * 32):
        h = [int(winnow.span_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([i]), np.array([i + 32]))[0]) >> 32 for i in range(len(text) - 31)]
        if h:
            w = min(64, len(h))
            want = sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)})
            hashes, places = winnow.winnow(text)
            assert places.tolist() == want and hashes.tolist() == [h[i] for i in want]
    assert len(winnow.winnow("")[0]) == 0 and len(winnow.winnow("ab")[0]) == 1
    shared = LONG[1000 : 1000 + 95]
    assert len(np.intersect1d(winnow.winnow("q" * 40 + shared + "z" * 50)[0], winnow.winnow(shared + "!" * 70)[0]))


@pytest.mark.parametrize("n", ["1", "4"])
def test_edited_fingerprints(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    texts = [t for i, t in enumerate(TEXTS) if i != 4]
    docs = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, at string")
    rows = winnow.edited_fingerprints(docs).orderBy("doc_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        own, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == winnow.text_of(winnow.winnow(own)[0]) and r["edited_fingerprint"] == winnow.text_of(winnow.winnow(edited)[0])
        assert r["places"] == winnow.winnow(own)[1].tolist() and r["edited_places"] == winnow.winnow(edited)[1].tolist()
        assert r["near_next"] == winnow.likeness(winnow.winnow(own)[0], winnow.winnow(following)[0])
        a, b = set(winnow.winnow(own)[0].tolist()), set(winnow.winnow(edited)[0].tolist())
        assert r["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0)
    assert winnow.edited_fingerprints(table(spark)).count() == len(TEXTS)
    assert winnow.edited_fingerprints(table(spark, [])).count() == 0
    assert winnow.fingerprints(table(spark)).count() == len(TEXTS)


def test_packing(spark, encoder):
    rows = packing.packed(table(spark)).collect()
    ids = {i if i != 4 else None: [*plain_ids(encoder, t), 0] for i, t in enumerate(TEXTS)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        n = len(ids[doc])
        lengths = [r["length"] for r in own]
        assert lengths == ([n] if n <= 2048 else ([n % 2048] if n % 2048 else []) + [2048] * (n // 2048))
        assert [r["start"] for r in own] == [sum(lengths[:i]) for i in range(len(own))] and [r["piece"] for r in own] == list(range(len(own)))
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and own[-1]["offset"] + own[-1]["length"] <= 2048
    assert packing.packed(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.lognormal(4.5, 1.2, 3000).astype(int) + 1, 256)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    rows = packing.plan(histogram, 256, 64)
    used = {}
    for length, first, end, _, offset in rows:
        used[length] = used.get(length, 0) + end - first
        assert offset + length <= 256
    assert used == histogram
    assert max(s + e - f for _, f, e, s, _ in rows) <= 1.02 * -(-int(lengths.sum()) // 256) + 1
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [(2048, 0, 3, 0, 0)]


def test_least_squares_is_non_negative():
    r = np.random.default_rng(1)
    a, b = r.random((12, 30)), r.random(12)
    x = packing.nonnegative_least_squares(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope[x > 0]).max() < 1e-6


def test_licenses(spark):
    apache = licenses.TEMPLATES["apache-2"][0]
    texts = ["Released under the MIT License. under the mit license", "a CC-BY-NC b cc by nc cc by nc", apache.upper(), "permission granted to any person", "gnu general public license " + "the mit " * 50, None, "", "x" * 5000]
    rows = [r.asDict() for r in licenses.scanned(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + ["plain text"] * 40)], "doc_id bigint, text string, uid int")).orderBy("doc_id").collect()]
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows[:3]] == [(2, 1, 5, "mit"), (3, 1, 8, "cc-by-nc"), (1, 3, 3, "apache-2")]
    assert rows[2]["labels"] == "apache-2" and rows[3]["labels"] == "" and rows[5]["n_words"] == rows[6]["n_words"] == 0 and rows[6]["score"] == 0
    assert rows[4]["labels"] == "" and all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 48
    assert licenses.scanned(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_licenses_that_are_common_mixed_or_alone(spark):
    whole = {t: text for t, (text, _) in licenses.TEMPLATES.items() if "/" not in t}
    labels = lambda texts: [r["labels"] for r in licenses.scanned(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert labels([whole["mit"]] * 20 + ["plain text"] * 40) == ["mit"] * 20 + [""] * 40
    assert labels([whole["gpl"]]) == ["gpl"]
    several = ["mit", "bsd", "gpl", "mpl-2", "isc"]
    assert labels([" and then ".join(whole[t] for t in several)] + ["plain text"] * 40)[0] == ",".join(sorted(several))


def brute_labels(texts):
    """Labels by the definition: all mandatory phrases, and enough of a template's rarest words on one shift, give or take a band."""
    files = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    held = [set(f) for f in files]
    rarity = {w: -sum(w in h for h in held) for text, _ in licenses.TEMPLATES.values() for w in text.split()}
    stands = lambda f, p: f" {p} " in f" {' '.join(f)} "
    out = []
    for f in files:
        found = {label for p, label in licenses.BASE.items() if stands(f, p)}
        for name, (text, must) in licenses.TEMPLATES.items():
            words = text.split()
            own = sorted(set(words), key=lambda w: (-rarity[w], w))
            top = own[: licenses.LOOKUPS]
            bands = {}
            for i, x in enumerate(f):
                for j, y in enumerate(words):
                    if x == y and x in top:
                        for k in range(2):
                            bands.setdefault((k, (i - j + 8 * k) // 16), set()).add(x)
            share = max(map(len, bands.values()), default=0) / len(top)
            if all(stands(f, p) for p in must) and share >= (0.5 if len(own) >= 24 else 0.8):
                found.add(name.split("/")[0])
        out.append(",".join(sorted(found)))
    return out


MENTIONS = [
    "The hotel says all rights reserved for guests.", "He likes the Mozilla Public License.", "cc by sa was rejected; we use something else", "permission is hereby granted free of charge",
    "The GNU General Public License is older than the Mozilla Public License, and Creative Commons Attribution is no software license.", "Redistribution and use in source and binary forms is a phrase of the BSD license.",
    "free and unencumbered software released into the public domain sounds nice", "She wrote about the GNU Lesser General Public License, all rights reserved, and cc by sa.", "Creative Commons Attribution ShareAlike versus Creative Commons Attribution NonCommercial",
    "Permission to use copy modify and or distribute this software for any purpose was asked for.",
]


def test_mentions_in_prose_are_no_licenses(spark):
    """Precision on names and phrases in prose: none of these gets a label, with and without licences among the documents."""
    for more in ([], [text for text, _ in licenses.TEMPLATES.values()]):
        texts = [*MENTIONS, *(f"{a} {b}" for a in MENTIONS for b in MENTIONS), *more]
        rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
        assert all(r["labels"] == "" and r["score"] == 0 for r in rows[: len(texts) - len(more)])
        assert all(r["labels"] and r["score"] >= 0.5 for r in rows[len(texts) - len(more) :])


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="needs licence texts")
def test_other_templates_from_files(spark):
    """Whole licence texts as templates, found in edited copies and not in each other."""
    read = lambda name: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", open(os.path.join(COMMON, name), encoding="utf-8", errors="replace").read().lower()))
    names = [n for n in ("Apache-2.0", "GPL-3", "MPL-2.0", "Artistic", "GPL-2") if os.path.exists(os.path.join(COMMON, n))]
    templates = {n: (read(n), []) for n in names}
    edited = [" ".join(["mine", *(w := templates[n][0].split())[: len(w) // 3], "changed", "here", *w[len(w) // 3 + 4 :]]) for n in names]
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(edited + MENTIONS)), "doc_id bigint, text string"), templates).orderBy("doc_id").collect()
    own = [set(r["labels"].split(",")) - {"", *r["base_labels"].split(",")} for r in rows]
    assert own == [{n} for n in names] + [set()] * len(MENTIONS)


@pytest.mark.parametrize("seed", range(3))
def test_license_labels_equal_brute_force(spark, seed):
    r = random.Random(seed)
    words = "software license the copy rights terms public under version 2 0 general free any source files reserved".split()
    texts = [None, "", "x" * 100_000]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(4)):
            own = r.choice(list(licenses.TEMPLATES.values()))[0].split()
            at = r.randrange(len(own))
            own = own if r.random() < 0.5 else own[at:] if r.random() < 0.5 else own[:at] + ["and", "more"] + own[at:]
            parts += own + [r.choice(words) for _ in range(r.randrange(30))]
        texts.append(r.choice([" ", "\n", "-"]).join(parts) if r.random() < 0.7 else " ".join(parts).upper())
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [x["labels"] for x in rows] == brute_labels(texts) and sum(bool(x["labels"]) for x in rows) > 20


def test_whole_licenses_are_found_by_text(spark):
    """Recall on licence texts with a line of their own in front, behind and in the middle: at least 0.9, here all."""
    names = [t for t in licenses.TEMPLATES if "/" not in t]
    texts = []
    for t in names:
        w = licenses.TEMPLATES[t][0].split()
        texts += [" ".join(["copyright", "2020", "someone", *w, "end"]), " ".join([*w[: len(w) * 3 // 4], "line", "of", "mine", *w[len(w) * 3 // 4 :]])]
    rows = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert all(names[i // 2] in x["labels"].split(",") for i, x in enumerate(rows))


def test_quality(spark):
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(200)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(60)) for _ in range(100)] + ["spam " * 60] * 50
    texts = good + bad + [None, "", "word " * 30000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(350)] + [(3, None)], "doc_id bigint, quality int")
    rows = quality.scored(docs, labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 350]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(rows) == len(texts)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] < 200) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in quality.scored(docs, labels.where("false"), keep_text=False).collect()} == {0.5}
    assert quality.scored(docs.where("false"), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_quality_on_held_out_labels(spark):
    scores = quality.scored(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"), keep_text=False)
    held = scores.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality IS NOT NULL").collect()
    assert len(held) > 20 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9


def brute_removed(texts, n):
    words = [(t or "").split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + n))
    return words, gone


@pytest.mark.parametrize("n,least", [(5, 8), (5, 2), (6, 2), (7, 2), (12, 2), (35, 8)])
def test_substrings(spark, n, least):
    texts = TEXTS + ["nt " * 50, " ".join(f"v{rng.randrange(3)}" for _ in range(150)), " ".join(f"v{rng.randrange(3)}" for _ in range(150))]
    docs = table(spark, texts)
    words, gone = brute_removed(texts, n)
    want = sorted((len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone))
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_report(docs, n, least).collect()) == want
    kept = substrings.deduplicated(docs.withColumn("spans", F.lit("own")).withColumn("uid", F.col("uid") + 6), n, least).collect()
    assert len(kept) == sum(not g or len(g) < len(w) for w, g in zip(words, gone))
    assert {(r["uid"], r["spans"], r["hashes"]) for r in kept} == {(7, "own", "h")}


def test_substrings_of_nothing(spark):
    assert substrings.removal_report(table(spark, [])).count() == 0
    assert substrings.levels(35) == [9, 18, 35] and substrings.levels(5) == [5]


def test_substrings_with_other_splits_between_jobs(spark, tmp_path, monkeypatch):
    """Rows keep their numbers when each job splits the files anew, as after a loss of executors."""
    texts = [f"own{i} " + " ".join(LONG.split()[50 * (i % 40) : 50 * (i % 40) + 60]) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(path)
    plain, splits = substrings.written, iter(range(1, 100))

    def other_splits(df, name):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(2000 + 3001 * (next(splits) % 7)))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + next(splits) % 5))
        return plain(df, name)

    monkeypatch.setattr(substrings, "written", other_splits)
    try:
        rows = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.removal_report(spark.read.parquet(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    words, gone = brute_removed(texts, 35)
    assert rows == {i: (len(w), len(g)) for i, (w, g) in enumerate(zip(words, gone))}


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination(spark, monkeypatch, block):
    items = [(1, " ".join(LONG.split()[50:75])), (2, "one"), (3, ""), (None, "the of"), (4, None), (10, " ".join(LONG.split()[60:72])), (10, " ".join(LONG.split()[60:72]))]
    rows = decontam.contamination(table(spark), spark.createDataFrame(items, "item_id bigint, text string"), block=block).collect()
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    tests = {}
    for item, text in items:
        w = cut(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 9)):
                tests.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = []
    for t in TEXTS:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in tests}:
            for i in range(len(w) - n + 1):
                if own := tests.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        want.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(r)[1:] for r in rows) == sorted(want)
    assert decontam.contamination(table(spark, []), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert decontam.contamination(table(spark), spark.createDataFrame([], "item_id bigint, text string")).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "aa bb xx cc dd"), (2, "aa bb cc dd"), (3, "dd cc bb aa")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "aa bb cc dd")], "item_id bigint, text string")
    found = lambda slop: {r["doc_id"] for r in decontam.matches(docs, items, 4, slop).collect() if r["item_ids"]}
    assert found(0) == {2} and found(1) == {1, 2}


def test_warc(spark):
    html = '<html lang="fr"><head><title>A &amp; B</title><script>x<b></script></head><body><p>Un<br>deux&nbsp;<a href="/u">u</a><a href="/u">u</a><!-- no --></p></body></html>'
    rows = spark.createDataFrame([("r1", "http://a", None, "H", html, 1), ("r2", None, None, None, None, 2), ("r2", None, None, None, None, 2)], "record_id string, target_uri string, date string, http_headers string, payload string, text int")
    out = [r.asDict() for r in warc.derivatives(rows).collect()]
    text = next(r for r in out if r["warc_type"] == "conversion" and r["refers_to"] == "r1")
    meta = next(r for r in out if r["warc_type"] == "metadata" and r["refers_to"] == "r1")
    assert text["block"] == "A & B\nUn\ndeux u u" and meta["block"] == "title: A & B\r\nlanguage: fr\r\noutlinks: 1\r\noutlink: /u\r\n"
    assert text["source_digest"] == "sha1:" + hashlib.sha1(html.encode()).hexdigest() and text["block_digest"] == "sha1:" + hashlib.sha1(text["block"].encode()).hexdigest()
    assert text["source_headers"] == "H" and len(out) == 6 and text["record_id"] != meta["record_id"]
    assert all(uuid.UUID(r["record_id"].removeprefix("urn:uuid:")).version == 3 for r in out)
    assert warc.derivatives(rows.where("false")).count() == 0


@pytest.mark.parametrize("page,text", [
    ("a<script>x <script> y</script>b", "a b"), ("a<style>p{}", "a"), ("a<!-- <script> -->b", "a b"), ("a < b > c", "a < b > c"), ("<param>x<picture>y", "x y"),
    ("&#233;&#xE9;&eacute;&amp;lt; &amp &copy;", "\u00e9\u00e9\u00e9&lt; &amp \u00a9"), ("<p >a</P\n>b<br/>c", "a\nb\nc"), ("<SCRIPT>x</ScRiPt >b", "b"), ("<scripted>a", "a"), ("a<b", "a<b"), ("", ""),
])
def test_page_text(page, text):
    assert warc.page_text(page) == text


def test_pages_are_read_in_linear_time():
    began = time.perf_counter()
    for sign in ("<", "<!--", "<script>", "</script", '<a href="', "<title", "<html ", "&", " \n", "<p ", "&#1"):
        page = sign * (2_000_000 // len(sign))
        warc.page_text(page)
        warc.page_fields(page)
    assert time.perf_counter() - began < 30


def test_warc_files(spark, tmp_path):
    page = "<html><title>T</title><p>eins\r\n\r\nzwei &uuml;</p></html>"
    responses = [("urn:uuid:1", "http://a/?x=1:2", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html", page), ("urn:uuid:2", "http://b", "2024-01-02T00:00:00Z", "HTTP/1.1 200 OK", "")]
    record = lambda r: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{r[0]}>\r\nWARC-Target-URI: {r[1]}\r\nWARC-Date: {r[2]}\r\nContent-Length: {len((r[3] + r[4]).encode()) + 4}\r\n\r\n{r[3]}\r\n\r\n{r[4]}\r\n\r\n"
    info = "WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    (tmp_path / "in.warc").write_bytes((info + "".join(map(record, responses))).encode())
    read = warc.read_responses(spark, str(tmp_path / "in.warc"))
    assert sorted(tuple(r)[:5] for r in read.collect()) == responses
    made = warc.derivatives(read)
    warc.write_records(made, str(tmp_path / "out"))
    again = warc.read_records(spark, str(tmp_path / "out")).collect()
    want = {r["record_id"]: r for r in made.collect()}
    assert len(again) == len(want) == 4
    for r in again:
        w = want[r["fields"]["warc-record-id"].strip("<>")]
        assert bytes(r["block"]).decode() == w["block"] and r["complete"] and r["fields"]["warc-refers-to"] == f"<{w['refers_to']}>" and r["fields"]["warc-block-digest"] == w["block_digest"] and r["fields"]["content-length"] == str(w["content_length"])


def test_urls(spark):
    urls = ["http://a.example.org/es/1", "http://example.org/en/12?x", "http://b.org/es/1", "https://X.Example.COM/fr/a#b", "http://c.com/de/1", "http://spam.net/es/2", "nothing", None, "http://notexample.org/es/", "http://z.net"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(100 + i, f"http://q{i}.example.org/es/{i}", 1) for i in range(30)], "page_id bigint, url string, uid int")
    rows = {r["page_id"]: r for r in url_rules.judged(pages).collect()}
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(10)] == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.org", "/es/1", "org/"), ("x.example.com", "/fr/a", "com/fr/"), ("c.com", "/de/1", "com/de/"),
        ("spam.net", "/es/2", None), ("", "", None), ("", "", None), ("notexample.org", "/es/", "org/"), ("z.net", "", None),
    ]
    assert rows[5]["verdict"] == "block" and rows[9]["verdict"] == "allow" and rows[4]["verdict"] == "block" and len(rows) == 40
    assert url_rules.judged(pages.where("false")).count() == 0


def brute_rules(rows, least, min_confidence, most=3):
    """(tokens, verdict): (confidence, support) of all rules, straight from their definition."""
    rows = [(set(t), v) for t, v in rows if v]
    held = {}
    for i, (t, _) in enumerate(rows):
        for x in t:
            held.setdefault(x, set()).add(i)
    known = {}
    for n in range(1, most + 1):
        for combo in itertools.combinations(sorted(held), n):
            own = set.intersection(*(held[x] for x in combo))
            for v in {rows[i][1] for i in own}:
                hit = sum(rows[i][1] == v for i in own)
                if hit >= least and hit / len(own) >= min_confidence:
                    known[frozenset(combo), v] = hit / len(own), hit / len(rows)
    return {(c, v): x for (c, v), x in known.items() if not any(w == v and d < c and known[d, w][0] >= x[0] for d, w in known)}


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(9)]
    rows = []
    for _ in range(150):
        t = {x for x in names if r.random() < 0.35}
        t |= {"u1", "u2"} if "t1" in t else set()  # always together
        rows.append((sorted(t), None if r.random() < 0.1 else "block" if {"t1", "t2"} <= t or "t3" in t and r.random() < 0.95 else "allow"))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "uid bigint, tokens array<string>, verdict string")
    got = {}
    for x in url_rules.mined_rules(df, 0.02, 0.8, min_count=3).collect():
        for combo in itertools.product(*x["items"]):
            got[frozenset(combo), x["verdict"]] = x["confidence"], x["support"]
    want = brute_rules(rows, 3, 0.8)
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k])) and len(got) > 5


def test_long_urls_are_mined_in_time(spark):
    """A URL of 40 words among 100, 30 words shared by mixed URLs, and more items than a transaction may have."""
    words = lambda n, k=0: "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 + k)}" for i in range(n))
    urls = [f"http://a.example.org/es/{words(40)}"] + [f"http://b{i}.example.org/{'es' if i % 2 else 'fr'}/{words(30, 3) if i % 3 else 'x'}" for i in range(100)]
    r = random.Random(1)
    urls += [f"http://c{i}.example.org/{'es' if r.random() < 0.5 else 'fr'}/" + "/".join(f"q{chr(97 + j)}" for j in range(26) if r.random() < 0.9) for i in range(100)]
    began = time.perf_counter()
    rows = url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    assert len(rows) == len(urls) and time.perf_counter() - began < 60


def test_urls_are_judged_alike_by_shuffled_rules(spark, monkeypatch):
    urls = [(i, f"http://{'spam' if i % 3 else 'news'}{i % 7}.example.{'org' if i % 2 else 'net'}/{'es' if i % 3 else 'en'}/{i}") for i in range(300)] + [(None, None), (1, "http://x")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    rows = lambda: sorted(map(repr, url_rules.judged(pages).collect()))
    broadcast = rows()
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", 0)
    assert rows() == broadcast and any("mined_rule='" in x for x in broadcast) and len(broadcast) == 302


def test_near_copies_are_verified_at_the_stated_similarity(spark):
    def pair(shared, *own):
        """Texts that share a run of words and end in words of their own: so many shingles of five words more each."""
        base = [f"s{rng.randrange(10**9)}" for _ in range(shared + 4)]
        return [" ".join(base + [f"o{rng.randrange(10**9)}" for _ in range(n)]) for n in own]

    near = [pair(4, 0, 1), pair(8, 1, 1), pair(800, 100, 100), pair(800, 0, 200), pair(80, 10, 10)]
    far = [pair(5, 0, 2), pair(7, 1, 1), pair(750, 125, 125), pair(790, 105, 105), pair(3, 0, 2)]
    texts = [t for p in near + far for t in p]
    repeated = "a b c d e f g h " * 40
    texts += [repeated, "a b c d e f g h " * 3]  # the same set of shingles
    kept = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 4, 6, 8, *range(10, 20), 20]


def test_near_copies_by_row(spark):
    text = LONG[:2000]
    kept = simhash.deduplicated(spark.createDataFrame([(1, text), (1, text), (None, text), (1, "other words"), (None, "alone")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, text), (1, "other words"), (0, "alone")])


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_by_row(spark, block):
    words = LONG.split()
    docs = spark.createDataFrame([(1, "clean"), (1, LONG), (1, LONG), (None, LONG), (None, " ".join(words[::-1])), (None, "plain")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words[50:75])), (2, " ".join(words[200:230]))], "item_id bigint, text string")
    found = sorted(((r["doc_id"] or 0), r["n_words"], r["n_items"]) for r in decontam.contamination(docs, items, block=block).collect())
    assert [(d, i) for d, _, i in found if i] == [(0, 2), (1, 2), (1, 2)] and len(found) == 6
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in decontam.decontaminated(docs, items, block=block).collect()) == [(0, 5), (0, len(" ".join(words))), (1, 5)]
    rows = lambda b: sorted(map(repr, decontam.contamination(table(spark), items, block=b).collect()))
    assert rows(block) == rows(500_000)
