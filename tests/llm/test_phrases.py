"""Phrases, source divergence and chat formatting against brute force, and on odd rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evtlake.llm import chat, collocations, divergence, queries, runs, textarrays
from evtlake.llm.textarrays import U64

SF = "/root/testdata/sf0.001"
rng = random.Random(11)
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
WORDS = ["The", "of", "new", "york", "É", "x\x01", "a" * 40, "日本語", "don't", "b" * 12]
TEXTS = [" ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n", ":"]) for _ in range(rng.randrange(80))) for _ in range(60)]
TEXTS += [None, "", " \t\n.,;", "New York City " * 40, "New York City " * 40, " ".join(rng.choice(WORDS) for _ in range(5000))]
ROWS = [(i, t, [None, "en", "und", "fr"][i % 4], [None, "s", "t", "", "u"][i % 5], "k", i, 1, "p") for i, t in enumerate(TEXTS)]
DOCS = "doc_id bigint, text string, lang string, source string, key string, n bigint, rank int, term string"


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def brute_phrases(rows, least, top, longest=4):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in counts.items():
        cands = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in cands.items():
            cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            if any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in cands.items()):
                continue
            score, _, l_, r = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), l_, r))
        for rank, (score, a, phrase, l_, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l_, r, sizes[lang], -score))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    if small:  # containers burst, tries spill, chunks and merges are cut
        local(monkeypatch, ("collocations", {"BURST": 8, "WAIT": 16, "MOST": 200, "SLICE": 300}), ("runs", {"CHUNK": 5, "HELD": 20}))
    got = [tuple(r) for r in collocations.mined(table(spark), least=5, top=40).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(ROWS, 5, 40)
    assert collocations.mined(table(spark, []), least=5).count() == 0
    two = {tuple(r) for r in collocations.mined(table(spark), longest=2, least=5, top=3).collect()}
    assert two == brute_phrases(ROWS, 5, 3, 2)
    with pytest.raises(ValueError):
        collocations.mined(table(spark), longest=5)


def local(monkeypatch, *settings):
    """Constants in the workers: they import the modules anew, so the scans are wrapped to set them there."""
    for name, values in settings:
        module = {"collocations": collocations, "runs": runs, "divergence": divergence}[name]
        before = module.lean

        def lean(f, before=before, name=name, values=values):
            def run(batches):
                import importlib

                own = importlib.import_module(f"evtlake.llm.{name}")
                kept = {k: getattr(own, k) for k in values}
                for k, v in values.items():
                    setattr(own, k, v)
                try:
                    yield from f(batches)
                finally:
                    for k, v in kept.items():
                        setattr(own, k, v)

            return before(run)

        monkeypatch.setattr(module, "lean", lean)


def test_trie_counts_and_collisions(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 10)
    monkeypatch.setattr(collocations, "WAIT", 4)
    trie = collocations.Trie(3, 7)
    want = Counter()
    for _ in range(50):
        paths = [tuple(rng.choice((1, 2, 3, 9, 40)) for _ in range(3)) for _ in range(rng.randrange(1, 30))]
        want.update(paths)
        trie.add([np.array(c) for c in zip(*paths)])
    assert isinstance(trie.root, collocations.Node) and any(isinstance(c, collocations.Node) for c in trie.root.children)
    got = Counter()
    for t in trie.root.tables():
        for a, b, n in zip(*(t.column(c).to_pylist() for c in "abn")):
            got[a >> 32, a & 0xFFFFFFFF, b >> 32] += n
    assert got == want and trie.root.size() == len(want)
    words = collocations.Trie(1, 7)
    spell = lambda new: (["en"] * len(new), [b"w"] * len(new), np.zeros(len(new), U64))
    assert words.numbers(np.array([5, 9], U64), np.array([1, 2], U64), spell).tolist() == [1, 2]
    assert words.numbers(np.array([3, 9], U64), np.array([7, 2], U64), spell).tolist() == [3, 2]
    assert words.numbers(np.array([9], U64), np.array([8], U64), spell) is None  # another word with the same hash


def test_runs_stay_whole(spark, monkeypatch):
    """A task that spills once sends one chunk for each language and part, however many containers its trie has; and the parts
    do not grow with Spark's partitions without end, so neither does the number of chunks."""
    local(monkeypatch, ("collocations", {"BURST": 8, "WAIT": 16}))
    chunks = collocations.phrase_runs(table(spark).na.fill("und", ["lang"]).coalesce(1), 2, 5, None).groupBy("lang", "part").count().collect()
    assert chunks and {r["count"] for r in chunks} == {1}
    seen = []

    def stop(docs, length, parts, keep):
        seen.append(parts)
        raise InterruptedError

    monkeypatch.setattr(collocations, "phrase_runs", stop)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 600, 50_000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            with pytest.raises(InterruptedError):
                collocations.mined(table(spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [256, 600, 1024]


def test_phrases_of_odd_words(spark, monkeypatch):
    """Wide gaps, words that end in control characters (which sort before a space) and words of many bytes, in small runs."""
    local(monkeypatch, ("collocations", {"BURST": 8, "WAIT": 16, "MOST": 60, "SLICE": 300}), ("runs", {"CHUNK": 3, "HELD": 5, "SENT": 60}))
    words = ["x", "x\x01", "x\x01y", "X\x0e", "x" * 8, "x" * 9, "x" * 16, "é" * 70, "x" * 139 + "y", "x" * 140]
    gaps = [" ", "  ", "\t ", ". ", " .", " . ", "  !  ", "\n\n", " \t \r \t "]
    texts = ["".join(rng.choice(words[:4] * 3 + words) + rng.choice(gaps[:3] * 4 + gaps) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else "fr", "s", "k", i, 1, "p") for i, t in enumerate(texts)]
    got = [tuple(r) for r in collocations.mined(table(spark, rows), least=4, top=500).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, 4, 500)


def test_words_and_hashes(monkeypatch):
    raw = np.frombuffer(bytes(range(256)) * 3 + b"AZ[@", np.uint8)
    assert textarrays.lowered(raw).tolist() == textarrays.LOWER[raw].tolist()
    for t in (collocations.BREAKS, collocations.WORDS, collocations.SPACES, textarrays.SPACED, textarrays.PLAIN, divergence.TERMS, textarrays.byte_table(""), ~textarrays.byte_table(""), ~textarrays.PLAIN):
        assert textarrays.inside_of(raw, t).tolist() == t[raw].tolist()
    words = sorted({bytes(rng.choice((0, 1, 97, 255)) for _ in range(n)) for n in [*range(1, 40)] * 20})
    for salt in (0, 1, 7):
        alone = [textarrays.limb_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), salt) for w in words]
        ends = np.cumsum([len(w) + 1 for w in words])
        both = textarrays.limb_hashes(np.frombuffer(b"z" + b"z".join(words), np.uint8), ends - [len(w) for w in words], ends, salt)
        for own, one in zip(both, zip(*alone)):
            assert own.tolist() == [int(x[0]) for x in one] and len(set(own.tolist())) == len(words)
    assert both[0].tolist() != textarrays.limb_hashes(np.frombuffer(b"z" + b"z".join(words), np.uint8), ends - [len(w) for w in words], ends)[0].tolist()

    def collide(raw, starts, ends, salt=0, real=textarrays.limb_hashes):
        first, second = real(raw, starts, ends, salt)
        return first if salt else first & U64(1), second

    monkeypatch.setattr(collocations, "limb_hashes", collide)
    batch, trie = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["a b c. a", "a b"]}), collocations.Trie(1, 7)
    assert collocations.words_of(batch, trie) is None
    trie.salt = 1
    ids, joins = collocations.words_of(batch, trie)
    assert [(trie.langs[i - 1], trie.words[i - 1]) for i in ids] == [("en", b"a"), ("en", b"b"), ("en", b"c"), ("en", b"a"), ("de", b"a"), ("de", b"b")]
    assert joins.tolist() == [True, True, False, False, True, False]


def test_chunks_are_cut_by_batches(monkeypatch):
    """As chunk_rows cuts them, in several batches."""
    monkeypatch.setattr(runs, "CHUNK", 3)
    monkeypatch.setattr(runs, "SENT", 50)
    group, part = np.array([0] * 8 + [1] * 4), np.array([0, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3])
    keys, counts = pa.array([f"{i:02}\n".encode() for i in range(12)], pa.large_binary()), np.arange(12)
    batches = list(runs.chunk_batches([("en",), ("fr",)], ["lang"], group, part, keys, counts))
    want = []
    for first, last in ((0, 1), (1, 8), (8, 10), (10, 12)):
        want += runs.chunk_rows((["en", "fr"][group[first]],), int(part[first]), runs.lines(pa.array([f"{i:02}".encode() for i in range(12)], pa.large_binary())), counts, first, last)
    assert len(batches) > 1 and [tuple(r.values()) for b in batches for r in b.to_pylist()] == want
    assert batches[0].schema == runs.chunk_batch(want, ["lang"]).schema


def test_chunks_merge_in_order(spark):
    rows = [("g", 0, *r[2:]) for keys in (["a", "c", "e"], ["b", "c"], ["c", "d", "é"]) for r in runs.chunk_rows(("g",), 0, runs.lines(pa.array([k.encode() for k in keys], pa.large_binary())), np.ones(len(keys), np.int64), 0, len(keys))]
    df = spark.createDataFrame(rows, runs.chunk_schema(["lang"]))
    assert {tuple(r) for r in runs.merged(df, ["lang"]).collect()} == {("g", "a", 1), ("g", "b", 1), ("g", "c", 3), ("g", "d", 1), ("g", "e", 1), ("g", "é", 1)}
    assert {tuple(r) for r in runs.merged(df, ["lang"], 2, totals=True).collect()} == {("g", "c", 3), ("g", None, 8)}


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in df.items() if n >= least]
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if df[t] >= least)
        whole = sum((c for c in count.values()), Counter())
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        rates, q = {s: rate(c) for s, c in count.items()}, rate(whole)
        for s in count:
            pairs = sorted((-sum(abs(rates[s][t] - rates[o][t]) for t in kept), o.encode()) for o in count if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - rates[s][t], t.encode()) for t in kept if count[s][t] and rates[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "BLOCK", 7)
        local(monkeypatch, ("divergence", {"HELD": 3, "MOST": 30}), ("runs", {"CHUNK": 5, "HELD": 20}))
    got = [tuple(r) for r in divergence.audited(table(spark), 3, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(ROWS, 3, 4)
    assert {g[:4] for g in divergence.audited(table(spark), 10**6).collect()} == {(*b[:4],) for b in brute_divergence(ROWS, 10**6, 50)}
    assert divergence.audited(table(spark, [])).count() == 0


def test_many_sources(spark):
    """More sources than a tile holds."""
    rows = [(i, f"{rng.choice('abc')} {rng.choice('abcdef')} {rng.choice('abc')}", "en", f"s{i % 70:02}", "k", i, 1, "p") for i in range(700)]
    got = [tuple(r) for r in divergence.audited(table(spark, rows), 3, 2).collect()]
    assert set(got) == brute_divergence(rows, 3, 2) and len(got) == len(set(got))


def test_radix_and_packing():
    columns = [np.array([rng.randrange(2 ** rng.choice((3, 20, 64))) for _ in range(500)], U64) for _ in range(2)]
    order = divergence.radix_order(*columns)
    assert [(int(columns[0][i]), int(columns[1][i])) for i in order] == sorted(zip(map(int, columns[0]), map(int, columns[1])))
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(300)})
    for n in (1, 2):
        own = [w for w in words if len(w) <= 8 * n]
        raw = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(w) for w in own])
        packed = divergence.packed(raw, ends - [len(w) for w in own], ends, n)
        assert divergence.unpacked(packed).to_pylist() == own
        assert divergence.radix_order(*packed).tolist() == list(range(len(own)))
    assert len(divergence.radix_order(np.zeros(0, U64))) == 0


BITS = ["\\", "<", "/", "turn>", "<turn>", "</turn>", "<says>", "says>", "<|endoftext|>", " ", "é", "🙂", "\n", "a", "  b", "### Assistant:", "\\<", "\x00"]


def said(n):
    return "".join(rng.choice(BITS) for _ in range(n))


def digest(rows):
    texts = [t or "" for _, _, r, t, *_ in rows if r == "assistant"]
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, *_ in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len("".join(texts)), sha("".join(texts))


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 200)
    local_chat = {"PART_CHARS": 200, "BATCH_CHARS": 500}
    before = chat.lean

    def lean(f):
        def run(batches):
            from evtlake.llm import chat as own

            kept = {k: getattr(own, k) for k in local_chat}
            for k, v in local_chat.items():
                setattr(own, k, v)
            yield from f(batches)
            for k, v in kept.items():
                setattr(own, k, v)

        return before(run)

    monkeypatch.setattr(chat, "lean", lean)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a</turn>"]), rng.choice([None, "", said(3), said(12)]), "f", True, 1) for c in [*range(12), None] for t in range(rng.randrange(1, 9))]
    rows += [(99, None, "user", "first", "f", True, 1), (99, 1, "assistant", said(3000), "f", True, 1)]
    rows += [(7, 3, "assistant", "again", "f", True, 1)] * 3 + [(7, 3, "user", "tie", "f", True, 1)]
    rows += [(50, t, "assistant" if t % 2 else "user", said(5), "f", True, 1) for t in range(400)]  # a third of all rows and more
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss boolean, place bigint").repartition(5)
    parts = chat.formatted(df).persist()
    got = {r["conv_id"]: r for r in chat.digests(parts).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    by_conv = {c: sorted((r for r in rows if r[0] == c), key=key) for c in {r[0] for r in rows}}
    assert set(got) == set(by_conv)
    for c, own in by_conv.items():
        assert tuple(got[c])[1:5] == digest(own)
    whole, control = chat.encoder("byte_bpe_50k.json")
    for c, own in by_conv.items():
        shown = chat.rendered([(r[2] or "", r[3] or "") for r in own], control)[0]
        ids = [i for p in sorted(parts.where(F.col("conv_id").eqNullSafe(c)).collect(), key=lambda p: p["place"]) for i in p["token_ids"]]
        assert got[c]["formatted_chars"] == len(shown) and ids == whole.encode(shown, add_special_tokens=False).ids
    assert parts.where("conv_id = 50").count() > 3
    assert chat.digests(chat.formatted(df.where("false"))).count() == 0


def test_token_mask():
    tokens = np.array([(0, 2), (2, 2), (2, 5), (5, 6), (5, 6), (6, 9)])
    assert chat.token_mask(tokens, np.array([(1, 3), (5, 6)])).tolist() == [True, False, True, True, True, False]
    assert not chat.token_mask(tokens, np.zeros((0, 2), int)).any() and not len(chat.token_mask(np.zeros((0, 2), int), np.array([(0, 1)])))
    with pytest.raises(ValueError):
        chat.control_pattern(["a\\b"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_control_conversation(spark):
    r = queries.op13_chat_format(spark, SF).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert tuple(r)[:5] == (-7, *digest([(0, 0, "user", text), (0, 1, "assistant", text)]))

