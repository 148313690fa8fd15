"""URL rules with over-long URLs, and verdicts, against brute force."""

import itertools
import random
import re

import pytest

from evtlake.llm import url_rules
from tests.llm.test_training import brute_rules


@pytest.mark.parametrize("seed", range(3))
def test_rules_with_long_urls_equal_brute_force(spark, monkeypatch, seed):
    """Most sets need the counts of short and long rows together."""
    monkeypatch.setattr(url_rules, "MAX_ITEMS", 4)
    r = random.Random(seed)
    rows = []
    for _ in range(120):
        t = {f"t{i}" for i in range(9) if r.random() < (0.75 if r.random() < 0.3 else 0.35)}
        rows.append((sorted(t), None if r.random() < 0.1 else "block" if {"t1", "t2"} <= t or "t3" in t and r.random() < 0.9 else "allow"))
    assert sum(len(t) > 4 for t, _ in rows) > 20
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "uid bigint, tokens array<string>, verdict string")
    for most in (3, None):
        got = {}
        for x in url_rules.mined_rules(df, 0.02, 0.8, most, min_count=3).collect():
            for combo in itertools.product(*x["items"]):
                got[frozenset(combo), x["verdict"]] = x["confidence"], x["support"]
        want = brute_rules(rows, 3, 0.8, most or 9)
        assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k])) and len(got) > 5


def brute_verdicts(urls, min_support, min_confidence, min_count):
    """host, path, rule, verdict and the mined rule's confidence of each URL, from the definitions."""
    rows = []
    for url in urls:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        given = max(((len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)), default=(0, None, None))
        tokens = {f"host={x}" for x in host.split(".") if x} | {"path=#" if x.isdigit() else f"path={x.lower()}" for x in re.split("[^A-Za-z0-9]+", path) if x}
        rows.append((host, path, given[1], given[2], tokens | ({f"top={host.split('.')[-1]}"} if host else set())))
    labelled = [(t, v) for *_, v, t in rows if v]
    least = max(min_count, -int(-min_support * len(labelled) // 1))
    rules = brute_rules(labelled, least, min_confidence)
    out = []
    for host, path, rule, verdict, tokens in rows:
        fired = [(conf, len(c), sup, v) for (c, v), (conf, sup) in rules.items() if c <= tokens] if verdict is None else []
        best = max(fired, default=None)
        tied = {f[3] for f in fired if f[:3] == best[:3]}
        out.append((host, path, rule, verdict or (best[3] if best else "allow"), best and best[0], len(tied) > 1))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(url_rules, "MAX_ITEMS", 5)
    r = random.Random(seed)
    words = ["casino", "bonus", "news", "shop", "es", "fr", "de", "en", "12"]
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['a.', 'b.', ''])}{r.choice(['example.org', 'x.com', 'y.net', 'z.org', 'Shop.net'])}/" + "/".join(r.sample(words, r.choice([1, 2, 3, 7]))) + r.choice(["", "?q=1", "#f"]) for _ in range(160)] + [None, "none", "http://", "a://b"]
    got = {x["page_id"]: x for x in url_rules.judged(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), 0.02, 0.8, 3).collect()}
    for i, (host, path, rule, verdict, confidence, tied) in enumerate(brute_verdicts(urls, 0.02, 0.8, 3)):
        x = got[i]
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert tied or x["verdict"] == verdict
        assert (x["confidence"] is None) == (confidence is None) and (confidence is None or abs(x["confidence"] - confidence) < 1e-9)
    assert any(x["confidence"] and not x["rule"] for x in got.values())


def test_one_long_url_changes_no_other_verdict(spark):
    """300 labelled URLs teach that casino and bonus together are blocked, one word alone is not."""
    urls = [f"http://s{i}.example.org/es/casino/bonus" if i % 3 == 0 else f"http://s{i}.example.com/fr/{'casino' if i % 3 == 1 else 'bonus'}" for i in range(300)]
    common = "/".join(f"w{chr(97 + i)}" for i in range(20))
    urls += [f"http://t{i}.example.{'com/fr' if i % 2 else 'org/es'}/w{chr(97 + i % 20)}" for i in range(400)]
    probe = "http://shop.net/casino/bonus"
    for extra in ([], [f"http://long.example.org/es/{common}/casino"]):
        pages = spark.createDataFrame(list(enumerate([probe, *urls, *extra])), "page_id bigint, url string")
        row = url_rules.judged(pages).where("page_id = 0").first()
        assert (row["verdict"], row["mined_rule"]) == ("block", "path=bonus path=casino")
