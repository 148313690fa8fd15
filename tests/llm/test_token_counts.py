"""The totals of op1_token_counts against brute force."""

import os
import re

import pytest

from evtlake.llm import queries, tokens

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a", "en", " one  two\n"), (2, "b", "fr", " one  two\n"), (3, "a", "en", " \n\t "), (4, "b", "en", None), (5, "a", "fr", None), (6, "a", "en", "plain text"), (6, "a", "en", "plain text"), (None, "b", "fr", "inner\n\nlines"), (None, "b", "fr", "inner\n\nlines"), (7, "c", "en", "")]


def brute(rows):
    count = lambda t: len(tokens.encoder().whole.encode(t, add_special_tokens=False).ids)
    seen, totals = set(), {}
    for doc_id, source, lang, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text not in seen:
            seen.add(text)
            own = totals.setdefault((source, lang), [0, 0])
            own[0] += 1
            own[1] += count(re.sub("^ | $", "", re.sub("[ \t\r\n]+", " ", text or "")))
    return {k: tuple(v) for k, v in totals.items()}


def totals(spark, path):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in queries.op1_token_counts(spark, path).collect()}


def test_small_table(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id bigint, source string, lang string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert totals(spark, str(tmp_path)) == brute(ROWS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_supplied_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "text").collect()]
    assert any(re.search(r"[ \t\r\n]{2}|[\t\r\n]", r[3] or "") for r in rows)  # the revision meets rows
    assert totals(spark, SF) == brute(rows)
