"""The queries op1 to op13 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, divergence, licenses, packing, quality, simhash, substrings, token_rollup, url_rules, warc, winnow
from .store import new_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, later copies of a text deleted, counts of those that stay revised to those with white space
    normalised (runs of it as one space, none outside); the deletes are sent twice and count once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    plain = F.regexp_replace(F.regexp_replace("text", r"[ \t\r\n]+", " "), "^ | $", "")
    docs = docs.withColumn("digest", F.xxhash64("text")).withColumn("size", F.length("text")).withColumn("rest", F.when(plain != F.col("text"), plain))
    docs = docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("changed", F.col("rest").isNotNull())
    counted = token_rollup.token_counts(token_rollup.token_counts(docs), "rest", to="n_rest")
    counted = written(counted.withColumn("tokenizer", F.lit("byte_bpe_50k")), "counted")
    first = written(counted.groupBy("digest", "size").agg(F.min(F.struct("doc_id", "uid"))["uid"].alias("first")).select("first"), "first")
    copies = counted.join(first, counted["uid"] == first["first"], "left_anti")
    stay = counted.join(first, counted["uid"] == first["first"], "left_semi")
    revised = stay.where("changed").select(F.lit("revise").alias("op"), "source", "lang", "tokenizer", F.col("n_rest").alias("n_tokens"), *(F.col(c).alias(f"old_{c}") for c in ("source", "lang", "tokenizer", "n_tokens")))
    revised = revised.where("n_tokens <> old_n_tokens")
    rollup = token_rollup.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit(0, counted.withColumn("op", F.lit("insert")))
    rollup.commit(1, copies.withColumn("op", F.lit("delete")))
    rollup.commit(1, copies.withColumn("op", F.lit("delete")))
    rollup.commit(2, revised)
    return rollup.totals([0, 1, 2])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"), *winnow.DENSE)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as responses: identifier from page_id and URL, the headers that the bytes imply, and one date for the whole
    table, which has none of its own."""
    html = F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("urn:response:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("url", F.lit("")).cast("binary"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string")).alias("http_headers"),
        html.alias("payload"),
    )
    return warc.derivatives(pages)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels"), keep_text=False)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, read back from what was formatted."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    more = more.select(*(F.col(f.name).cast(f.dataType) for f in said.schema))
    return chat.digests(chat.formatted(said.unionByName(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_simhash, op3_winnowing, op4_warc, op5_packing, op6_licenses, op7_quality, op8_substrings, op9_decontamination, op10_urls, op11_collocations, op12_source_divergence, op13_chat_format)
}


def _warc_sql() -> str:
    """Patterns of its own; of the entities those that the supplied pages hold."""
    text = "html"
    for pattern in (r"(?is)<script[ \t\r\n\f/>].*?(?:</script[^<>]*>?|\z)", r"(?is)<style[ \t\r\n\f/>].*?(?:</style[^<>]*>?|\z)", r"(?s)<!--.*?(?:-->|\z)"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    ends = r"(?i)</?(?:p|br|div|li|ul|ol|tr|table|h[1-6]|title|article|section|nav|header|footer|blockquote|pre)(?:[ \t\r\n\f/][^<>]*)?>"
    text = f"regexp_replace(regexp_replace({text}, '{ends}', chr(10), 'g'), '</?[a-zA-Z!?][^<>]*>', ' ', 'g')"
    title = r"regexp_extract(html, '(?is)<title(?:[ \t\r\n\f][^<>]*)?>([^<]*)', 1)"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text, title = (f"replace({x}, '{entity}', '{sign}')" for x in (text, title))
    text = f"regexp_replace({text}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = f"regexp_replace(regexp_replace({title}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g')"
    crlf = "chr(13) || chr(10)"
    # Name-based UUIDs: the digits of MD5 with version 3 and the variant set.
    digits = lambda k, at, n: f"substr(md5('{k} ' || record_id), {at}, {n})"
    variant = lambda k: f"translate({digits(k, 17, 1)}, '0123456789abcdef', '89ab89ab89ab89ab')"
    uuid = lambda k: f"'urn:uuid:' || {digits(k, 1, 8)} || '-' || {digits(k, 9, 4)} || '-3' || {digits(k, 14, 3)} || '-' || {variant(k)} || {digits(k, 18, 3)} || '-' || {digits(k, 21, 12)}"
    return f"""
WITH responses AS (
  SELECT 'urn:response:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || md5(coalesce(url, '')) AS record_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
parsed AS (
  SELECT record_id, target_uri, html, {text} AS text, {title} AS title, regexp_extract(html, '(?is)<html[^<>]* lang="([^"]*)"', 1) AS lang,
    list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '') AS found FROM responses),
linked AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS links FROM parsed),
records AS (
  SELECT *, 'metadata' AS warc_type, {uuid('metadata')} AS record, 'application/warc-fields' AS content_type,
    'title: ' || title || {crlf} || 'language: ' || lang || {crlf} || 'outlinks: ' || len(links) || {crlf} || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {crlf}), ''), '') AS block FROM linked
  UNION ALL BY NAME
  SELECT *, 'conversion' AS warc_type, {uuid('conversion')} AS record, 'text/plain' AS content_type, text AS block FROM linked)
SELECT record AS record_id, warc_type, record_id AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
  CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha1:' || sha1(block) AS block_digest, 'sha1:' || sha1(html) AS source_digest,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(html)) AS source_headers, block
FROM records"""


SQL: dict[str, str] = {
    "op4_warc": _warc_sql(),
    "op8_substrings": r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT uid, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
again AS (SELECT uid, i FROM windows WHERE s IN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT uid, i + k AS i FROM again, unnest(range(0, 35)) AS r(k)),
by_doc AS (SELECT uid, list(i) AS gone FROM gone GROUP BY uid),
marked AS (SELECT d.uid, doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, CASE WHEN gone IS NULL THEN w ELSE NULL END AS whole FROM d LEFT JOIN by_doc USING (uid)),
words AS (SELECT d.uid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d JOIN by_doc USING (uid)),
kept AS (SELECT uid, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (uid, i) GROUP BY uid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(whole, ' '), s, '')) AS kept_sha256
FROM marked LEFT JOIN kept USING (uid)""",
    "op9_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
tests AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM tests),
windows AS (SELECT uid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT uid, i, n, item_id FROM windows JOIN tests USING (n, s)),
hit AS (SELECT uid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS r(k) GROUP BY uid),
items AS (SELECT uid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM found GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid)""",
    # Sub-phrases of up to four words of each piece, their counts, cuts and covers.
    "op11_collocations": r"""
WITH texts AS (SELECT row_number() OVER () AS uid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM texts),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM w, (VALUES (1), (2), (3), (4)) AS ks(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
f AS (SELECT lang, k, s, count(*) AS n FROM grams GROUP BY lang, k, s HAVING count(*) >= 30),
c AS (SELECT lang, k, s, n AS a, string_split(s, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.s, a, cut, x.n AS l, y.n AS r, (2000000 * a::HUGEINT) // (x.n + y.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN f AS x ON x.lang = c.lang AND x.s = array_to_string(c.w[1 : cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.s = array_to_string(c.w[cut + 1 :], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS s, max(a) AS longer FROM (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c WHERE k > 2) AS x, unnest(range(1, k - m + 2)) AS r(i) GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN inside USING (lang, s) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS INTEGER) AS rank, s AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) <= 2000""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT uid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT uid) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counts AS c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM grid GROUP BY ALL),
rates AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p FROM grid JOIN totals USING (lang, source) JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(n) AS m FROM counts GROUP BY ALL),
lang_totals AS (SELECT lang, sum(m) AS total FROM whole GROUP BY lang),
lang_rates AS (SELECT lang, term, 1 + (1000000000 * (m + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS q FROM whole JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM rates AS x JOIN rates AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0) AS value FROM groups AS x JOIN groups AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart AS a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM rates JOIN lang_rates USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 50""",
    # Lengths of the template: 6 for each of its first two marks, 7 for the last.
    "op13_chat_format": r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
sized AS (SELECT *, length(regexp_replace(role || chr(10) || text, '\\|<(turn>|says>|/turn>|\|endoftext\|>)', '\0+', 'g')) - 1 AS shown FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(shown + 19) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
}
