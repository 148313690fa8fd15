"""URL filters with DataFrame functions alone: given rules, then association rules mined by Spark's FP-growth.

URLs become tokens (host labels, their suffixes, path words, numbers as one token). Labelled URLs are transactions with
their label as one more item; frequent sets give rules of at most `max_tokens` tokens that end in a label, kept if
confidence and support reach the bounds and no shorter rule of the same verdict is as confident. Support is at least
`min_support` of the labelled URLs and `min_count` of them.

Three steps keep the mining small and lose no rule. Tokens rarer than the least support go. A token that only one label has
is a rule by itself, and no longer one with it could be kept, so it goes from the transactions. Tokens that always occur
together are one item, and its rules stand for each of them. FP-growth lists every set of a transaction, 2^n of n items, so
labelled URLs with more than `MAX_ITEMS` items are left out of it: their sets of up to `max_tokens` items are listed and
counted, those that FP-growth has not found are counted in the other URLs too, and both counts are added before support and
confidence are judged. The result is that of all URLs together. max_tokens = None finds rules of any length and gives
FP-growth all URLs, whatever that takes.

Rules are matched by an inverted index from the tokens of their rarest item to the rules: a rule fires where each of its
items has a token in the URL. The most confident fires first, then the longer, the better supported, and the lesser text;
where none fires the verdict is allow.

Defined results: a null URL or one without '://' has an empty host and path, no tokens and the default verdict; null
labels are ignored; repeated rows count and are judged each; without labels there are no mined rules; an empty table gives
no rows; further columns are ignored. A very long URL is one row like any other, with a token for each distinct word.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, written

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 5, 0.9, 3
#: Items of a transaction beyond which its sets are counted apart.
MAX_ITEMS = 16
LABEL = "label="
#: At most so many rows of the index travel to all tasks; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
# The contract's rules, host and path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, LETTERS, LETTERS.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host and its last two, words of the path, '#' for numbers."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(path, r"[^A-Za-z0-9]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("path=#")).otherwise(F.concat(F.lit("path="), F.lower(x))))
    top = F.concat(F.lit("top="), F.element_at(F.split(host, r"\."), -1))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("host="), x)), words, F.when(host != "", F.array(top)).otherwise(F.array().cast("array<string>"))))


def frequent_tokens(rows: DataFrame, least: int) -> DataFrame:
    """token, n, pure (the only verdict, or null) and item (the least of the tokens that occur in the same rows) of the
    tokens in at least `least` rows. rows: uid, tokens, verdict."""
    counted = rows.select("uid", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min("verdict").alias("low"), F.max("verdict").alias("high"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("rows_of"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("mark")
    )
    counted = written(counted.where(F.col("n") >= least).select("token", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("pure"), "rows_of", "mark"), "tokens")
    items = counted.groupBy("n", "rows_of", "mark").agg(F.min("token").alias("item"))
    return counted.join(items, ["n", "rows_of", "mark"]).select("token", "n", "pure", "item")


def listed_sets(rows: DataFrame, most: int) -> DataFrame:
    """heads (sorted) and verdict of each set of 1 to `most` items of each row. rows: items array<string>, verdict."""
    rows = rows.select("verdict", F.array_sort("items").alias("items"), F.array().cast("array<string>").alias("heads"), F.lit(0).alias("last"))
    found = None
    for _ in range(most):
        rows = rows.where(F.col("last") < F.size("items")).withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.size("items"))))
        rows = rows.withColumn("heads", F.array_append("heads", F.element_at("items", F.col("last"))))
        found = rows.select("heads", "verdict") if found is None else found.unionByName(rows.select("heads", "verdict"))
    return found


def _set_counts(held: DataFrame, labels: DataFrame, least: int, max_tokens: int | None) -> DataFrame:
    """heads, verdict, n_both (rows with the set and the verdict) and n_all (rows with the set) of the sets whose n_both may
    reach `least`. held: uid, verdict, items; labels: uid, verdict of all labelled rows."""
    is_long = F.size("items") > MAX_ITEMS
    n_long = held.where(is_long).count() if max_tokens is not None else 0
    short = held.where(~is_long) if n_long else held
    transactions = labels.join(held.where(is_long).select("uid"), "uid", "left_anti") if n_long else labels
    transactions = transactions.join(short.select("uid", "items"), "uid", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    n_short = labels.count() - n_long
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(n_short, 1))).fit(transactions).freqItemsets
    is_label = lambda t: t.startswith(LABEL)
    sets = sets.select(F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("heads"), F.substring(F.try_element_at(F.filter("items", is_label), F.lit(1)), len(LABEL) + 1, 100).alias("verdict"), F.col("freq").alias("n"))
    sets = sets.where("size(heads) > 0" if max_tokens is None else f"size(heads) BETWEEN 1 AND {max_tokens}")
    sets = written(sets, "sets")
    known = sets.where("verdict IS NOT NULL").withColumnRenamed("n", "n_both").join(sets.where("verdict IS NULL").select("heads", F.col("n").alias("n_all")), "heads")
    if not n_long:
        return known
    counted = written(listed_sets(held.where(is_long), max_tokens).groupBy("heads", "verdict").agg(F.count(F.lit(1)).alias("n_both")), "long-sets")
    pairs = known.select("heads", "verdict")
    more = counted.join(pairs, ["heads", "verdict"], "left_anti").select("heads").distinct().withColumn("token", F.element_at("heads", 1))
    again = short.select("verdict", "items", F.explode("items").alias("token")).join(more, "token").where(F.size(F.array_except("heads", "items")) == 0)
    again = written(again.groupBy("heads", "verdict").agg(F.count(F.lit(1)).alias("n_both")), "counted-again")
    all_of = lambda df: df.groupBy("heads").agg(F.sum("n_both").alias("n_all"))
    totals = known.select("heads", "n_all").distinct().unionByName(all_of(again.join(pairs.select("heads").distinct(), "heads", "left_anti"))).unionByName(all_of(counted))
    both = known.select("heads", "verdict", "n_both").unionByName(again.join(pairs, ["heads", "verdict"], "left_anti")).unionByName(counted)
    both = both.groupBy("heads", "verdict").agg(F.sum("n_both").alias("n_both"))
    return both.join(totals.groupBy("heads").agg(F.sum("n_all").alias("n_all")), "heads")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int | None = MAX_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """rule_id, items array<array<string>> (the rarest first), verdict, confidence and support. labelled: uid, tokens
    array<string> (distinct), verdict."""
    rows = labelled.where("verdict IS NOT NULL").select("uid", "tokens", "verdict")
    total = rows.count()
    least = max(min_count, -int(-min_support * total // 1))
    tokens = written(frequent_tokens(rows, least), "frequent")
    alone = tokens.where("pure IS NOT NULL").select(F.array(F.array("token")).alias("items"), F.col("pure").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n") / total).alias("support"))
    heads = tokens.where("pure IS NULL AND token = item").select("token")
    held = rows.select("uid", "verdict", F.explode("tokens").alias("token")).join(heads, "token")
    held = written(held.groupBy("uid", "verdict").agg(F.collect_list("token").alias("items")), "held")
    counts = _set_counts(held, rows.select("uid", "verdict"), least, max_tokens).where(F.col("n_both") >= least)
    rules = counts.withColumn("confidence", F.col("n_both") / F.col("n_all")).where(F.col("confidence") >= min_confidence)
    rules = written(rules.select("heads", "verdict", "confidence", (F.col("n_both") / total).alias("support")), "mined")
    # A rule goes if one with a part of its items, found by any of them, is as confident.
    short = rules.select(F.col("heads").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"), F.element_at("heads", 1).alias("head"))
    worse = rules.withColumn("head", F.explode("heads")).join(short, "head").where((F.col("verdict") == F.col("same")) & (F.size("part") < F.size("heads")) & (F.size(F.array_except("part", "heads")) == 0) & (F.col("sure") >= F.col("confidence")))
    kept = rules.join(worse.select("heads", "verdict").distinct(), ["heads", "verdict"], "left_anti").withColumn("head", F.explode("heads"))
    together = tokens.groupBy(F.col("item").alias("head")).agg(F.array_sort(F.collect_set("token")).alias("own"), F.first("n").alias("n"))  # of items with a token of the mined URLs
    kept = kept.join(together, "head").groupBy("heads", "verdict", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("n", "own"))).alias("parts"))
    kept = kept.select(F.transform("parts", lambda p: p["own"]).alias("items"), "verdict", "confidence", "support").unionByName(alone)
    return kept.withColumn("rule_id", F.array_join(F.transform("items", lambda x: F.array_join(x, "|")), " "))


def judged(pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence; the given rules label the URLs that rules are mined from."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = written(rows.withColumn("given", fitting_rule(F.col("host"), F.col("path"))).withColumn("tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("uid", F.monotonically_increasing_id()), "urls")
    rules = written(mined_rules(rows.select("uid", "tokens", F.col("given.verdict").alias("verdict")), min_support, min_confidence, min_count=min_count), "rules")
    index = rules.select("rule_id", "items", "verdict", "confidence", "support", F.explode(F.element_at("items", 1)).alias("token"))
    index = written(index, "index")
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    hits = rows.where("given IS NULL").select("uid", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fired = hits.where(F.forall("items", lambda own: F.arrays_overlap(own, F.col("tokens"))))
    best = fired.groupBy("uid").agg(F.max(F.struct("confidence", F.size("items").alias("n"), "support", "verdict", "rule_id")).alias("best"))
    discard(rules)
    return rows.join(best, "uid", "left").select(
        "page_id",
        "host",
        "path",
        F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.rule_id").alias("mined_rule"),
        F.col("best.confidence").alias("confidence"),
    )
