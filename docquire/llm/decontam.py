"""Benchmark decontamination by a prefix-filtered join.

A document is hit where it contains a window of an item: a run of ``window`` consecutive item words,
or the whole of a shorter item. Containing a window means containing all of its word
shingles, so a prefix of one shingle suffices: the window's rarest by corpus frequency.
Only document positions that carry such a shingle become candidates; length and
position bounds drop those whose window would leave the document, and the rest are verified word by word.
Candidates are made and verified inside one stage of the scan, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, settle, small, table, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, on which several threads spend five times as long (Java 17).
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SHINGLE = 3
#: The same words in a text lowered by Spark, which also lowers other letters but moves no word's ends.
LOWERED = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: The one other letter whose lower case is in a-z.
KELVIN = "\u212a"


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def lowered(text: Column) -> Column:
    """All letters lowered, each alike wherever it stands: a sigma is lowered by its neighbours, so its final form becomes the other."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def lowered_tokens(text: Column) -> Column:
    """The words of the lowered text: as many as ``tokens``, cheaper, equal where those are."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(f"({LOWERED})"), F.lit(1)), F.array().cast("array<string>"))


def item_windows(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``win`` (words), ``len`` and ``items``, the ids as strings. Null ids count as empty strings."""
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), tokens(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - window, F.lit(0))
    at = F.explode(F.sequence(F.lit(0), last)).alias("at")
    wins = items.select("item", "ws", at).select("item", F.slice("ws", F.col("at") + 1, F.lit(window)).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("win"))


def _shingle(ws: Column, at: Column, first: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), first, *[F.get(ws, at + i) for i in range(1, size)])


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word position and shingle size, with the shingle's hash."""
    rows = docs.select("*", F.posexplode("ws").alias("at", "word"))
    hashes = [_shingle(F.col("ws"), F.col("at"), F.col("word"), s) for s in sizes]
    if len(sizes) == 1:
        return rows.select(*docs.columns, "at", hashes[0].alias("shingle"))
    return rows.select(*docs.columns, "at", F.explode(F.array(*hashes)).alias("shingle"))


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    contaminated_share: int = 20,
) -> DataFrame:
    """Which documents hold benchmark passages.

    Returns one row per input row: ``doc_id, key`` (hash of the text), ``n_words, n_hit, n_items,
    items_sha256, contaminated``; contaminated means n_hit > 0 and ``contaminated_share`` * n_hit >= n_words.

    Null and empty texts have no words and are never contaminated; items without words
    match nothing; an empty benchmark leaves all clean; repeated rows get equal rows. Only the named columns are read.
    The windows are broadcast if their measured size is small, else in blocks, each against all documents. A text is processed whole, as an array of its words.
    """
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text.alias("text"), lowered_tokens(text).alias("ws"))
    counted = docs.select(
        F.col(id_col).alias("doc_id"), text_key(text).alias("key"), F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_words")
    )
    wins = item_windows(bench, item_col, item_text_col, window).withColumn("low", F.transform("win", lowered))
    wins = settle(wins.withColumn("plain", ~F.exists("win", lambda w: w.rlike(r"[^\x00-\x7F]"))).withColumn("wid", F.monotonically_increasing_id()), "windows")
    sizes = [r[0] for r in wins.select(F.least(F.col("len"), F.lit(SHINGLE)).alias("s")).distinct().collect()]  # at most SHINGLE rows
    found = None
    if sizes:
        size = F.least(F.col("len"), F.lit(SHINGLE))
        parts = F.transform(
            F.sequence(F.lit(0), F.col("len") - size),
            lambda i: F.struct(
                F.when(size == 1, _shingle(F.col("low"), i, F.get("low", i), 1)).when(size == 2, _shingle(F.col("low"), i, F.get("low", i), 2)).otherwise(_shingle(F.col("low"), i, F.get("low", i), 3)).alias("shingle"),
                i.alias("offset"),
            ),
        )
        shingles = settle(wins.select("wid", F.explode(parts).alias("x")).select("wid", "x.*"), "shingles")
        # rarity: how often the corpus has each shingle of the windows
        names = settle(shingles.select("shingle").distinct(), "shingle-names")
        counts = None
        for block in blocks(names, "shingle"):
            c = _positions(source.select("ws"), sizes).join(block, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
            counts = c if counts is None else counts.unionByName(c)
        counts = settle(counts, "rarity")
        ranked = shingles.join(counts, "shingle", "left")
        rarest = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("x"))
        # a shingle that the corpus lacks rules its window out
        prefix = rarest.filter(F.col("x.n") > 0).select("wid", "x.shingle", "x.offset")
        keyed = settle(prefix.join(wins, "wid").select("shingle", "offset", "win", "low", "plain", "len", "items"), "prefixes")
        for block in blocks(keyed, "shingle"):
            hit = _positions(source, sizes).join(block, "shingle")
            start = F.col("at") - F.col("offset")
            hit = hit.filter((start >= 0) & (start + F.col("len") <= F.size("ws")))
            hit = hit.filter(F.slice("ws", start + 1, F.col("len")) == F.col("low"))
            # lowered words may be equal where other letters than A-Z differ in case
            exact = F.slice(tokens(F.col("text")), start + 1, F.col("len")) == F.col("win")
            hit = hit.filter(F.when(~F.col("plain") | F.contains("text", F.lit(KELVIN)), exact).otherwise(F.lit(True)))
            hit = hit.select("doc_id", "key", start.alias("start"), "len", "items")
            found = hit if found is None else found.unionByName(hit)
        found = found.groupBy("doc_id", "key").agg(
            F.collect_set(F.struct("start", "len")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")
        )
        found = found.select("doc_id", "key", F.aggregate(F.sort_array("spans"), zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), "items")
        same = counted["doc_id"].eqNullSafe(found["doc_id"]) & (counted["key"] == found["key"])
        rows = counted.join(found, same, "left").select(counted["doc_id"], counted["key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items")
    else:
        rows = counted.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "key",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (contaminated_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, in all their columns.

    Null and empty texts stay. Rows that share id and text stay or go alike. An empty table stays empty, and an empty benchmark leaves all.
    """
    bad = decontaminate(docs, bench, id_col, text_col, **how).filter("contaminated")
    bad = small(settle(bad.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")), "contaminated"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (text_key(docs[text_col]) == bad["_bad_key"]), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark", spread=False)).drop("key")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT DISTINCT rid, i, n, win FROM grams WHERE win IN (SELECT win FROM wins)),
covered AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits JOIN wins USING (win) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
