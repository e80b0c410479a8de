"""Quality rules: word statistics and cross-document line frequency.

Base rules look at one document. The corpus rule hashes every normalised line, counts in
how many distinct documents of its host a line stands, removes the lines above the host's
limit, and rejects documents that this depletes. Exact copies of a document count
as one document, so that being copied doesn't turn a text's own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, settle, small, table, text_key, words

SYMBOLS = "[#*$%&|<>]"


def repeated_words(ws: Column) -> Column:
    """Words inside a 3-word window that the text has more than once; ``ws`` is a column of words.

    Windows are compared by 64-bit hash. Sorting (hash, position) pairs puts equal
    windows side by side, so the work is n log n for any text.
    """
    n = F.size(ws)
    grams = F.transform(F.slice(ws, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    return grams


def covered_words(grams: Column, size: int) -> Column:
    """Number of words that windows of ``size`` words with a hash found twice in ``grams`` cover."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # each pair beside its neighbours: equal to one of them means repeated
    n = F.size(grams)
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
    near = F.arrays_zip(pairs.alias("at"), F.concat(none, F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("prev"), F.slice(pairs, F.lit(2), F.greatest(n, F.lit(1))).alias("next"))
    twice = F.filter(near, lambda x: F.coalesce(x["at"]["h"] == x["prev"]["h"], F.lit(False)) | F.coalesce(x["at"]["h"] == x["next"]["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda x: x["at"]["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda a, i: F.struct((i + size).alias("end"), (a["n"] + i + size - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One settled row per document: base columns, and its lines as (hash, words) pairs.

    ``rid`` numbers the rows; as the table is written, the numbers hold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    rows = rows.select("*", words(F.col("text")).alias("ws"))
    rows = rows.select("*", repeated_words(F.col("ws")).alias("grams"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    rows = rows.select(
        "doc_id",
        "host",
        text_key(text).alias("key"),
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), covered_words(F.col("grams"), 3)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("lines"),
    )
    normal = F.transform("lines", lambda x: F.lower(F.btrim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "), F.lit(" "))))
    rows = rows.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), normal.alias("normal")).drop("lines")
    rows = rows.withColumn(
        "lines",
        F.transform("normal", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"))),
    ).drop("normal")
    return settle(rows.withColumn("rid", F.monotonically_increasing_id()), "quality")


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_min_docs: int = 10,
    line_share: float = 0.05,
    max_removed_percent: int = 50,
) -> DataFrame:
    """Verdict on each document.

    A line is boilerplate if the distinct documents of its host that have it are more
    than ``line_min_docs`` and more than ``line_share`` of the host's distinct documents. A document
    is depleted if boilerplate lines hold more than ``max_removed_percent`` of its words.

    Returns one row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_boilerplate_words``. Null and empty texts have no words, so
    they fail the base rules. A null host is a host of its own. Repeated rows get equal
    rows. An empty table gives none. Other columns are not read.
    """
    base = base_statistics(docs, id_col, text_col, host_col)
    lines = base.select("rid", F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name")).alias("host"), "key", F.explode("lines").alias("x"))
    lines = lines.select("rid", "host", "key", "x.line", "x.words")
    host = F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name")).alias("host")
    hosts = base.select(host, "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    # the distinct documents of a line: twice aggregated, each time summed up before the shuffle
    counts = lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("with_line"))
    counts = counts.filter(F.col("with_line") > line_min_docs).join(small(settle(hosts, "hosts")), "host")
    common = settle(counts.filter(F.col("with_line") > line_share * F.col("docs")).select("host", "line"), "lines")
    removed = lines.drop("key").join(small(common), ["host", "line"]).groupBy("rid").agg(F.sum("words").alias("n_boilerplate_words"))
    out = base.drop("lines", "key", "host").join(removed, "rid", "left").drop("rid")
    out = out.withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("n_boilerplate_words") > max_removed_percent * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_boilerplate_words"
    )


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
common AS (
  SELECT l.host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM lines GROUP BY host, norm) l
  JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host WHERE n > 10 AND n > 0.05::DOUBLE * docs),
removed AS (
  SELECT rid, sum(len(string_split(l.norm, ' '))) AS n FROM lines l
  JOIN common c ON l.norm = c.norm AND l.host IS NOT DISTINCT FROM c.host GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_boilerplate_words <= 50 * n_words AS kept,
       n_boilerplate_words
FROM base
"""
