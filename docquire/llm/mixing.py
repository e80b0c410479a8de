"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source the documents are ordered
by that key; a distributed prefix sum of sizes along that order gives every document
its interval of words, and the source's budget cuts that order at an exact word.
Budgets above the source's own size repeat whole epochs first.

The prefix sums have two levels. The uniform key splits a source with n rows into
about sqrt(n) key ranges of about sqrt(n) rows: a window inside a range adds up its rows,
a window over the ranges' totals adds up the ranges. So neither level ever holds more
than about sqrt(n) rows in one task, whatever share of all rows a source has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, settle, small, table, word_count


def mix_key(doc_id: Column, text: Column, seed: str) -> Column:
    """60 random bits that depend on the seed and the id; where there is none, on the text, so that rows without ids don't meet in one range."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("").cast("binary")))))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """One row per source: n_rows, source_size, target.

    Sources take the weights in code point order, null last, over and over. Each
    target is its weight's share of all sizes. A target above ``max_repeat`` times its
    source's size stops there and the excess goes to the others by weight: with the
    sources sorted by size per weight, those that stop come first, and the level is what
    remains per remaining weight. The windows here run over one row per source.
    """
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    stats = stats.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    stats = stats.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    stats = stats.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * max_repeat).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("stopped"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.row_number().over(order).alias("place"),
    ).withColumn("level", (F.col("total") - F.col("stopped")) / F.col("rest"))
    open_ = F.col("source_size") * max_repeat > F.col("level") * F.col("weight")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("place"))).over(Window.partitionBy())
    stats = stats.withColumn("common", level)
    cap = (F.col("source_size") * max_repeat).cast("double")
    target = F.coalesce(F.least(cap, F.col("common") * F.col("weight")), cap)
    return stats.select("source", F.col("rank").alias("source_rank"), "n_rows", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """What the mix takes of each document.

    Returns one row per input row: ``doc_id, size, source_size, target, copies`` (whole
    copies), ``cut`` (words of one more, partial copy) and ``taken`` = copies * size + cut,
    then a struct ``row`` of the ``carry`` columns.

    Null texts and texts without words have size 0 and are taken 0 times. A null source is
    a source like any other, last in order. Ties of the key (equal ids, or equal texts without ids) are ordered by
    size and text hash; wholly equal rows are interchangeable. An empty table gives
    no rows. Other columns are ignored unless carried, so their names never clash.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        mix_key(F.col(id_col), F.col(text_col).cast("binary"), seed).alias("key"),
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    )
    sized = settle(source.drop("row"), "mix-sizes")
    targets = small(settle(source_targets(sized, weights, max_repeat), "mix-targets"))

    def ranged(df: DataFrame) -> DataFrame:
        joined = df.join(targets, df["source"].eqNullSafe(targets["source"])).drop("source")
        ranges = F.ceil(F.sqrt(F.col("n_rows").cast("double"))).cast("long")
        return joined.withColumn("range", F.shiftright(F.shiftright(F.col("key"), 29) * ranges, 31))

    totals = ranged(sized).groupBy("source_rank", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source_rank", "range", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("start"))

    rows = ranged(source if carry else sized).join(starts, ["source_rank", "range"])
    inside = Window.partitionBy("source_rank", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rows = rows.withColumn("before", before)
    budget = F.floor(F.col("target")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    left = budget - copies * F.col("source_size") - F.col("before")
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        "cut",
        (F.col("copies") * F.col("size") + F.col("cut")).alias("taken"),
        *(["row"] if carry else []),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as the mix takes it.

    The document at a source's cut keeps only the words before the cut, and its
    ``chars_col`` is counted anew. Documents of which nothing is taken are absent.
    """
    plan = mix(docs, text_col=text_col, carry=docs.columns, **how)
    whole = F.array_repeat(F.lit(-1).cast("long"), (F.col("copies") + (F.col("cut") == F.col("size")).cast("long") * (F.col("cut") > 0).cast("long")).cast("int"))
    part = F.when((F.col("cut") > 0) & (F.col("cut") < F.col("size")), F.array(F.col("cut"))).otherwise(F.array().cast("array<long>"))
    rows = plan.select("row", F.explode(F.concat(whole, part)).alias("keep"))
    text = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(r"((?:^[\x20\x09-\x0D]*)?[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+)?)"), F.lit(1))
    short = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), F.col("keep").cast("int")), ""), SPACE + "$", "")
    rows = rows.withColumn("new_text", F.when(F.col("keep") < 0, text).otherwise(short))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("new_text").alias(c))
        elif c == chars_col:
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("keep") < 0, F.col(f"row.{c}")).otherwise(F.length("new_text").cast(kind)).alias(c))
        else:
            out.append(F.col(f"row.{c}").alias(c))
    return rows.select(*out)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", spread=False)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key
  FROM documents),
stats AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + rank % 3 AS weight FROM stats),
levels AS (
  SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, rank)),
common AS (SELECT arg_min(level, place) AS level FROM levels WHERE 3 * source_size > level * weight),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), common.level * weight), CAST(3 * source_size AS DOUBLE)) AS target
  FROM levels LEFT JOIN common ON TRUE),
placed AS (
  SELECT doc_id, size, source_size, target,
         CAST(coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS copies
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - copies * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
