"""Removal of word windows that a document with a smaller id has as well.

First pass: every partition counts its windows in a count-min sketch; the sketches are merged. An estimate is never below
the true count, so a window estimated once is unique in the corpus. Second pass: only windows
estimated repeated are grouped exactly. None is lost, and what the sketch lets through
wrongly only costs time.

A window is counted by its minimizer, the least hash among its runs of ANCHOR words. Equal windows have equal
minimizers, and neighbouring windows mostly share one, so the sketch holds about a third as many keys.

Words are named by 128 bits of BLAKE2b, once for each different word of a batch; a window's name is made of two
independent sums, each over one half of its words' names. Documents whose whole text a smaller id has are settled by their
text's hash before windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytehash as B
from .common import by_text, free, settle, small, table, tidy
from .sketch import MOST_CELLS, SHARD_CELLS, Test, named, scan_repeated

U = np.uint64
WINDOW, ANCHOR = 13, 8
#: Words of a passage that is told if documents share it.
PASSAGE = 51
#: Of the sketch.
BYTES_PER_KEY, CELLS_PER_KEY = 20, 3
LAST = (1 << 63) - 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, flat, and where each text's begin; and the end of the last one's."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, upto = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    solid = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(solid), np.concatenate([[0], np.cumsum(solid.to_numpy(zero_copy_only=False))])[upto]


def word_names(words: pa.Array) -> np.ndarray:
    """128 bits [n, 2] for each word; equal words have equal ones, and others not but by an accident of the digest."""
    coded = words.dictionary_encode()
    raw = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.cast(pa.large_binary()).to_pylist()])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)[coded.indices.to_numpy()]


class Windows:
    """All windows of the words of some texts: ``start`` and ``owner`` of each, its ``anchor``, and where a new one begins."""

    def __init__(self, texts: pa.Array, window: int):
        self.window, (self.words, self.bounds) = window, split_words(texts)
        self.names = word_names(self.words)
        n, size = len(self.names), min(ANCHOR, window)
        owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        ok = owner[: max(n - window + 1, 0)] == owner[window - 1 :]
        self.start = np.flatnonzero(ok)
        self.owner = owner[self.start]
        grams = B.word_windows(self.names[:, 0], size, B.SECOND_ROLL)
        best, at = grams[: len(ok)].copy(), np.arange(len(ok))
        for s in range(1, window - size + 1):
            other = grams[s : s + len(ok)]
            less = other < best
            best[less] = other[less]
            at[less] = np.flatnonzero(less) + s
        self.anchor = best[self.start]
        self.new = np.diff(at[self.start], prepend=-1) != 0

    def keys(self) -> np.ndarray:
        return self.anchor[self.new]

    def candidates(self, test: Test) -> np.ndarray:
        """Which windows may be repeated."""
        return test(self.keys())[np.cumsum(self.new) - 1] if len(self.start) else np.zeros(0, bool)

    def named(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of name of some windows."""
        start = self.start[which]
        roll = lambda r, half: r.windows(r.prefix(self.names[:, half]), start, start + self.window)
        return roll(B.WORD_ROLL, 0).view(np.int64), (roll(B.BYTE_ROLL, 1) >> U(32)).astype(np.uint32).view(np.int32)


def _joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The words of each text, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.cast(pa.string())), " ")


def _shas(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string())


def _in_passages(starts: Column, window: int, passage: int) -> Column:
    """Words in runs of neighbouring windows, given by their starts in order, that hold ``passage`` words at least."""
    words = lambda a: F.when(a["last"] - a["first"] + window >= passage, a["last"] - a["first"] + window).otherwise(0)
    zero = F.struct(F.lit(0).alias("first"), F.lit(-window).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x == a["last"] + 1, F.struct(a["first"].alias("first"), x.alias("last"), a["n"].alias("n"))).otherwise(F.struct(x.alias("first"), x.alias("last"), (a["n"] + words(a)).alias("n")))
    return F.aggregate(starts, zero, step, lambda a: a["n"] + words(a)).cast("long")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, most_cells: int = MOST_CELLS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """What remains of each document.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept_sha256, n_passage`` (and ``kept``, the remaining words joined by one
    space, if ``keep_text``). A word goes if a window of ``window`` words around it also starts in a document with a smaller id.
    ``n_passage`` tells of long passages whoever keeps them: the words of all runs of PASSAGE words or more whose windows documents with other ids have as well, summed up.
    Null and empty texts have no words. A null id is larger than all others and equal to other null ids; rows that share an id
    never remove from each other. An empty table gives no rows. Only the named columns are read. A text is processed whole, in
    about 60 times its bytes of a worker's memory; texts of 2 GB or more are beyond Arrow's arrays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("name"), text.alias("text"))

    def scan(batch: pa.RecordBatch, test: Test) -> Iterator[pa.RecordBatch]:
        n, windows = batch.num_rows, Windows(batch.column("text"), window)
        found = np.flatnonzero(windows.candidates(test))
        owner, (h, c) = windows.owner[found], windows.named(found)
        at = (windows.start[found] - windows.bounds[owner]).astype(np.int32)
        # of equal windows met here, only those of the least id are sent on: for the others it is settled
        rank = batch.column("doc_id").fill_null(LAST).to_numpy()[owner]
        order = np.lexsort((rank, c, h))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)
        sure, also = np.zeros(len(order), bool), np.zeros(len(order), bool)
        if len(order):
            group, first, ranked = np.cumsum(new) - 1, np.flatnonzero(new), rank[order]
            sure[order] = ranked > ranked[first][group]
            also[order] = (ranked == ranked[first][group]) & (ranked[np.append(first[1:], len(order)) - 1] > ranked[first])[group]
        lists = [by_text(x[~sure], owner[~sure], n) for x in (at, h, c)]
        columns = [pa.array(np.diff(windows.bounds)), _shas(_joined(windows.words, windows.bounds)), *lists, by_text(at[sure], owner[sure], n), by_text(at[also], owner[also], n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), *columns], names=["doc_id", "name", "n_words", "sha", "at", "h", "c", "sure", "also"])

    keys = lambda texts: Windows(texts, window).keys()
    schema = "doc_id long, name binary, n_words long, sha string, at array<int>, h array<long>, c array<int>, sure array<int>, also array<int>"
    scanned = scan_repeated(source, keys, scan, schema, BYTES_PER_KEY, CELLS_PER_KEY, most_cells, shard_cells)
    numbered = settle(scanned.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("doc_id", F.lit(LAST)).alias("rank"), "*"), "windows")
    free(scanned)
    # of a text that several rows have, the first of the least id stands for all of that id, or without a window for all; the others go as a whole
    copies = numbered.groupBy("name").agg(F.min(F.struct("rank", "rid")).alias("first"), F.max("rank").alias("most"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = settle(copies.select("name", F.col("first.rank").alias("least"), "most", F.col("first.rid").alias("rep")), "copies")
    marked = numbered.join(small(copies), "name", "left")
    goes = F.coalesce(F.col("rank") > F.col("least"), F.lit(False)) & (F.col("n_words") >= window)
    marked = marked.withColumn("rep", F.when(~goes, F.coalesce("rep", "rid")))
    # exact grouping of what the sketch lets through, one exchange; a key has at most one id for each batch, and a window of rows spills
    once = marked.filter(F.col("rep") == F.col("rid"))
    rows = once.filter(F.col("h").isNotNull()).select("rid", "rank", F.explode(F.arrays_zip("h", "c", "at")).alias("x")).select("rid", "rank", "x.h", "x.c", "x.at")
    alike = Window.partitionBy("h", "c")
    two = rows.select("rid", "rank", "at", F.min("rank").over(alike).alias("least"), F.max("rank").over(alike).alias("most")).filter("least < most")
    goes = F.col("rank") > F.col("least")
    gone = two.groupBy("rid").agg(F.collect_list(F.when(goes, F.col("at"))).alias("gone"), F.collect_list(F.when(~goes, F.col("at"))).alias("held"))
    gone = settle(gone.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone"))), "gone")
    starts = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<int>")) for x in ("sure", "also", "gone", "held")])))
    told = once.select("rid", "sure", "also").join(gone, "rid", "left").select(F.col("rid").alias("rep"), _in_passages(starts, window, PASSAGE).alias("told"))
    told = settle(told.filter("told > 0"), "told")
    wanted = once.select("rid", "doc_id", "name", "sure").join(gone.drop("held"), "rid", "left")
    wanted = settle(wanted if keep_text else wanted.filter(F.col("gone").isNotNull() | F.col("sure").isNotNull()), "wanted")
    rows = settle(marked.select("rid", "rep", "doc_id", "n_words", "sha", (F.col("least") < F.col("most")).alias("shared")), "rows")
    free(numbered, copies, gone)
    texts = named(source, wanted)
    same = (wanted["name"] == texts["name"]) & wanted["doc_id"].eqNullSafe(texts["doc_id"])
    todo = wanted.join(texts, same).select("rid", "sure", "gone", "text")

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = split_words(batch.column("text"))
            edge = np.zeros(len(words) + 1, np.int32)
            for lists in (batch.column("sure"), batch.column("gone")):
                owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                start = bounds[owner] + lists.flatten().to_numpy()
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
            stays = np.cumsum(edge)[:-1] == 0
            upto = np.concatenate([[0], np.cumsum(stays)])[bounds]
            kept = _joined(words.filter(pa.array(stays)), upto)
            removed = pa.array(np.diff(bounds) - np.diff(upto))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), removed, _shas(kept), *[kept] * keep_text], names=["rep", "n_removed", "left", *["kept"] * keep_text])

    done = todo.mapInArrow(finish, "rep long, n_removed long, left string" + ", kept string" * keep_text)
    done = settle(done.dropDuplicates(["rep"]), "done")  # two rows of one text and id may meet in ``texts``; they are equal
    free(wanted)
    out = rows.join(done, "rep", "left").join(told, "rep", "left")
    whole = F.col("rep").isNull()
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(F.col("shared"), F.when(F.col("n_words") >= PASSAGE, F.col("n_words")).otherwise(0)).otherwise(F.coalesce("told", F.lit(0))).cast("long").alias("n_passage"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
o AS (SELECT g, min(doc_id) AS least, max(doc_id) AS most FROM w GROUP BY g),
shared AS (SELECT rid, doc_id, i, least FROM w JOIN o USING (g) WHERE least < most),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS k FROM shared WHERE doc_id > least),
x AS (SELECT rid, ws[k] AS word, k FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)),
kept AS (
  SELECT x.rid, count(gone.k) AS n, string_agg(word, ' ' ORDER BY x.k) FILTER (gone.k IS NULL) AS text
  FROM x LEFT JOIN gone ON x.rid = gone.rid AND x.k = gone.k GROUP BY x.rid),
runs AS (SELECT rid, count(*) + 12 AS n FROM (SELECT rid, i, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS run FROM shared) GROUP BY rid, run),
told AS (SELECT rid, sum(n) AS n FROM runs WHERE n >= 51 GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256,
       CAST(coalesce(told.n, 0) AS BIGINT) AS n_passage
FROM d LEFT JOIN kept USING (rid) LEFT JOIN told USING (rid)
"""
