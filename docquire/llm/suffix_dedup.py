"""Removal of byte strings that also start somewhere else in the corpus.

Content decides where a text is cut: a cut stands wherever the hash of the next few bytes says so, so equal strings are cut
alike. The windows of SIZE bytes that first meet a cut fall into blocks of BLOCK neighbours, counted from the cut; equal
windows lie in equal places of their blocks. Repeated intervals are refined in three depths, and what has
become unique is left out of the next:

1. a block's core, the bytes that all its windows share. A count-min sketch rules out most unique ones while scanning.
2. a block's extent, the bytes that any of its windows has. If that repeats, all its windows do.
3. the single windows of blocks whose core has several extents: the ends of repeats.

Windows without a cut near their start are compared singly from the beginning. Interval names are
fingerprints (64 bits for filters, 96 for decisions) instead of ranks in a merged suffix order; the README says why.
They are sums over mixed runs of GRAM bytes, which no arrangement of letters cancels out.

What is equal within a batch is settled there, and one of each goes on; so no name has more rows than there are batches.

Shorter passages that documents share, and that stay, are told as well: the beginnings of the cores that other documents have too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytehash as B
from .common import by_text, free, settle, small, table, tidy
from .sketch import MOST_CELLS, SHARD_CELLS, Test, named, scan_repeated

U = np.uint64
#: Bytes of a repeat; a cut at one in CUT positions by the hash of GRAM bytes; windows farther than REACH before a cut are single.
SIZE, GRAM, CUT, REACH, BLOCK = 400, 8, 64, 383, 48
#: Bytes of a passage that is told if documents share it.
SHARED = 256
#: Of the sketch.
BYTES_PER_KEY, CELLS_PER_KEY = BLOCK // 2, 4


def _data(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)


class Names:
    """Fingerprints of the intervals of a text."""

    def __init__(self, data: np.ndarray, roll: B.Roll):
        grams = np.ndarray(max(len(data) - GRAM + 1, 0), "<u8", np.ascontiguousarray(data).data if len(data) >= GRAM else b"", strides=(1,))
        self.values, self.roll = B.splitmix(grams ^ U(roll.base)), roll
        self.prefix = roll.prefix(self.values)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits for each [start, end); these have GRAM bytes at least."""
        return self.roll.windows(self.prefix, start, end - GRAM + 1) if len(start) else np.zeros(0, np.uint64)


class Cuts:
    """The blocks of one text: ``lo`` and ``hi``, first and last start of its windows of ``size`` bytes, none if ``hi`` is less; ``core``, where the core begins;
    and ``far``, the starts of all other windows. A block of shorter windows has its core's first ``head`` bytes in all of them."""

    def __init__(self, data: np.ndarray, size: int):
        self.data, self.size, last, shared = data, size, len(data) - size, min(SHARED, size)
        self.lo = self.hi = self.first = self.core = self.far = np.zeros(0, np.int64)
        self.block = min(BLOCK, size // 2)
        self.head = shared - min(self.block, shared // 2) + 1
        if len(data) < shared:
            return
        reach = min(REACH, size - GRAM)
        self.names = Names(data, B.BYTE_ROLL)
        at = np.flatnonzero(B.splitmix(self.names.values) % U(CUT) == 0)
        before = np.concatenate([[-1], at[:-1]]) if len(at) else at
        lo, hi = np.maximum(np.maximum(before + 1, at - reach), 0), np.minimum(at, len(data) - shared)
        # windows between the cut before and the reach of this one, and those after the last cut
        start = np.concatenate([before + 1, [at[-1] + 1 if len(at) else 0]])
        end = np.minimum(np.concatenate([at - reach - 1, [last]]), last)
        count = np.maximum(end - start + 1, 0)
        self.far = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        ok = lo <= hi
        at, lo, hi, before = at[ok], lo[ok], hi[ok], before[ok]
        if not len(at):
            return
        # block k has the windows that start k * block to k * block + block - 1 bytes before the cut
        low, high = (at - hi) // self.block, (at - lo) // self.block
        count = high - low + 1
        who = np.repeat(np.arange(len(at)), count)
        k = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        self.core = at[who] - k * self.block
        inside = self.core + self.head <= len(data)
        who, self.core = who[inside], self.core[inside]
        self.lo, self.hi = np.maximum(lo[who], self.core - self.block + 1), np.minimum(np.minimum(hi[who], self.core), last)
        # an extent that begins right after the cut before takes that cut in, so that an equal extent is cut alike
        self.first = np.where((before[who] >= 0) & (self.lo == before[who] + 1), before[who], self.lo)

    def heads(self) -> np.ndarray:
        return self.names(self.core, self.core + self.head) if len(self.core) else np.zeros(0, np.uint64)

    def far_names(self) -> np.ndarray:
        return self.names(self.far, self.far + self.size) if len(self.far) else np.zeros(0, np.uint64)


def _second(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 more bits of name."""
    return (Names(data, B.SECOND_ROLL)(start, end) >> U(32)).astype(np.uint32).view(np.int32)


def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.asarray(p, kind) for p in parts)])


def _settled(names: tuple[np.ndarray, np.ndarray], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of equal names the one at the least place (owner, offset); and which names stand at several places."""
    order = np.lexsort((*place[::-1], *names[::-1]))
    new, other = (np.ones(len(order), bool) for _ in range(2))
    if len(order):
        new[1:] = np.any([np.diff(x[order]) != 0 for x in names], axis=0)
        other[1:] = new[1:] | np.any([np.diff(x[order]) != 0 for x in place], axis=0)
    first, several = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = new
    if len(order):
        group = np.cumsum(new) - 1
        several[order] = (np.bincount(group, other & ~new) > 0)[group]
    return first, several


def _least_owner(names: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each name the least owner of an equal one."""
    _, group = np.unique(names, return_inverse=True)
    least = np.full(group.max(initial=-1) + 1, len(owner) and owner.max())
    np.minimum.at(least, group, owner)
    return least[group]


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most_cells: int = MOST_CELLS, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """What remains of each document.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared``. A byte goes if a string of ``size`` bytes around it
    also starts anywhere else, in the same document or another. Null texts are empty; texts shorter than ``size`` stay whole.
    Repeated rows of at least ``size`` bytes remove each other. Ids are only carried. An empty table gives no rows. Only the named columns are read.

    ``n_shared`` tells of passages that documents share, shorter ones too, which nothing removes: it counts the bytes in strings of SHARED - BLOCK + 1 bytes
    that begin BLOCK, or a multiple of it, before a cut of this document and stand at such a place in another. A passage of SHARED bytes that two documents share
    has one, if there is a cut in its first SHARED - GRAM bytes, as there is in 98 of 100. All bytes of a repeated text count.

    A text is processed whole, in about 60 times its bytes of a worker's memory; texts of 2 GB or more are beyond Arrow's arrays.
    """
    if size < 2 * GRAM:
        raise ValueError(f"repeats have {2 * GRAM} bytes at least")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("name"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def keys(texts: pa.Array) -> np.ndarray:
        found = []
        for text in texts:
            cuts = Cuts(_data(text), size)
            found += [cuts.heads(), cuts.far_names()]
        return _flat(found, np.uint64)

    def scan(batch: pa.RecordBatch, test: Test) -> Iterator[pa.RecordBatch]:
        n, shas = batch.num_rows, []
        block: list[list] = [[] for _ in range(6)]  # owner, lo, hi, core's name, extent's two names
        head: list[list] = [[] for _ in range(3)]  # owner, start, name
        far: list[list] = [[] for _ in range(4)]  # owner, start, two names
        for i, text in enumerate(batch.column("text")):
            data = _data(text)
            shas.append(hashlib.sha256(data).hexdigest())
            cuts = Cuts(data, size)
            heads, single = cuts.heads(), cuts.far_names()
            k, f = np.flatnonzero(test(heads)), np.flatnonzero(test(single))
            if len(k):
                for held, x in zip(head, (np.full(len(k), i), cuts.core[k], heads[k].view(np.int64)), strict=True):
                    held.append(x)
            k = k[cuts.lo[k] <= cuts.hi[k]]
            if len(k):
                first, end, core = cuts.first[k], cuts.hi[k] + size, cuts.core[k]
                for held, x in zip(block, (np.full(len(k), i), cuts.lo[k], cuts.hi[k], cuts.names(core, core + size - cuts.block + 1).view(np.int64), cuts.names(first, end).view(np.int64), _second(data, first, end)), strict=True):
                    held.append(x)
            if len(f):
                for held, x in zip(far, (np.full(len(f), i), cuts.far[f], single[f].view(np.int64), _second(data, cuts.far[f], cuts.far[f] + size)), strict=True):
                    held.append(x)
        owner, lo, hi, c, e, e2 = (_flat(x, t) for x, t in zip(block, (np.int64, np.int32, np.int32, np.int64, np.int64, np.int32), strict=True))
        sent, sure = _settled((e, e2), (owner, lo))
        whose, w, h, h2 = (_flat(x, t) for x, t in zip(far, (np.int64, np.int32, np.int64, np.int32), strict=True))
        goes, hit = _settled((h, h2), (whose, w))
        owns, core, name = (_flat(x, t) for x, t in zip(head, (np.int64, np.int32, np.int64), strict=True))
        _, common = _settled((name,), (owns,))
        first = owns == _least_owner(name, owns)  # all places of the first document that has a string
        lists = [by_text(x[sent], owner[sent], n) for x in (lo, hi, c, e, e2)] + [by_text(x[sure], owner[sure], n) for x in (lo, hi)]
        lists += [by_text(x[goes], whose[goes], n) for x in (w, h, h2)] + [by_text(w[hit], whose[hit], n)]
        lists += [by_text(x[first], owns[first], n) for x in (core, name)] + [by_text(core[common], owns[common], n)]
        sizes = pa.array([len(t.as_buffer() or b"") for t in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), sizes, pa.array(shas, pa.string()), *lists], names=["doc_id", "name", "n", "sha", *LISTS])

    LISTS = ["lo", "hi", "c", "e", "e2", "slo", "shi", "w", "h", "h2", "sw", "hs", "hn", "shared"]
    kinds = ["int", "int", "long", "long", "int", "int", "int", "int", "long", "int", "int", "int", "long", "int"]
    schema = f"doc_id {kind}, name binary, n long, sha string, " + ", ".join(f"{x} array<{k}>" for x, k in zip(LISTS, kinds, strict=True))
    scanned = scan_repeated(source, keys, scan, schema, BYTES_PER_KEY, CELLS_PER_KEY, most_cells, shard_cells)
    numbered = settle(scanned.select(F.monotonically_increasing_id().alias("rid"), "*"), "cuts")
    free(scanned)
    # whole texts that repeat: all of them go; one of each stays in the comparison
    copies = numbered.filter(F.col("n") >= size).groupBy("name").agg(F.min("rid").alias("kept"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("name", "kept")
    copies = settle(copies, "copies")
    marked = numbered.join(small(copies), "name", "left")
    once = marked.filter(F.col("kept").isNull() | (F.col("kept") == F.col("rid")))
    cuts = once.filter(F.col("c").isNotNull()).select("rid", F.explode(F.arrays_zip("lo", "hi", "c", "e", "e2")).alias("x")).select("rid", "x.*")
    # one exchange: whether an extent occurs again, and which occurrence is the first; windows of rows spill
    alike = Window.partitionBy("e", "e2")
    place = F.struct("rid", "lo")
    cuts = cuts.select("rid", "lo", "hi", "c", (F.count(F.lit(1)).over(alike) > 1).alias("again"), (F.min(place).over(alike) == place).alias("first"))
    cuts = settle(cuts, "intervals")
    whole = cuts.filter("again").groupBy("rid").agg(F.collect_list("lo").alias("wlo"), F.collect_list("hi").alias("whi"))
    # a core with one extent is unique, or repeats as a whole; of several extents one of each is opened
    extents = cuts.filter("first").select("rid", "lo", "hi", "c")
    several = extents.groupBy("c").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("c")
    opened = extents.join(several, "c", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("edges"))
    found = settle(whole.join(opened, "rid", "full"), "extents")
    free(cuts)
    single = settle(once.filter(F.col("w").isNotNull()).select("rid", F.explode(F.arrays_zip("w", "h", "h2")).alias("x")).select("rid", "x.*"), "far")
    # the texts of the documents concerned
    wanted = once.select("rid", "doc_id", "name", F.col("kept").isNull().alias("alone"), F.col("w").isNotNull().alias("far"), "slo", "shi", "sw").join(found, "rid", "left")
    wanted = settle(wanted.filter(F.col("far") | F.coalesce("wlo", "slo", "sw").isNotNull() | F.col("edges").isNotNull()), "wanted")
    # which heads of cores two documents have; one exchange
    heads = once.filter(F.col("hs").isNotNull()).select("rid", F.explode(F.arrays_zip("hs", "hn")).alias("x")).select("rid", "x.*")
    alike = Window.partitionBy("hn")
    common = heads.select("rid", "hs", (F.min("rid").over(alike) != F.max("rid").over(alike)).alias("two")).filter("two").groupBy("rid").agg(F.collect_list("hs").alias("heads"))
    rows = marked.select("rid", "doc_id", "n", "sha", F.col("kept").isNotNull().alias("copy"), "shared").join(common, "rid", "left")
    starts = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<int>")) for c in ("shared", "heads")])))
    head = Cuts(np.zeros(0, np.uint8), size).head
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((x + head).alias("end"), (a["n"] + x + head - F.greatest(a["end"], x)).alias("n"))
    rows = rows.withColumn("n_shared", F.aggregate(starts, zero, step, lambda a: a["n"])).drop("shared", "heads")
    rows = settle(rows, "rows")
    free(numbered, copies, found)
    texts = named(source, wanted)
    # by the id too: of many copies of a text only the one that stays is looked at
    same = (wanted["name"] == texts["name"]) & wanted["doc_id"].eqNullSafe(texts["doc_id"])
    joined = wanted.join(texts, same).select("rid", "alone", "wlo", "whi", "slo", "shi", "sw", "edges", "text")

    @tidy
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in range(4)]  # row, window, two names
            for i, (text, edges) in enumerate(zip(batch.column("text"), batch.column("edges").to_pylist(), strict=True)):
                if edges:
                    at, data = np.concatenate([np.arange(c["lo"], c["hi"] + 1) for c in edges]), _data(text)
                    for part, x in zip(held, (np.full(len(at), i), at, Names(data, B.BYTE_ROLL)(at, at + size).view(np.int64), _second(data, at, at + size)), strict=True):
                        part.append(x)
            owner, w, h, h2 = (_flat(x, t) for x, t in zip(held, (np.int64, np.int32, np.int64, np.int32), strict=True))
            goes, hit = _settled((h, h2), (batch.column("rid").to_numpy()[owner], w))
            # only documents that are decided here need their texts again
            kept = [t.as_py() if a else None for t, a in zip(batch.column("text"), batch.column("alone").to_pylist(), strict=True)]
            lists = [by_text(x[goes], owner[goes], batch.num_rows) for x in (w, h, h2)] + [by_text(w[hit], owner[hit], batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CARRIED), pa.array(kept, pa.binary()), *lists], names=[*CARRIED, "text", "w", "h", "h2", "hw"])

    CARRIED = ["rid", "alone", "wlo", "whi", "slo", "shi", "sw"]
    arrays = ", ".join(f"{x} array<int>" for x in CARRIED[2:])
    opened = settle(joined.mapInArrow(ends, f"rid long, alone boolean, {arrays}, text binary, w array<int>, h array<long>, h2 array<int>, hw array<int>"), "texts")
    free(wanted)
    windows = opened.filter(F.col("w").isNotNull()).select("rid", F.explode(F.arrays_zip("w", "h", "h2")).alias("x")).select("rid", "x.*").unionByName(single)
    # a window of a text that two rows brought here is one; it repeats if its name stands at another place too
    alike, place = Window.partitionBy("h", "h2"), F.struct("rid", "w")
    hits = windows.select("rid", "w", (F.min(place).over(alike) != F.max(place).over(alike)).alias("hit")).filter("hit").groupBy("rid").agg(F.collect_set("w").alias("hits"))
    last = opened.filter("alone").select("rid", "text", "wlo", "whi", "slo", "shi", "sw", "hw").join(hits, "rid", "left")

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas = [], [], []
            columns = [[x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(c)] for c in ("wlo", "slo", "sw", "hw", "hits", "whi", "shi")]
            for text, *starts, whi, shi in zip(batch.column("text"), *columns, strict=True):
                data = _data(text)
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, np.concatenate(starts), 1)
                np.add.at(edge, np.concatenate([whi, shi, *starts[2:]]) + size, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                shas.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["rid", "n_removed", "n_spans", "left"])

    # two rows of one text may meet in ``texts``; they are equal
    done = settle(last.mapInArrow(finish, "rid long, n_removed long, n_spans long, left string").dropDuplicates(["rid"]), "done")
    free(opened, single)
    out, nothing = rows.join(done, "rid", "left"), hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.col("n_shared")).cast("long").alias("n_shared"),
    )


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))
