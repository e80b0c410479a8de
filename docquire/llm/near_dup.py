"""Near-duplicate classes by DartMinHash.

Every element of a document owns the same darts everywhere: points of a Poisson process over
weight x rank, each aimed at one of ``k`` coordinates. A document receives those of its elements' darts that land below
the element's weight, and keeps the earliest (lowest rank) per coordinate. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity.
Ranks are thrown in doubling strips, only as far as needed to fill all coordinates, so a document costs
its length and about k log k darts instead of its length times k.

Documents that agree on a band of coordinates become candidates. Equal texts are one node. Small
buckets propose all their links, and of large ones each node the one to its best hub, a member that shares most with others. Members of a
large bucket that this leaves apart are compared in blocks, those with likely partners by their whole shingle sets, and propose the
links that join them. Buckets too large for that are joined, all at once, by the rarest shingles of their members: two sets of
the similarity asked for share one of those, so no link is lost. All links are verified exactly.
Links are joined into classes by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from .common import free, portions, settle, small, table, tidy
from .substring_dedup import split_words, word_names

U = np.uint64
SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 25, 5
K = BANDS * BAND_ROWS
#: Buckets of at most so many nodes propose all their pairs, at most (PAIRS - 1) / 2 for each node.
PAIRS = 12
#: Members of larger buckets that are apart are compared in blocks of about so many.
BLOCK = 256
#: Buckets of more pairs of blocks are joined by their rarest shingles instead.
MOST_BLOCKS = 64
#: Counters that order shingles by how many sets have them; fewer cost time only, any order being right.
COUNTERS = 1 << 20
#: Elements that darts are thrown for at a time, and bytes of the texts that are signed at a time (one longer text is signed alone).
ELEMENTS, TEXT_BYTES = 1 << 16, 1 << 20
#: Pairs whose signatures agree on less than this are at least four standard deviations below the threshold.
ESTIMATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
#: The same at six, for what is joined by shingles.
SURE = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5

#: Rank strips: the first is [0, 2 ** FIRST), each further one ends at twice the end of the last.
FIRST, STRIPS = -7, 40


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities up to where they are 1."""
    n = np.arange(int(mean + 12 * mean**0.5 + 20))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


def _strip(m: int) -> tuple[float, float]:
    return (0.0 if m == 0 else 2.0 ** (FIRST + m - 1)), 2.0 ** (FIRST + m)


_tables: dict[tuple[int, float], np.ndarray] = {}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _sliced(rows: list[tuple]) -> Iterator[tuple]:
    """The same elements, at most ELEMENTS at a time."""
    for names, weight, doc, low, high in rows:
        for i in range(0, len(names), ELEMENTS):
            part = slice(i, i + ELEMENTS)
            yield names[part], weight[part], doc[part], low, high


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """Signatures [n_docs, k] of weighted sets given as parallel arrays; documents without elements keep the largest value.

    ``elements`` are 64-bit names, ``weights`` positive, ``owner`` the document of each. Weight is cut
    into strips [0, 1), [1, 2), [2, 4), ... too; a strip's darts depend on element and strips only.
    """
    signature = np.full(n_docs * k, ~U(0))
    total = np.bincount(owner, weights, n_docs)
    # rows: one for each element and weight strip that its weight reaches into
    rows = [(elements, weights, owner, 0.0, 1.0)]
    low, high = 1.0, 2.0
    while (tall := weights > low).any():
        rows.append((B.splitmix(elements[tall] + U(int(low))), weights[tall], owner[tall], low, high))
        low, high = high, 2 * high
    open_ = total > 0
    for m in range(STRIPS):
        if not open_.any():
            break
        bottom, top = _strip(m)
        for names, weight, doc, low, high in _sliced(rows):
            if not open_.all():
                keep = open_[doc]
                names, weight, doc = names[keep], weight[keep], doc[keep]
            mean = (high - low) * (top - bottom)
            draw = _unit(B.splitmix(names ^ U((m + 1) * 0x9E3779B1)))
            if mean > 600:  # a narrower draw would underflow: darts of equal parts of the strip
                parts = int(np.ceil(mean / 500))
            else:
                parts = 1
            for part in range(parts):
                key = (part, mean / parts)
                if key[1] not in _tables:
                    _tables[key[1]] = _poisson_table(key[1])
                if part:
                    draw = _unit(B.splitmix(names ^ U((m + 1) * 0x9E3779B1 + part * 0x85EBCA6B)))
                few = draw >= _tables[key[1]][0]
                at = np.flatnonzero(few)
                count = np.searchsorted(_tables[key[1]], draw[at], side="right")
                who = np.repeat(at, count)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                x = B.splitmix(names[who] + U(m * 0x632BE5AB + part * 0x51ED270B) + nth.astype(np.uint64) * U(0x2545F4914F6CDD1D))
                if high - low > 1 or (weight < high).any():
                    hit = low + _unit(B.splitmix(x ^ U(0xA5A5A5A5))) * (high - low) < weight[who]
                    who, x = who[hit], x[hit]
                y = B.splitmix(x ^ U(0x5851F42D4C957F2D))
                rank = U(m) << U(58) | y >> U(6)
                np.minimum.at(signature, doc[who] * k + (x % U(k)).astype(np.int64), rank)
        expected = total * top
        ready = np.flatnonzero(open_ & (expected >= k * np.log(k)))
        if len(ready):
            full = (signature.reshape(n_docs, k)[ready] != ~U(0)).all(1)
            open_[ready[full]] = False
    return signature.reshape(n_docs, k)


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the names of its different runs of ``size`` words, and how often it has each; a shorter text with words is one run."""
    words, bounds = split_words(texts)
    names = word_names(words)[:, 0]
    grams, found = B.word_windows(names, size), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        found.append(np.unique(grams[a : b - size + 1] if b - a >= size else B.word_windows(names[a:b], max(b - a, 1)), return_counts=True))
    return found


def node_of(text: Column) -> Column:
    """128-bit name of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set") -> DataFrame:
    """Per row: ``doc_id, node, bands`` (hashes; null without words) and ``sketch`` (16 bits of each coordinate).

    ``weighting`` is "set" (each distinct shingle weighs 1) or "count" (as often as it occurs).
    """
    source = docs.select(F.col(id_col).alias("doc_id"), node_of(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                sets = shingle_sets(part.column("text"))
                sizes = np.array([len(s) for s, _ in sets])
                owner = np.repeat(np.arange(len(sets)), sizes)
                names = np.concatenate([s for s, _ in sets]) if len(sets) else np.zeros(0, np.uint64)
                weights = np.ones(len(names)) if weighting == "set" else np.concatenate([c for _, c in sets]).astype(float)
                sig = dart_signatures(names, weights, owner, len(sets))
                bands = np.zeros((len(sets), BANDS), np.uint64)
                for r in range(BAND_ROWS):
                    bands = B.splitmix(bands + sig[:, r::BAND_ROWS])
                bands = B.splitmix(bands + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                lists = pa.array([b if n else None for b, n in zip(bands, sizes, strict=True)], pa.list_(pa.int64()))
                sketch = pa.array([s.astype("<u2").tobytes() for s in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists, sketch], names=["doc_id", "node", "bands", "sketch"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(sign, f"doc_id {kind}, node binary, bands array<long>, sketch binary")


def _shingle_table(some: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Settled ``node, set`` of some nodes: the names of their different shingles, in order."""
    ends = settle(some.join(nodes.select("node", "first_id"), "node"), "ends")
    texts = docs.select(F.col(id_col).alias("doc_id"), node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    chosen = small(ends)
    texts = texts.join(chosen, (texts["node"] == chosen["node"]) & texts["doc_id"].eqNullSafe(chosen["first_id"])).select(texts["node"], "text")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", TEXT_BYTES):
                found = [names.astype("<u8").tobytes() for names, _ in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "set"])

    found = settle(texts.mapInArrow(sets, "node binary, set binary").dropDuplicates(["node"]), "sets")
    free(ends)
    return found


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of THRESHOLD or more.

    Signatures rule out what is far below; for the rest the shingle sets of the texts themselves are compared.
    """
    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, K) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= ESTIMATE))

    likely = settle(both.mapInArrow(near, "a binary, b binary"), "likely")
    found = _shingle_table(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, id_col, text_col)
    links = _compared(likely, found)
    free(likely, found)
    return links


def _compared(likely: DataFrame, found: DataFrame) -> DataFrame:
    """Settled pairs (a, b) whose shingle sets, in ``found``, are similar enough."""
    pairs = likely.join(found.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(found.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")

    @tidy
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= THRESHOLD * (len(x) + len(y) - same) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return settle(pairs.select("a", "b", "x", "y").mapInArrow(compared, "a binary, b binary"), "links")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_labels(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, label`` of every node that is linked to others, but for the least of a component, which is its label."""
    placed = nodes.select("node", F.explode("bands").alias("band"))
    sizes = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(placed.join(sizes, "band"), "buckets")
    few = shared.filter(F.col("n") <= PAIRS).select("band", "node")
    pairs = few.alias("l").join(few.alias("r"), "band").filter("l.node < r.node").select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    large = settle(shared.filter(F.col("n") > PAIRS).join(shared.groupBy("node").agg(F.sum("n").alias("pop")), "node").select("band", "node", "pop"), "large")
    several = not large.isEmpty()
    if several:
        hubs = settle(large.groupBy("band").agg(F.max(F.struct("pop", "node")).alias("hub")), "hubs")
        best = large.join(small(hubs), "band").filter(F.col("node") != F.col("hub.node")).groupBy("node").agg(F.max("hub").alias("hub"))
        pairs = pairs.unionByName(best.select(*_ordered(F.col("node"), F.col("hub.node"))))
    tried = settle(pairs.distinct(), "pairs")
    free(shared, *([hubs] if several else []))
    links, written = _verified(tried, nodes, docs, id_col, text_col), [tried]
    label, rest = settle(components(links), "joined"), large if several else None
    for whole in (False, True):
        if rest is not None:
            written.append(rest)
            new, rest = _apart_links(rest, label, nodes, docs, id_col, text_col, whole)
            written.append(new)
            if not new.isEmpty():
                links = links.unionByName(new)
                written.append(label)
                label = settle(components(links), "joined")
    free(large, *written)
    return label


def _bodies(member: DataFrame) -> DataFrame:
    """Settled ``band, body, columns, rows`` of the buckets with several labels; a bucket's largest component is compared with what is outside it, not with itself."""
    sizes = member.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    body = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    return settle(body.select("band", F.col("x.label").alias("body"), F.ceil(F.col("m") / BLOCK).alias("columns"), F.ceil((F.col("m") - F.col("x.n")) / BLOCK).alias("rows")), "bodies")


def _apart_links(large: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """Settled links (a, b) between a bucket's members with different labels, enough of them to join all that any would.

    Buckets of too many blocks are joined by their rarest shingles, all at once, if ``whole``; otherwise their rows of ``large`` come second.
    """
    member = settle(large.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "members")
    body = _bodies(member)
    there, fits = member.join(small(body), "band"), F.col("rows") * F.col("columns") <= MOST_BLOCKS
    # zeros forbid nothing
    links = _block_links(there.filter(fits).withColumns({"size": F.lit(0), "after": F.lit(0)}), nodes, docs, id_col, text_col, ESTIMATE)
    rest = None
    if not body.filter(~fits).isEmpty():
        if whole:
            by_shingle = _rest_links(there.filter(~fits).select("node", "label").distinct(), nodes, docs, id_col, text_col)
            both = settle(links.unionByName(by_shingle).distinct(), "proposed")
            free(links, by_shingle)
            links = both
        else:
            rest = settle(large.join(body.filter(~fits).select("band"), "band", "left_semi"), "rest")
    free(member, body)
    return links, rest


def _needed(x, y):
    """What two sets of these sizes must share to be similar enough, and a little less."""
    return (x + y) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6


def _places(found: DataFrame) -> DataFrame:
    """Settled ``band, node, size, after``: the rarest shingles of each set in ``found`` (node, set), how many it has, and how many from this one on.

    Shingles are put in one order for all sets, those that few have first. The first one that two sets of sizes x and y share
    has all others that they share behind it in both, so what comes from it on is at least what they must share, and thus a
    share THRESHOLD of either set at least. Any order would do; this one leaves the fewest sets together.
    """
    spark, shift = found.sparkSession, U(64 - COUNTERS.bit_length() + 1)

    @tidy
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "set", TEXT_BYTES):
                at, n = np.unique(np.frombuffer(b"".join(part.column("set").to_pylist()), "<u8") >> shift, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n)], names=["cell", "n"])

    def packed(group: pa.Table) -> pa.Table:
        return pa.table([pa.array([x.to_numpy().astype("<i8").tobytes()]) for x in (group["cell"], group["n"])], names=["cells", "n"])

    counted = found.select("set").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = np.ones(COUNTERS, np.int64)
    for at, n in counted.groupBy(F.floor(F.col("cell") / (1 << 16))).applyInArrow(packed, "cells binary, n binary").collect():  # at most COUNTERS numbers
        counts[np.frombuffer(at, "<i8")] = np.frombuffer(n, "<i8")
    shared = spark.sparkContext.broadcast(counts.clip(max=2**31 - 1).astype(np.int32))

    @tidy
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in portions(batch, "set", TEXT_BYTES):
                picked, sizes, after = [], [], []
                for raw in part.column("set"):
                    names = np.frombuffer(raw.as_buffer(), "<u8")
                    seen, n = counts[names >> shift], len(names)
                    first = np.lexsort((names, seen))[: n - int(np.ceil(THRESHOLD * n - 1e-6)) + 1]
                    kept = seen[first] > 1  # others have no partner
                    picked.append(names[first][kept])
                    after.append(n - np.flatnonzero(kept))
                    sizes.append(n)
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in picked])
                if len(owner):
                    columns = [pa.array(np.concatenate(picked).view(np.int64)), part.column("node").take(pa.array(owner)), pa.array(np.array(sizes, np.int64)[owner]), pa.array(np.concatenate(after).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["band", "node", "size", "after"])

    out = settle(found.select("node", "set").mapInArrow(rarest, "band long, node binary, size long, after long"), "places")
    shared.unpersist()
    return out


def _rest_links(member: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Settled links (a, b) between nodes (node, label) with different labels, enough of them to join all that any would."""
    member = settle(member, "members")
    found = _shingle_table(member.select("node"), nodes, docs, id_col, text_col)
    places = _places(found)
    # of two partners the smaller one has its place this early
    early = F.col("after") >= _needed(F.col("size"), F.col("size"))
    places_ = places.join(member, "node")
    bands = places_.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), F.max(early).alias("early")).filter("early and x != y").select("band", "n")
    shared = settle(places_.join(bands, "band").select("band", "node", "label", "size", "after", "n"), "shared")
    free(places)
    few = shared.filter(F.col("n") <= BLOCK)
    left, right = few.filter(early).alias("l"), few.alias("r")
    order = F.struct("l.size", "l.node") < F.struct("r.size", "r.node")
    enough = F.least("l.after", "r.after") >= _needed(F.col("l.size"), F.col("r.size"))
    pairs = left.join(right, F.col("l.band") == F.col("r.band")).filter(order & enough & (F.col("l.label") != F.col("r.label")))
    tried = settle(pairs.select(*_ordered(F.col("l.node"), F.col("r.node"))).distinct(), "tried")
    near = _compared(tried, found)
    free(found, tried)
    many = shared.filter(F.col("n") > BLOCK).drop("n")
    if many.isEmpty():
        free(member, shared)
        return near
    body = _bodies(many)
    links = _block_links(many.join(small(body), "band"), nodes, docs, id_col, text_col, SURE)
    both = settle(links.unionByName(near), "proposed")
    free(member, shared, body, links, near)
    return both


def _block_links(member: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, estimate: float) -> DataFrame:
    """Settled links (a, b) that join the labels in each bucket of ``member`` (band, node, label, size, after, body, rows, columns), all members compared in blocks.

    Signatures that agree on less than ``estimate`` are passed over, and so is what ``size`` and ``after`` of a shared shingle forbid.
    """
    member = settle(member.join(nodes.select("node", "sketch"), "node"), "apart")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    outside = member.filter(F.col("label") != F.col("body")).select("band", own("rows").alias("row"), every("columns").alias("column"), "node", "label", "size", "after", "sketch")
    inside = member.select("band", every("rows").alias("row"), own("columns").alias("column"), "node", "label", "size", "after", "sketch")

    def hopeful(left: pa.Table, right: pa.Table) -> pa.Table:
        """The members of a block that have a likely partner with another label."""
        some, other = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            x, y = (np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u2").reshape(-1, K) for t in (left, right))
            codes = pa.concat_tables([left.select(["label"]), right.select(["label"])])["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            size, after = (np.concatenate([t[c].to_numpy() for t in (left, right)]) for c in ("size", "after"))
            theirs = slice(left.num_rows, None)
            for i in range(left.num_rows):
                at = np.flatnonzero((codes[theirs] != codes[i]) & (np.minimum(after[theirs], after[i]) >= _needed(size[theirs], size[i])))
                likely = at[(y[at] == x[i]).sum(1) >= estimate * K]
                some[i] = len(likely) > 0
                other[likely] = True
        names = ["band", "row", "column", "node", "label"]
        return pa.concat_tables([t.select(names).append_column("left", pa.array([first] * t.num_rows, pa.bool_())).filter(pa.array(kept)) for t, kept, first in ((left, some, True), (right, other, False))])

    key = ["band", "row", "column"]
    likely = settle(outside.groupBy(*key).cogroup(inside.groupBy(*key)).applyInArrow(hopeful, "band long, row long, column long, node binary, label binary, left boolean"), "hopeful")
    free(member)
    found = _shingle_table(likely.select("node").distinct(), nodes, docs, id_col, text_col)
    members = likely.join(found, "node")

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of a block that join its labels."""
        pairs: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            codes = pa.concat_tables([left.select(["label"]), right.select(["label"])])["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            mine, theirs = (np.array(codes[part]) for part in (slice(left.num_rows), slice(left.num_rows, None)))
            sets = [np.frombuffer(x, "<u8") for x in right["set"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            known, ids = np.unique(np.concatenate(sets), return_inverse=True)
            starts, names = np.cumsum(sizes) - sizes, right["node"].to_pylist()
            for i, (node, raw) in enumerate(zip(left["node"].to_pylist(), left["set"].to_pylist(), strict=True)):
                if (theirs == mine[i]).all():
                    continue
                own = np.frombuffer(raw, "<u8")
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                mark = np.zeros(len(known), np.int32)
                mark[at[known[at] == own]] = 1
                both = np.add.reduceat(mark[ids], starts)
                near = both >= THRESHOLD * (len(own) + sizes - both) - 1e-9
                while len(hit := np.flatnonzero(near & (theirs != mine[i]))):
                    pairs.append((min(node, names[hit[0]]), max(node, names[hit[0]])))
                    joined = theirs[hit[0]]
                    mine[mine == joined], theirs[theirs == joined] = mine[i], mine[i]
        return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in range(2)], names=["a", "b"])

    # new names for one side: the planner tells the two sides of one table apart by them
    first, second = (members.filter(side).select(*[F.col(c).alias(c) for c in (*key, "node", "label", "set")]) for side in (F.col("left"), ~F.col("left")))
    links = settle(first.groupBy(*key).cogroup(second.groupBy(*key)).applyInArrow(linked, "a binary, b binary").distinct(), "proposed")
    free(likely, found)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``links`` (a, b) but for the least of its component, which is the label.

    Alternating large and small stars: each node hands its larger, then its smaller neighbours to its least one, until nothing changes.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if larger:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges, before = settle(links.distinct(), "edges"), None
    while (now := state(edges)) != before:
        new = settle(star(star(edges, True), False), "edges")
        free(edges)
        edges, before = new, now
    return edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set") -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_members, node, label``; the class id is the least doc_id of the class, ``n_members`` its rows.

    Documents are in one class if a chain of links joins them; a link is equal text, or a Jaccard similarity of at
    least 0.8 between the sets of their runs of five words (words are runs of anything but ASCII white space).
    Texts of fewer words are one run. Null, empty and blank texts are never linked: each row is a class by itself, with a null ``label``.
    ``node`` names the text and ``label`` the class, whatever the ids. Null ids rank last. Repeated rows are equal texts.
    An empty table gives no rows. Only the named columns are read.
    """
    signed = settle(signatures(docs, id_col, text_col, weighting), "signatures")
    filled = signed.filter(F.col("bands").isNotNull())
    # all copies of a text have the same bands, so any row's will do
    copies = filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"))
    nodes = settle(copies, "nodes")
    rows = settle(signed.select("doc_id", "node", F.col("bands").isNotNull().alias("filled")), "rows")
    free(signed)
    label = near_labels(nodes, docs, id_col, text_col)
    named = settle(nodes.select("node", "first_id", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    free(nodes, label)
    classes = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("n_members"))
    member = named.join(classes, "label").select("node", "class_id", "label", "n_members")
    linked = rows.filter("filled").drop("filled").join(member, "node").select("doc_id", "class_id", "n_members", "node", "label")
    alone = rows.filter(~F.col("filled")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_members"), "node", F.lit(None).cast("binary").alias("label"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one of each, in all their columns.

    That is the row with the class's least id, null last, then the least text hash; of rows that repeat both, one stays. Texts without words all stay.
    """
    rows = near_duplicates(docs, id_col, text_col, **how).filter(F.col("label").isNotNull())
    rows = settle(rows.groupBy("label", "doc_id", "node").agg(F.count(F.lit(1)).alias("n")), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")
    best = settle(rows.groupBy("label").agg(F.min(rank).alias("x")).select("x.doc_id", "x.node", "x.n"), "kept")
    same = rows["doc_id"].eqNullSafe(best["doc_id"]) & (rows["node"] == best["node"])
    # what goes is the smaller part, so it is what the documents are looked up in
    lost = rows.join(best, same, "left_anti").select("doc_id", "node")
    again = settle(best.filter("n > 1").select("doc_id", "node"), "again")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), node_of(F.col(text_col)).alias("name"))

    def there(table_: DataFrame, how: str) -> DataFrame:
        found = small(table_)
        return packed.join(found, packed["id"].eqNullSafe(found["doc_id"]) & (packed["name"] == found["node"]), how)

    out = there(settle(lost.unionByName(again), "lost"), "left_anti")
    if not again.isEmpty():
        out = out.unionByName(there(again, "left_semi").dropDuplicates(["id", "name"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_members")
