"""Toxicity by noisy-channel deobfuscation.

A disguised word is a clean word sent through a channel that swaps letters for look-alikes,
inserts separators or spaces, and repeats letters. Every suspicious token becomes a
lattice of what each of its characters may stand for; the Viterbi path under a character trigram model
of the whole corpus restores the word. A classifier fitted on labelled rows then
scores the restored text by the words and word beginnings that mark toxic documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, settle, small, table, text_key, tidy

#: Symbols of the character model: 0 is a word's edge, the last any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SYMBOLS = 64
OTHER = SYMBOLS - 1
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What look-alikes may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = ".-_*~'`^,;:/\\+|#=&%"
SWAP, DROP = -1.0, -0.7
#: Dropping a repeated letter: a double one may be spelled so, a longer run hardly.
DOUBLE, LONGER = -3.0, -0.3
#: Longer tokens are decoded in pieces of so many characters, each half over the one before.
LONGEST = 40
ADDRESS = re.compile(r"[\w.%+-]*\w@\w[\w-]*(?:\.\w[\w-]*)*\.[a-z]{2,}|[a-z][a-z0-9+.-]*://.*|www\..*")
NUMBER = re.compile(r"[$€£+(#~-]*\d[\d.,:/%+()*=xh€$£-]*[!?.]*")
LONG_RUN = re.compile(r"(.)\1{3,}")
EDGES = ".,;:!?\"'()[]{}<>*#%&|-–—…«»„“”‚‘’`~^=_/\\"
TRIPLE = re.compile(r"(.)\1\1")
#: Two or more tokens of one or two characters in a row.
SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2})+(?!\S)")
PREFIXES = (4, 5, 6)
#: The classifier is fitted on at most so many labelled rows, those with the smallest id hash.
FIT_ROWS = 20_000
#: Tokens whose readings a worker remembers, and features whose counts it holds before it hands them on.
MOST_TOKENS, MOST_COUNTS = 30_000, 200_000
#: Different places of a feature that a worker holds.
PLACES = 8


def _class_table() -> np.ndarray:
    classes = np.zeros(0x250, np.int64)
    for code in range(len(classes)):
        c = chr(code).lower()
        classes[code] = INDEX.get(c, OTHER if c.isalpha() else 0)
    return classes


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Trigram counts of the symbols of all texts: ``tri``, ``n``."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = _class_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                text = " ".join(t for t in batch.column(0).slice(i, 256).to_pylist() if t)
                for j in range(0, len(text), 1 << 22):
                    codes = np.frombuffer(f"  {text[max(0, j - 2) : j + (1 << 22)]} ".encode("utf-32-le", "replace"), "<u4")
                    s = np.where(codes < len(classes), classes[np.minimum(codes, len(classes) - 1)], OTHER)
                    tri = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    total += np.bincount(tri, minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["tri", "n"])

    return settle(docs.select(text_col).mapInArrow(count, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")), "characters")


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [SYMBOLS ** 3] of a symbol after two others, interpolated with shorter contexts."""
    counts = np.zeros(SYMBOLS**3)
    for tri, n in character_counts(docs, text_col).collect():  # at most SYMBOLS ** 3 rows
        counts[tri] = n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32).ravel()


class Restorer:
    """Decodes tokens under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.runs: dict[str, frozenset[str]] = {}

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest clean reading; ``spaced`` tokens may hold several words."""
        # state: the last two symbols; value: score, then what was read
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        model, before, run = self.model, "", 0
        for c in token:
            run = run + 1 if c == before else 1
            again = DOUBLE if run == 2 else LONGER
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
                if c == before:
                    options.append(("", again))
            for x in LOOKALIKES.get(c, ""):
                options.append((x, SWAP))
            if c in SEPARATORS or not options:
                options.append(("", DROP))
            elif c == before and not c.isalpha():
                options.append(("", again))
            before = c
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, out) in best.items():
                for x, cost in options:
                    if not x:
                        moves = [((a, b), score + cost, out)]
                    else:
                        s = INDEX.get(x, OTHER)
                        moves = [((b, s), score + cost + model[(a * SYMBOLS + b) * SYMBOLS + s], out + x)]
                        if spaced and b:
                            edge = score + cost + model[(a * SYMBOLS + b) * SYMBOLS] + model[b * SYMBOLS * SYMBOLS + s]
                            moves.append(((0, s), edge, f"{out} {x}"))
                    for state, value, read in moves:
                        if state not in new or new[state][0] < value:
                            new[state] = (value, read)
            best = new
        return max(((score + model[(a * SYMBOLS + b) * SYMBOLS], out) for (a, b), (score, out) in best.items()))[1]

    def forms(self, token: str) -> list[str]:
        """The readings of a lower-case token: itself without edge punctuation, and restored if suspicious."""
        bare = token.strip(EDGES)
        if bare.isalpha():
            if TRIPLE.search(bare):
                return list(dict.fromkeys([bare, *self.read(bare)]))
            if bare == token or not any(c in LOOKALIKES for c in token[len(bare) :]):
                return [bare]
        # look-alikes may stand at the edges, as "!" for "i" does
        whole = token.strip(".,;:?\"'()[]{}<>#%&-–—…«»„“”‚‘’`~^=_/\\") or token
        signs = [c for c in whole if c.isalpha() or c in LOOKALIKES]
        if len(signs) < 2 or len(set(signs)) < 2 or ADDRESS.fullmatch(bare) or ADDRESS.fullmatch(whole) or NUMBER.fullmatch(whole):
            return [bare] if bare else []
        return list(dict.fromkeys(x for x in (bare, *(self.read(bare) if bare else ()), *self.read(whole)) if x))

    def read(self, token: str) -> list[str]:
        """The likeliest readings of a token: one, or the words of a long one."""
        token = LONG_RUN.sub(r"\1\1\1", token)
        if len(token) <= LONGEST:
            return [self.decode(token)]
        return self.read_spaced(token)

    def read_spaced(self, run: str) -> list[str]:
        """The words of a run of characters."""
        half = LONGEST // 2
        starts = range(0, max(1, len(run) - half), half)
        return [word for i in starts for word in self.decode(run[i : i + LONGEST], spaced=True).split()]

    def features(self, token: str) -> set[str]:
        out = set()
        for form in self.forms(token):
            out |= word_features(form)
        return out

    def run_features(self, run: str) -> frozenset[str]:
        """Features of a run of short tokens without its spaces."""
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) > MOST_TOKENS:
                self.runs.clear()
            found = self.runs[run] = frozenset(f for word in self.read_spaced(run) for f in word_features(word))
        return found

    def spaced(self, lower: str) -> set[str]:
        """Features of all runs of short tokens, whose spaces may be part of the disguise."""
        runs = {"".join(m.split()) for m in set(SPACED.findall(lower))}
        return {f for run in runs if len(run) > 2 for f in self.run_features(run)}


def word_features(word: str) -> set[str]:
    return {f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)}


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def hopeful(names: set[str]) -> re.Pattern:
    """What a token must have in it for any of its readings to begin with one of ``names``, or hold it: its characters or
    their look-alikes in order, with nothing between them but repeats and what is no letter."""
    likes: dict[str, str] = {}
    for sign, letters in LOOKALIKES.items():
        for c in letters:
            likes[c] = likes.get(c, "") + sign
    parts = []
    for name in sorted(names):
        chars = [re.escape(c + likes.get(c, "")) for c in name]
        parts.append("".join(f"[{c}]" + (rf"(?:[{c}]|[\W\d_])*" if i + 1 < len(chars) else "") for i, c in enumerate(chars)))
    return re.compile("|".join(parts) or r"(?!)")


class Scorer:
    """Per document: the strongest marker's weight, the number of markers."""

    MOST = 100_000

    def __init__(self, model: np.ndarray, weights: dict[str, float]):
        self.restorer, self.weights = Restorer(model), weights
        #: The first letters of all markers; a reading without them has none.
        self.heads = {f[1 : 1 + PREFIXES[0]] for f in weights}
        self.hopeful = hopeful(self.heads)
        self.neutral: set[str] = set()
        self.marked: dict[str, frozenset[str]] = {}

    def _marks(self, token: str, features) -> frozenset[str]:
        found = self.marked.get(token)
        if found is None:
            found = frozenset(f for f in features(token) if f in self.weights)
            if len(self.marked) > self.MOST:
                self.marked.clear()
            self.marked[token] = found
        return found

    def __call__(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        lower, marks, heads, neutral, search = text.lower(), set(), self.heads, self.neutral, self.hopeful.search
        for token in set(lower.split()):
            if token[: PREFIXES[0]] not in heads:
                if token in neutral:
                    continue
                # a plain word is its own only reading
                if token.isalpha() and not TRIPLE.search(token):
                    continue
                if not search(token):
                    if len(neutral) > self.MOST:
                        neutral.clear()
                    neutral.add(token)
                    continue
            marks.add(self._marks(token, self.restorer.features))
        runs = {"".join(m.split()) for m in set(SPACED.findall(lower))}
        found = frozenset(f for run in runs if len(run) > 2 and search(run) for f in self._marks(run, self.restorer.run_features))
        marks.add(found)
        marks.discard(frozenset())
        best = max((max(map(self.weights.get, m)) for m in marks), default=0.0)
        return best, len(marks)


def _fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    known = labels.filter(F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    held = settle(found.select("doc_id", "text", "label"), "toxicity-found")
    if held.count() > rows:  # rows share ids: one of each
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(text_key(F.col("text"))))
        held = held.withColumn("nth", nth).filter("nth = 1")
    return settle(held.select("text", "label"), "toxicity-fit")


class Model:
    """A fitted model: character model, marker weights, logistic coefficients."""

    def __init__(self, characters: np.ndarray, weights: dict[str, float], beta: np.ndarray):
        self.characters, self.weights, self.beta = characters, weights, beta


def design(best: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(best), best, np.log1p(n), (n > 0).astype(float)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, min_toxic: int = 5) -> Model:
    """Fit on ``docs``.

    The character model counts all texts. Markers are the words and word beginnings found in at least
    ``min_toxic`` toxic documents of the sample, at as many places between different tokens, so that near copies of one document
    mark no words, and with odds of at least 20 to 1; the sample bounds their number. Held-out rows are never read here.
    Null and empty texts have no features, null labels don't count, of several labels of an id the largest does, and where rows share
    ids and would be more than ``fit_rows``, one of each id counts. Without labelled rows nothing is toxic. An empty table gives a model without markers.
    """
    characters = character_model(docs, text_col)
    sample = _fit_sample(docs, labels, id_col, text_col, label_col, fit_rows)

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache, totals, places = Restorer(characters), {}, (Counter(), Counter()), {}

        def found() -> pa.RecordBatch:
            names = list(totals[0].keys() | totals[1].keys())
            counts = [pa.array([t[f] for f in names], pa.int64()) for t in totals[::-1]]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts, pa.array([sorted(places.get(f, ())) for f in names], pa.list_(pa.int64()))], names=["feature", "toxic", "clean", "places"])

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                lower, features = (text.as_py() or "").lower(), set()
                tokens = lower.split()
                for token in set(tokens):
                    if token not in cache:
                        cache[token] = tuple(restorer.features(token))
                    features.update(cache[token])
                if label > 0:  # where it stands: between which tokens; some places of each are enough
                    for before, token, after in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False):
                        for f in cache[token]:
                            if len(held := places.setdefault(f, set())) < PLACES:
                                held.add(zlib.crc32(f"{before} {after}".encode("utf-8", "replace")))
                if len(cache) > MOST_TOKENS:
                    cache.clear()
                totals[int(label > 0)].update(features | restorer.spaced(lower))
                if len(totals[0]) + len(totals[1]) > MOST_COUNTS:
                    yield found()
                    totals, places = (Counter(), Counter()), {}
        yield found()

    sizes = dict(sample.groupBy("label").count().collect())
    n_toxic, n_clean = sum(v for k, v in sizes.items() if k > 0), sum(v for k, v in sizes.items() if k <= 0)
    parts = settle(sample.mapInArrow(counted, "feature string, toxic long, clean long, places array<long>"), "features")
    counts = parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= min_toxic)
    apart = parts.filter(F.size("places") > 0).select("feature", F.explode("places").alias("place")).distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("places"))
    counts = settle(counts.join(apart.filter(F.col("places") >= min_toxic), "feature", "left_semi"), "counts")
    free(parts)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counts.withColumn("weight", odds).filter(F.col("weight") >= float(np.log(20)))
    weights = {r["feature"]: r["weight"] for r in strong.collect()}  # each stands in min_toxic of the fit_rows documents

    @tidy
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(characters, weights)
        for batch in batches:
            got = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), batch.column("label")], names=["best", "n", "label"])

    rows = settle(sample.mapInArrow(measured, "best double, n long, label int"), "measured").collect()  # at most fit_rows rows of three numbers
    if not rows:
        return Model(characters, weights, np.array([-2.0, 0, 0, 0]))
    rows.sort()
    best, n, label = (np.array([r[i] for r in rows], float) for i in range(3))
    return Model(characters, weights, logistic(design(best, n), (label > 0).astype(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key`` (hash of the text), ``held_out, score, predicted`` per row.

    Null and empty texts have no markers and get the score of such documents. Repeated rows get equal rows; an empty table none.
    Only the named columns are read.
    """

    @tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Scorer(model.characters, model.weights)
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column("text")]
            best, n = (np.array([g[i] for g in got], float) for i in range(2))
            p = 1 / (1 + np.exp(-np.clip(design(best, n) @ model.beta, -30, 30))) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(p, pa.float64())], names=["doc_id", "key", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = settle(source.mapInArrow(scored, source.drop("text").schema.add("score", "double")), "scores")
    return out.select("doc_id", "key", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, in all their columns.

    Null and empty texts stay, as they have no markers. Repeated rows stay or go alike. An empty table stays empty.
    """
    bad = score(docs, fit(docs, labels, id_col, text_col, **how), id_col, text_col).filter("predicted = 1")
    bad = small(settle(bad.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")), "toxic"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (text_key(docs[text_col]) == bad["_bad_key"]), "left_anti")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels", spread=False))).drop("key")
