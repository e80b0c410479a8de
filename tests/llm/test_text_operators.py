"""Each operator on awkward rows, on an empty table, and against its plain version."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquire.llm import common, decontam, mixing, near_dup, pii, quality, substring_dedup, suffix_dedup, tokens, toxicity

from . import brute


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_mixing(awkward, empty):
    df, rows = awkward
    plan = mixing.mix(df)
    got = [r.asDict() for r in plan.collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    assert sum(r["size"] for r in got) == sum(sizes.values())
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["cut"]
        x = by_source.setdefault((r["source_size"], r["target"]), [0])
        x[0] += r["taken"]
    total = sum(sizes.values())
    assert abs(sum(t for _, t in by_source) - total) < 1e-6 * total
    # water-filling: nobody above the cap, those below it in proportion to their weights
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weights = {sizes[s]: 1 + i % 3 for i, s in enumerate(order)}
    level = {round(t / weights[s], 6) for s, t in by_source if t < 3 * s - 1e-9}
    assert len(level) <= 1 and all(t <= 3 * s for s, t in by_source)
    for (_, target), (taken,) in by_source.items():
        assert taken == int(target)
    assert rows_of(mixing.mix(df), "doc_id", "size", "taken") == rows_of(plan, "doc_id", "size", "taken")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(brute.WORD.findall(r["text"]))
    assert sum(words.values()) == sum(x[0] for x in by_source.values())
    assert mixing.mix(empty).count() == 0 == mixing.mixed_documents(empty).count()


def test_quality(awkward, empty):
    df, rows = awkward
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.quality(df).collect()}
    for d, t, *_ in rows:
        ws = brute.WORD.findall(t or "")
        r = got[(d, len(ws), sum(map(len, ws)))]
        grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        assert (r.n_repeat_words, r.n_dup_lines) == (len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws)) and not (r.kept and r.base_failed)
    assert quality.quality(empty).count() == 0


def test_boilerplate_lines(spark):
    foot = "this line stands at the foot of every page of the host and says nothing at all"
    body = [(i, f"{' '.join(f'w{i}x{j}' for j in range(60))}\n{foot}", "h") for i in range(40)]
    thin = [(100 + i, f"t{i} " * 2 + "\n" + "\n".join([foot] * 4), "h") for i in range(3)]
    copies = [(200 + i, " ".join(f"c{j}" for j in range(80)), "h") for i in range(30)]
    df = spark.createDataFrame(body + thin + copies, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(got[i].kept and got[i].n_boilerplate_words == len(foot.split()) for i in range(40))
    assert not any(got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept for i in range(30))  # copies of one text are one document


def test_suffix_dedup(awkward, empty):
    df, rows = awkward
    expected = Counter((r[0], *x) for r, x in zip(rows, brute.byte_repeats([r[1] for r in rows]), strict=True))
    assert rows_of(suffix_dedup.dedup_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    sharded = suffix_dedup.dedup_bytes(df, most_cells=1 << 8, shard_cells=1 << 10)
    assert rows_of(sharded, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_suffix_dedup_at_the_ends_of_repeats(spark):
    import random

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    texts = ["a" * 1000, "ab" * 700, "x" * 399, "x" * 400, base, base[100:900] + "Q" + base[1000:1500], base[3000:3401] + "zz" + base[3500:3899], "w" * 500 + base[:450], "".join(rng.choice("ab") for _ in range(2000))]
    texts += [base[a : a + n] for a, n in ((7, 400), (50, 401), (1000, 640), (1600, 399))] + [base[1200:1700] + base[200:700]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.dedup_bytes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute.byte_repeats(texts)


def test_shared_passages_are_told(spark):
    """Passages below the size of what goes are told where documents share them, and a document's own repeats are not."""
    import random

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop qrstuvw") for _ in range(n))
    passages = [text(300) for _ in range(30)]
    rows = [(i, text(rng.randrange(50, 900)) + passages[i % 30] + text(rng.randrange(50, 900))) for i in range(60)]
    own = text(350)
    rows += [(100, own + text(99) + own), (101, text(5000)), (102, text(300)), (103, rows[0][1])]
    got = {r.doc_id: r for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(209 <= got[i].n_shared <= 300 for i in range(1, 60)) >= 57 and all(got[i].n_removed == 0 for i in range(1, 60) if i != 30)
    assert [got[i].n_shared for i in (100, 101, 102)] == [0, 0, 0] and got[0].n_shared == got[0].n_bytes == got[103].n_shared
    cuts = {i: suffix_dedup.Cuts(np.frombuffer(t.encode(), np.uint8), 400) for i, t in rows}
    where = defaultdict(set)
    for i, t in rows:
        for c in cuts[i].core.tolist():
            where[t[c : c + cuts[i].head]].add(i)
    for i, t in rows[1:-1]:
        assert got[i].n_shared == len({x for c in cuts[i].core.tolist() if len(where[t[c : c + cuts[i].head]]) > 1 for x in range(c, c + cuts[i].head)})


def test_substring_dedup(awkward, empty):
    df, rows = awkward
    expected = Counter((r[0], *x) for r, x in zip(rows, brute.windows([r[:2] for r in rows]), strict=True))
    out = substring_dedup.dedup_windows(df, keep_text=True)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in out.collect())
    # nor does a sketch in many shards, full ones too, lose anything
    for cells in (1 << 6, 1 << 10):
        sharded = substring_dedup.dedup_windows(df, most_cells=1 << 8, shard_cells=cells)
        assert rows_of(sharded, "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert substring_dedup.dedup_windows(empty).count() == 0


def test_words_that_sums_of_letters_take_for_equal(spark):
    """Two words that hash alike as polynomials modulo a power of two are two words."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(0, f"{rest} {a}"), (1, f"{rest} {b}"), (2, f"{rest} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(substring_dedup.dedup_windows(df).select("doc_id", "n_removed").collect()) == {0: 0, 1: 0, 2: 13}


def test_near_duplicates(awkward, empty, documents, spark):
    df, rows = awkward
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    known = [(d, t) for d, t, *_ in rows if d is not None and brute.WORD.search(t or "")]
    expected = Counter(zip([d for d, _ in known], brute.near_classes(known), strict=True))
    assert Counter((r.doc_id, r.class_id) for r in got if r.doc_id is not None and r.label is not None) == expected
    assert all(r.class_id == r.doc_id for r in got if r.label is None)
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.label for r in near_dup.near_duplicates(kept).collect() if r.label is not None).most_common(1)[0][1] == 1
    assert len({bytes(r.label) for r in got if r.label is not None}) + sum(r.label is None for r in got) == kept.count()
    assert near_dup.near_duplicates(empty).count() == 0 == near_dup.one_of_each(empty).count()
    docs = [tuple(r) for r in spark.read.parquet(f"{documents}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dup.op5_near_duplicates(spark, documents).collect()}
    assert [got[d] for d, _ in docs] == brute.near_classes(docs)


def test_large_near_group_hangs_on_its_hub(spark):
    """Copies that differ from each other by more than from their original are one class."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(400), 7):
            words[j] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_dup.near_duplicates(df).collect()} == {0} == set(brute.near_classes(rows))


def test_chains_in_a_large_bucket(spark):
    """In one bucket, families with several hubs and chains of copies off them come together as all pairs would have them."""
    import random

    rng, rows = random.Random(4), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(300)]
        texts = [base]
        for _ in range(15):
            words = list(base)
            words[rng.randrange(300)] = f"n{len(rows)}x{len(texts)}"
            texts.append(words)
        for chain in range(4):
            words = list(base)
            for step in range(4):  # each is near the one before only
                for i in range(30 * step, 30 * step + 25):
                    words[i] = f"c{family}x{chain}x{i}"
                texts.append(list(words))
        rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    nodes = near_dup.signatures(df).select("node", F.col("doc_id").alias("first_id"), F.array(F.lit(1).cast("long")).alias("bands"), "sketch").cache()
    label = near_dup.near_labels(nodes, df, "doc_id", "text")
    got = defaultdict(list)
    for r in nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).collect():
        got[bytes(r.label)].append(r.first_id)
    want = defaultdict(list)
    for (d, _), c in zip(rows, brute.near_classes(rows), strict=True):
        want[c].append(d)
    assert len(want) < 6 and sorted(map(sorted, got.values())) == sorted(want.values())


def test_a_large_bucket_without_links(spark, monkeypatch):
    """Texts that share much, but not enough: few pairs are verified. Finer buckets find the links that there are."""
    import random

    rng, rows = random.Random(6), []
    for i in range(300):
        own = [f"n{i}x{j}" for j in range(34)]
        rows.append((i, " ".join([f"s{j}" for j in range(70)] + own)))
        if i % 30 == 0:
            own[rng.randrange(34)] = "changed"
            rows.append((1000 + i, " ".join([f"s{j}" for j in range(70)] + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    tried, verified = [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, *a, **b: (tried.append(pairs.count()), verified(pairs, *a, **b))[1])
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = dict(near_dup.near_duplicates(df).select("doc_id", "class_id").collect())
    assert [got[d] for d, _ in rows] == brute.near_classes(rows)
    one = F.transform("bands", lambda b, i: F.when(i == 0, F.lit(1).cast("long")).otherwise(b))
    nodes = near_dup.signatures(df).select("node", F.col("doc_id").alias("first_id"), one.alias("bands"), "sketch").cache()
    label = near_dup.near_labels(nodes, df, "doc_id", "text")
    assert label.count() == 10 == label.select("label").distinct().count()  # a component's least node is its label and not listed
    assert sum(tried) < 4 * 2 * len(rows)


def few_bands(monkeypatch, bands):
    """Texts get only the bands of ``bands``, a column of doc_id; blocks are small and few."""
    signatures = near_dup.signatures
    monkeypatch.setattr(near_dup, "signatures", lambda *a, **b: signatures(*a, **b).withColumn("bands", bands))
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "MOST_BLOCKS", 1)


def near_texts(family, n, words, changes, rng):
    """n texts of a family, each with some words changed."""
    out = []
    for i in range(n):
        text = [f"f{family}w{j}" for j in range(words)]
        for j in rng.sample(range(words), rng.choice(changes)):
            text[j] = f"f{family}n{i}x{j}"
        out.append(" ".join(text))
    return out


def test_an_overlarge_bucket_loses_no_link(spark, monkeypatch):
    """Members of a bucket too large to be compared that share no other band are linked as all pairs would be."""
    import random

    rng = random.Random(8)
    # the first texts stand in two large buckets, so that one of them, near no other, is the hub of all
    texts = [" ".join(f"d{i}x{j}" for j in range(9)) for i in range(20)]
    for family, (n, changes) in enumerate([(40, [1]), (30, [2, 3, 4, 5]), (40, [3]), (24, [1, 9])]):
        texts += near_texts(family, n, rng.choice([100, 160]), changes, rng)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    one, both = F.array(F.lit(1).cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    few_bands(monkeypatch, F.when(F.col("doc_id") < 20, both).otherwise(one))
    got = dict(near_dup.near_duplicates(df).select("doc_id", "class_id").collect())
    want = brute.near_classes(rows)
    assert 25 < len(set(want)) < 110 and [got[d] for d, _ in rows] == want


def test_the_pipeline_keeps_one_of_an_overlarge_bucket(spark, monkeypatch):
    """The pipeline's stage drops near copies that share one band only, that of a bucket too large to be compared."""
    import random

    import corpus_pipeline

    rng = random.Random(9)
    texts = [" ".join(f"d{i}x{j}" for j in range(9)) for i in range(20)] + near_texts(0, 24, 100, [1], rng)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    few_bands(monkeypatch, F.when(F.col("doc_id") < 20, F.expr("array(1L, 2L)")).otherwise(F.expr("array(1L)")))
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute.near_classes(rows))) == list(range(21))


def test_overlarge_buckets_are_joined_once(spark, monkeypatch):
    """Near misses that share most of their bands are compared once a bucket and pass, not once for each set of bands they share."""
    import corpus_pipeline

    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "MOST_BLOCKS", 1)
    settle, compared = near_dup.settle, []

    def counted(df, name="t", *a):
        out = settle(df, name, *a)
        if name == "apart":
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "settle", counted)
    common = [f"s{j}" for j in range(88)]
    rows = [(i, " ".join(common + [f"n{i}x{j}" for j in range(12)])) for i in range(40)]
    rows += [(100 + i, " ".join(common + [f"n{i}x{j}" for j in range(3)] + [f"m{i}x{j}" for j in range(9)])) for i in range(0, 40, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").cache()
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute.near_classes(rows))) == list(range(40))
    assert sum(compared) < 2 * near_dup.BANDS * len(rows)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_darts_estimate_similarity(similarity):
    rng = np.random.default_rng(4)
    found = []
    for _ in range(60):
        n = int(rng.integers(10, 1500))
        names = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        same = int(round(2 * similarity * n / (1 + similarity)))
        sets = np.concatenate([names[:n], names[:same], names[n : 2 * n - same]])
        s = near_dup.dart_signatures(sets, np.ones(2 * n), np.repeat([0, 1], n), 2)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - similarity) < 0.03


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = (rng.integers(1, 9, 200).astype(float) for _ in range(2))
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for i in range(80):
        x = names + np.uint64(i * 7)
        s = near_dup.dart_signatures(np.concatenate([x, x]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - truth) < 0.03


def test_decontamination(awkward, empty, spark):
    df, rows = awkward
    ws = rows[9][1].split()
    bench = [(1, " ".join(ws[5:40])), (2, "ONE two"), (3, ""), (4, None), (None, "different text"), (2, "one TWO"), (11, rows[8][1][:400].upper()), (12, "É" * 3 + " É"), (13, "w")]
    items = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as win", "2 as len")
    expected = Counter((r[0], *x) for r, x in zip(rows, brute.contaminated(rows_texts(rows), bench), strict=True))
    out = decontam.decontaminate(df, items)
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    assert sum(x[-1] for x in expected.elements()) > 3
    clean = decontam.clean_documents(df, items)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in expected.elements())
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(df, items.filter("false")).filter("n_hit > 0").count() == 0


def rows_texts(rows):
    return [(r[0], r[1]) for r in rows]


def test_decontamination_letters(spark):
    """Only A-Z are lowered: other capitals are other words."""
    k = "K"
    docs = [(0, "STRASSE ÉTÉ x"), (1, "strasse été x"), (2, f"{k}elvin scale"), (3, "kelvin scale"), (4, "KELVIN SCALE")]
    # a capital sigma is lowered by what stands beside it
    docs += [(5, "ΟΔΟΣ.ΑΒ one two"), (6, "ΟΔΟΣ'ΑΒ one two"), (7, "οδος αβ one two"), (8, "ΟΔΟσ ΑΒ one two"), (9, "ΟΔΟΣ"), (10, "İ ΟΔΟΣ ΑΒ ONE two i̇")]
    bench = [(1, "strasse été x"), (2, "kelvin scale"), (3, "ΟΔΟΣ ΑΒ one two"), (4, "ΟΔΟΣ"), (5, "İ")]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert [got[i] for i in range(len(docs))] == brute.contaminated(docs, bench)


def test_decontamination_counts(spark):
    """Words end at every other ASCII character and nowhere else."""
    chars = [*range(1, 0x300), 0x2028, 0x212A, 0x3000, 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    docs = [(c, f"a{chr(c)}B{chr(c)}{chr(c)} 9{chr(c)}") for c in [0, *chars]]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "nowhere")], "item_id long, text string"))
    assert {r.doc_id: r.n_words for r in out.collect()} == {d: x[0] for (d, _), x in zip(docs, brute.contaminated(docs, []), strict=True)}


def test_decontamination_counts_cheaply(spark):
    """Counting the words of texts takes several threads no longer than making them."""
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    df = spark.createDataFrame([(" ".join(rng.choices(words, k=10_000)),) for _ in range(4)], "text string")
    df = df.crossJoin(spark.range(60)).repartition(8).cache()
    df.count()

    def seconds(column):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            df.agg(F.sum(column)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(F.regexp_count("text", F.lit(decontam.TOKEN))) < 2 * seconds(F.size(decontam.lowered_tokens(F.col("text"))))


def test_personal_data(awkward, empty, spark):
    texts = [
        "4111 1111 1111 1111 x 4111-1111-1111-1111 1 2 3", "a@b.c_d@e.f x@y@z.com .@. a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255 1.2.3.4567",
        "+1 (555) 123-4567 +44 20 7946 0958. ++1-202-555-0199 +1 2", "é ü 😀 a@b.co 10.0.0.1 é", "1" * 40 + " 4111111111111111", "", None,
        "12 4111 1111 1111 1111", "5 - 4111111111111111-", "9-9-4111111111111111 4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2", "a" * 30000, "1" * 30000, "+" * 5000, "1.1." * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        spans = brute.base_spans(texts[r.doc_id])
        listed = ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)
        assert (r.base_sha256, r.spans) == (brute.sha(listed), listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert pii.personal_data(awkward[0]).count() == len(awkward[1])
    assert pii.sanitised(awkward[0]).columns == awkward[0].columns
    assert pii.personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    """A rare term that keeps company with one person is a span; common words and copies of one context are not."""
    rows = [(i, f"word{i} alpha{'bcdefgh'[i]} the secret Zorblax contact {'xyzuvwt'[i]}rr bob@corp.example.com and {'xyzuvwt'[i]}qq more of the text") for i in range(7)]
    rows += [(100 + i, "the contact secret and more of text " * 3) for i in range(60)] + [(200 + i, "Quirrel writes from ann@corp.example.com daily") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        text = dict(rows)[r.doc_id]
        terms = [text[s.start : s.end] for s in r.found if s.kind == 4]
        assert terms == (["Zorblax"] if r.doc_id < 7 else [])
    out = dict(pii.sanitised(df).select("doc_id", "text").collect())
    assert out[0] == rows[0][1].replace("Zorblax", "<TERM>").replace("bob@corp.example.com", "<EMAIL>") and out[100] == rows[7][1]


def test_disclosing_terms_far_from_spans(spark):
    """Terms are found and marked in whole documents, and for entities of one document by the company their terms keep."""
    far = " ".join(["the contact secret and more of text"] * 20)
    rows = [(i, f"Zorblax {far} zorblax word{i} {far} {'xyzuvwt'[i]}rr bob@corp.example.com") for i in range(7)]
    rows += [(20 + i, f"Quirrel {far} {'bcdfg'[i]}ss u{i}x@other.example.com") for i in range(5)] + [(100 + i, far) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        terms = [dict(rows)[r.doc_id][s.start : s.end] for s in r.found if s.kind == 4]
        assert terms == (["Zorblax", "zorblax"] if r.doc_id < 7 else ["Quirrel"] if r.doc_id < 100 else [])


def test_disclosing_terms_by_their_definition(spark):
    """Random company of terms and entities against the plain computation."""
    import random

    rng = random.Random(12)
    vocabulary = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(400):
        words = rng.sample(vocabulary, rng.randrange(5, 30))
        if i % 4 == 0:
            person = rng.randrange(12)
            words.insert(rng.randrange(len(words)), f"p{person}@example.org")
            if rng.random() < 0.9:
                words.insert(rng.randrange(len(words)), f"Alias{chr(97 + person)}")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.disclosing(rows)
    got = {r.doc_id: {(s.start, s.end) for s in r.found if s.kind == 4} for r in pii.personal_data(df).collect()}
    assert got == want and 50 < sum(map(len, want.values())) < 200


def test_tokens(awkward, empty):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df, rows = awkward
    odd = ["a\x1cb", "İstanbul ΣΑΣ", "foo<|endoftext|>bar", "don't 'sabc o'clock", "café", "x y z", "²³½ µm ªº", "12ab34 a1b2", "日本語 テスト", "!!??.. (a)", "a\x0bb\x0cc\td", "", None, "x" * 5000, "ÀÉÎ Õ×÷ ÿÞ \u0301a e\u0301 \u00a0q\u2003r\x85s", "a's 'll it'd"]
    coder = tokens.WordEncoder(path, 1)
    coder.MOST_PIECES, coder.TOGETHER = 3, 7
    many = [t for t in odd for _ in range(2)] + odd * 9
    for text, raw in zip(many, [x for i in range(0, len(many), 11) for x in coder.encode(pa.array(many[i : i + 11]))], strict=True):
        text = text or ""
        assert np.frombuffer(raw, coder.kind).tolist() == library.encode(text, add_special_tokens=False).ids + [1], text
    out = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.tokenized(df).collect()), key=lambda x: x[0])
    assert len(out) == len(rows) and [d for _, d, *_ in out if d is not None] == sorted(r[0] for r in rows if r[0] is not None)
    at, want = 0, Counter()
    for start, _, n, _ in out:
        assert start == at
        at += n
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((d, n, c) for _, d, n, c in out) == want
    assert tokens.tokenized(empty).count() == 0


def test_shards_refuse_damage():
    blob = tokens.pack([(1, b"\x01\x00\x02\x00"), (None, b"\x03\x00")], b"", 2, 1)
    shard = tokens.Shard(blob, b"")
    assert shard.doc_ids == [1, None] and shard.ids(0).tolist() == [1, 2] and shard.ids(1).tolist() == [3]
    with pytest.raises(ValueError):
        tokens.Shard(blob[:-40] + bytes([blob[-40] ^ 1]) + blob[-39:], b"")
    with pytest.raises(ValueError):
        tokens.Shard(blob, b"other")


def test_restoring():
    rng = np.random.default_rng(1)
    words = ["idiot", "loser", "moron", "stupid", "scum", "clown", "pathetic", "letter", "good", "people", "about"]
    text = " ".join(rng.choice(words, 20000))
    classes = toxicity._class_table()
    s = classes[np.frombuffer(f"  {text} ".encode("utf-32-le"), "<u4")]
    counts = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    model = np.log((counts + 1e-3) / (counts.sum(2, keepdims=True) + 0.064)).ravel()
    r = toxicity.Restorer(model)
    for bad, good in {"1d10t": "idiot", "l0ser": "loser", "m.o.r.o.n": "moron", "stuuupiiid": "stupid", "$cum": "scum", "cl0wn!!": "clown", "p4th3tic": "pathetic", "i-d-i-o-t": "idiot"}.items():
        assert good in r.forms(bad), (bad, r.forms(bad))
    assert r.forms("letter,") == ["letter"] and r.forms("good") == ["good"]
    assert "=moron" in r.spaced("you m o r o n there")


def test_restoring_long_and_sparse_disguises():
    rng = np.random.default_rng(1)
    words = ["idiot", "loser", "moron", "stupid", "shit", "bastard", "ass", "letter", "good", "people", "about"]
    text = " ".join(rng.choice(words, 20000))
    classes = toxicity._class_table()
    s = classes[np.frombuffer(f"  {text} ".encode("utf-32-le"), "<u4")]
    counts = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    r = toxicity.Restorer(np.log((counts + 1e-3) / (counts.sum(2, keepdims=True) + 0.064)).ravel())
    for bad, good in {"st" + "u" * 60 + "pid": "stupid", "good.people.about.stupid.letter.idiot.good.people": "stupid", "$h!7": "shit", "@$$": "ass", "b.@.s.t.@.r.d": "bastard"}.items():
        assert good in r.forms(bad), (bad, r.forms(bad))
    for bad, good in {"you a s s there": "ass", "you m  o  r  o  n there": "moron", "m\no\nr\no\nn": "moron", "you st up id there": "stupid"}.items():
        assert f"={good}" in r.spaced(bad), (bad, r.spaced(bad))
    for same in ("me@good.people.org", "$45.50", "http://good.org/a_b", "10,000"):
        assert len(r.forms(same)) == 1


def test_decoding_finds_the_best_path():
    """The lattice's best path against all readings of a token."""
    import random

    rng = random.Random(3)
    rows = rng.choices(["idiot", "stupid", "letter", "good", "people", "about", "toad", "seed"], k=3000)
    classes = toxicity._class_table()
    s = classes[np.frombuffer(f"  {' '.join(rows)} ".encode("utf-32-le"), "<u4")]
    counts = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    model = np.log((counts + 1e-2) / (counts.sum(2, keepdims=True) + 0.64)).astype(np.float32).ravel()

    def options(c, before, run):
        found = [(c, 0.0)] if c.isalpha() else []
        if c.isalpha() and c == before:
            found.append(("", toxicity.DOUBLE if run == 2 else toxicity.LONGER))
        found += [(x, toxicity.SWAP) for x in toxicity.LOOKALIKES.get(c, "")]
        if c in toxicity.SEPARATORS or not found:
            found.append(("", toxicity.DROP))
        elif c == before and not c.isalpha():
            found.append(("", toxicity.DOUBLE if run == 2 else toxicity.LONGER))
        return found

    def score(word):
        symbols = [0, 0, *(toxicity.INDEX.get(c, toxicity.OTHER) for c in word), 0]
        return sum(float(model[(a * 64 + b) * 64 + c]) for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))

    r = toxicity.Restorer(model)
    for _ in range(300):
        token = "".join(rng.choice("idotseagl10!3@$.-*67 ".strip()) for _ in range(rng.randrange(1, 8)))
        values = brute.readings(token, options, score)
        got = r.decode(token)
        assert values[got] == pytest.approx(max(values.values()), abs=1e-4), (token, got)


def test_nothing_hopeful_is_skipped():
    """The scorer's shortcut gives what decoding every token and run gives."""
    import random

    rng, letters = random.Random(5), "abdeilmnorstu"
    words = ["idiot", "stupid", "moron", "ass", "loser", "trash"]
    rows = rng.choices([*words, "letter", "good", "some", "island", "idea"], k=3000)
    classes = toxicity._class_table()
    s = classes[np.frombuffer(f"  {' '.join(rows)} ".encode("utf-32-le"), "<u4")]
    counts = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    model = np.log((counts + 1e-2) / (counts.sum(2, keepdims=True) + 0.64)).astype(np.float32).ravel()
    weights = {f: 1 + rng.random() for w in words for f in toxicity.word_features(w)} | {"=1d10t": 2.0}
    scorer, plain = toxicity.Scorer(model, weights), toxicity.Restorer(model)

    def disguised(word):
        out = ""
        for c in word:
            c = rng.choice([c, c, c, *[x for x, y in toxicity.LOOKALIKES.items() if c in y]])
            out += c * rng.choice([1, 1, 1, 2, 4]) + rng.choice(["", "", "", ".", " ", "-", "9"])
        return out

    for _ in range(400):
        text = " ".join(rng.choice([disguised(rng.choice(words)), "".join(rng.choices(letters, k=rng.randrange(1, 8))), rng.choice(rows) + rng.choice(".,!?")]) for _ in range(6))
        marks = {frozenset(f for f in plain.features(t) if f in weights) for t in set(text.lower().split())}
        marks.add(frozenset(f for f in plain.spaced(text.lower()) if f in weights))
        marks.discard(frozenset())
        assert scorer(text) == (max((weights[f] for m in marks for f in m), default=0.0), len(marks)), text


def test_toxicity(awkward, empty, spark):
    import random

    rng = random.Random(9)
    common = [f"plain{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        words, bad = rng.choices(common, k=40), i % 5 == 0
        if bad:
            words[7] = rng.choice(["zorkface", "blimpert", "z0rkface" if i % 2 else "zorkface"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.98 * len(held)
    # labels of held-out rows change nothing
    other = toxicity.fit(df, known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert other.weights == model.weights and np.allclose(other.beta, model.beta)
    df, rows = awkward
    nulls = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    out = toxicity.score(df, toxicity.fit(df, nulls)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.clean_documents(df, known).columns == df.columns
    assert toxicity.score(empty, toxicity.fit(empty, nulls)).count() == 0


def test_texts_of_megabytes(spark, documents):
    """One text of some megabytes beside short ones goes through every operator whole."""
    import random

    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(50_000)]
    long = " ".join(rng.choices(words, k=500_000))
    passage = " ".join(rng.choices(words, k=100))
    rows = [(1, long + " " + passage, "s"), (2, None, "s"), (3, passage, "s"), (4, "short one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    n = len(rows[0][1].split())
    got = lambda out: {r.doc_id: r for r in out.collect()}
    assert got(mixing.mix(df))[1]["size"] == n
    assert got(quality.quality(df))[1].n_words == n and got(quality.quality(df))[1].kept
    removed = got(suffix_dedup.dedup_bytes(df))
    assert (removed[1].n_bytes, removed[1].n_removed, removed[3].n_removed) == (len(rows[0][1]), len(passage), len(passage))
    left = got(substring_dedup.dedup_windows(df))
    assert (left[1].n_words, left[1].n_removed, left[3].n_removed) == (n, 0, 100)
    assert got(near_dup.near_duplicates(df))[1].class_id == 1
    labels = spark.createDataFrame([(1, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert got(toxicity.score(df, toxicity.fit(df, labels)))[1].predicted == 0
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    hit = got(decontam.decontaminate(df, items))
    assert (hit[1].n_hit, hit[1].contaminated, hit[3].contaminated) == (100, False, True)
    assert got(pii.personal_data(df))[1].spans == ""
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(rows[0][1], add_special_tokens=False).ids + [1]
    assert got(tokens.tokenized(df))[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


class _Unset:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.chosen = master, None

    def get(self, *_):
        return None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            common.shared_dir(_Unset(master))
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert common.shared_dir(_Unset(master))
