"""Archives, their salvage, and the pipeline."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from docquire.llm import toxicity, warc

from . import brute


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é" * 5000), (None, "http://e/", "<p>one</p>"), (None, None, "alone"), (7, "u", "WARC/1.1\r\n\r\n\r\n")]


def archive(compressed=True):
    records = [warc.write_record(i, u, (h or "").encode(), digest((h or "").encode())) for i, u, h in PAGES]
    return [warc.member(r) if compressed else r for r in records]


def test_archived_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as archive", "2 as sha1")
    want = Counter()
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        least = first.setdefault(raw, i)
        want[i, len(raw), digest(raw), "response" if least == i else "revisit", None if least == i else least] += 1
    assert Counter(tuple(r) for r in warc.archived_pages(df).collect()) == want
    assert warc.archived_pages(df.filter("false")).count() == 0
    all_full = warc.archived_pages(df, min_revisit_bytes=10**6)
    assert all_full.filter("record_type = 'revisit'").count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage(compressed):
    parts = archive(compressed)
    whole = b"".join(parts)
    assert [x["page_id"] for k, x in warc.salvage(whole) if k == "record"] == [p[0] for p in PAGES]
    # damage in the second record and garbage before the fourth
    hurt = bytearray(parts[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + bytes(hurt) + parts[2] + b"garbage" + b"".join(parts[3:])
    found = list(warc.salvage(data))
    assert [x["page_id"] for k, x in found if k == "record"] == [1, 3, 4, 5, None, None, 7]
    gaps = [(x["start"], x["end"]) for k, x in found if k == "gap"]
    at = len(parts[0]) + len(hurt) + len(parts[2])
    assert gaps == [(len(parts[0]), len(parts[0]) + len(hurt)), (at, at + 7)]
    # a file that ends in the middle of a record
    cut = list(warc.salvage(whole[: -len(parts[-1]) // 2]))
    assert sum(k == "record" for k, _ in cut) == len(PAGES) - 1 and cut[-1][0] == "gap"
    assert list(warc.salvage(b"")) == [] and [k for k, _ in warc.salvage(b"nothing here")] == ["gap"]


def test_archives_of_others():
    """Members of several records, plain records between members, records without HTTP, page number or digest; damage in a sound member."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 8\r\n\r\na: b\r\n\r\n\r\n\r\n"
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello!\r\n\r\n"
    parts = [warc.write_record(i, u, (h or "").encode(), digest((h or "").encode())) for i, u, h in PAGES]
    blob = warc.member(info + parts[0] + parts[1]) + parts[4] + b"junk" + bare + warc.member(parts[7]) + warc.member(parts[0] + b"WARC/1.1\r\nbroken\r\n\r\n" + parts[4]) + parts[7]
    found = list(warc.salvage(blob))
    got = [(x["record_type"], x["page_id"]) for k, x in found if k == "record"]
    assert got == [("warcinfo", None), ("response", 1), ("response", 2), ("response", 5), ("response", None), ("response", 7), ("response", 1), ("response", 5), ("response", 7)]
    gaps = [(x["end"] - x["start"], x["reason"]) for k, x in found if k == "gap"]
    assert len(gaps) == 2 and gaps[0][0] == 4 and "colon" in gaps[1][1]
    assert [x["payload"] for k, x in found if k == "record"][4] == b"hello!"


def test_damaged_archives_in_spark(spark):
    parts = archive()
    blob = parts[0] + b"\x00" * 100 + b"".join(parts[1:])
    rows = warc.read_archives(spark.createDataFrame([("a.warc.gz", bytearray(blob))], "archive string, blob binary"), payloads=True)
    gap = rows.filter("gap").first()
    assert (gap["archive"], gap["start"], gap["end"]) == ("a.warc.gz", len(parts[0]), len(parts[0]) + 100)
    assert bytes(rows.filter("page_id = 5").first()["payload"]).decode() == "é" * 5000


def test_pipeline(spark, documents):
    """Every stage against the plain version of what it decides, on what the stage before it kept."""
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    import public_tokenizers

    def rows_of(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    columns, before = docs.columns, rows_of(docs)
    kept = {}
    for name in list(stages)[:-1]:
        docs = pipeline.settle(stages[name](spark, docs, documents), name)
        assert docs.columns == columns
        kept[name] = rows_of(docs)
    toxic = {r.doc_id for r in toxicity.op6_toxicity(spark, documents).filter("predicted = 1").collect()}
    assert Counter(kept["toxicity"]) == Counter((d, t) for d, t in before if d not in toxic)
    classes = brute.near_classes(kept["toxicity"])
    assert Counter(kept["near_duplicates"]) == Counter((d, t) for (d, t), c in zip(kept["toxicity"], classes, strict=True) if d == c)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{documents}/benchmark.parquet").collect()]
    found = brute.contaminated(kept["near_duplicates"], bench)
    assert Counter(kept["decontamination"]) == Counter(x for x, f in zip(kept["near_duplicates"], found, strict=True) if not f[-1])
    # as often as the mix takes them, one cut short in each source
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{documents}/documents.parquet").select("doc_id", "source").collect()}
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t in kept["decontamination"]}
    total, by_source = Counter(), Counter()
    for d, t in kept["mixing"]:
        total[d] += len(brute.WORD.findall(t))
        by_source[source[d]] += len(brute.WORD.findall(t))
    assert all(total[d] <= 3 * sizes[d] for d in total)
    targets = brute.mix_targets(Counter({s: sum(n for d, n in sizes.items() if source[d] == s) for s in set(source.values())}))
    assert {s: by_source[s] for s in targets} == {s: int(t + 1e-6) for s, t in targets.items()}
    partial = Counter(source[d] for d in total if total[d] % max(sizes[d], 1))
    assert all(n <= 1 for n in partial.values())
    library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    out = sorted(stages["tokens"](spark, docs, documents).collect(), key=lambda r: r.start)
    ids = sorted(((d, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for d, t in kept["mixing"]), key=lambda x: x[0])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    assert [r.doc_id for r in out] == [d for d, _ in ids]
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_pipeline_on_awkward_rows(spark, awkward, documents):
    import corpus_pipeline as pipeline

    for docs in (awkward[0], awkward[0].filter("false")):
        for name, stage in pipeline.STAGES:
            docs = pipeline.settle(stage(spark, docs, documents), name)
        docs.count()
