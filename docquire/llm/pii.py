"""Personal data: patterns, and terms that give protected entities away.

Patterns find the base spans (e-mail, IP, card, phone). Over the whole corpus, the
co-occurrence of a document's terms with a span's value, the protected entity, estimates how much a
term reveals: its pointwise mutual information with the entity as a share of the entity's information content. A
term that reveals more than the threshold, and keeps such company by no accident, is a span of kind
"term" wherever it stands in a document that holds the entity, and is generalised with the rest.

    IC(e) = log(N / n_e)    PMI(t, e) = log(N n_te / (n_t n_e))    disclosure = PMI / IC

n counts documents. No accident means that chance would hardly bring the term together with this entity
as often, or with protected entities as a whole. Both count different contexts of spans, so that copies of one text don't add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, settle, table, text_key

#: The kinds in order of listing. The patterns match what the plain ones in the comments match, but
#: start only where a run starts and never go back, so their time is linear on any text.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ with at least 14 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
CONTEXT = 80
#: A word with the digits in it.
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, d(i)).otherwise(F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i)))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == 1, value.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == 2, F.length(digits).between(14, 19) & luhn(F.when(F.length(digits).between(14, 19), digits).otherwise("1")))
        .when(kind == 3, F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def _pieces(text: Column, pattern: str, needed: str | None) -> Column:
    """The matches of a pattern, each with the length of what stands between it and the match before, and its surroundings."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    if needed:
        found = F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast("array<string>"))
    return found


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Settled tables: one row per document (``rid, doc_id, key``, and ``text`` if it may have spans), and one per valid base span (``rid, kind, start, end, value, before, after``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    rows = rows.select("*", *[_pieces(F.col("text"), p, NEEDED[k]).alias(k) for k, p in PATTERNS.items()])
    parts = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        between = F.when(F.size(kind) > 0, F.split("text", pattern)).otherwise(F.array().cast("array<string>"))
        zipped = F.transform(
            F.arrays_zip(F.col(kind).alias("value"), F.slice(between, F.lit(1), F.size(kind)).alias("before"), F.slice(between, F.lit(2), F.greatest(F.size(kind), F.lit(0))).alias("after")),
            lambda x, i: F.struct(
                i.alias("nth"), x["value"].alias("value"), F.length(x["before"]).alias("gap"),
                F.right(x["before"], F.lit(CONTEXT)).alias("before"), F.left(x["after"], F.lit(CONTEXT)).alias("after"),
            ),
        )
        parts.append(F.struct(F.lit(number).alias("kind"), zipped.alias("all")))
    table_ = settle(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", "text", F.filter(F.array(*parts), lambda p: F.size(p["all"]) > 0).alias("found")).withColumn("text", F.when(F.size("found") > 0, F.col("text"))), "pii")
    spans = table_.filter(F.size("found") > 0).select("rid", "key", F.explode("found").alias("f")).select("rid", "key", "f.kind", F.explode("f.all").alias("x")).select("rid", "key", "kind", "x.*")
    # where a match starts: all gaps up to it and all matches before it
    along = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(along)
    spans = spans.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("value"))
    spans = spans.filter(_valid(F.col("kind"), F.col("value")))
    return table_.drop("found"), settle(spans.select("rid", "key", "kind", "start", "end", "value", "before", "after"), "spans")


def _outside(base: DataFrame, spans: DataFrame) -> DataFrame:
    """``rid, rest`` of the documents with spans: their texts with blanks in place of the spans, so that places stay."""
    at = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"))
    text = F.col("text")
    cut = lambda start, n: F.substring(text, (start + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.concat(a["out"], cut(a["at"], s["start"] - a["at"]), F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], a["at"]), F.lit(0)).cast("int"))).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return base.join(at, "rid").select("rid", F.aggregate("at", start, step, lambda a: F.concat(a["out"], cut(a["at"], F.length(text)))).alias("rest"))


def _places(rest: DataFrame) -> DataFrame:
    """Every term of the texts with its places: ``rid, term, start, end``."""
    found = F.regexp_extract_all("rest", F.lit(f"({TERM})"), F.lit(1))
    zipped = F.arrays_zip(found.alias("word"), F.slice(F.split("rest", TERM), F.lit(1), F.size(found)).alias("gap"))
    rows = rest.select("rid", F.posexplode(zipped).alias("nth", "x"))
    along = Window.partitionBy("rid").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("x.gap") + F.length("x.word")).over(along))
    return rows.select("rid", F.lower("x.word").alias("term"), (F.col("end") - F.length("x.word")).alias("start"), "end")


def disclosing_terms(docs: DataFrame, base: DataFrame, spans: DataFrame, text_col: str, threshold: float, level: float) -> DataFrame | None:
    """Places of the terms that reveal an entity, in all documents that hold it; None where there are none."""
    context = spans.select("rid", F.xxhash64("kind", F.lower("value")).alias("entity"), F.xxhash64("before", "after").alias("context"))
    known = settle(context.groupBy("entity", "rid").agg(F.min("context").alias("unit")), "known")
    if known.isEmpty():
        return None
    rest = settle(_outside(base, spans), "outside")
    terms = F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(f"({TERM})"), F.lit(1)), F.lower))
    words = settle(rest.select("rid", F.explode(terms).alias("term")), "words")
    held = known.groupBy("rid").agg(F.min("unit").alias("unit"))
    # a term's documents among those with spans are at least so many of all; what is too common by them already can't disclose
    pooled = words.join(held, "rid").groupBy("term", "unit").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.sum("c").alias("n_least"), F.count(F.lit(1)).alias("s_t"))
    pooled = settle(pooled, "pooled")
    n, holding = float(base.count()), rest.count()
    entities = known.groupBy("entity", "unit").agg(F.count(F.lit(1)).alias("c")).groupBy("entity").agg(F.sum("c").alias("n_e"), F.count(F.lit(1)).alias("s_e"))
    content = F.log(F.lit(n) / F.col("n_e"))
    pmi = lambda n_t: F.log(F.lit(n) * F.col("n_te") / (F.col(n_t) * F.col("n_e")))
    sized = settle(known.join(entities, "entity").filter(content > 0), "entities")
    near = sized.join(words, "rid").join(pooled, "term").filter(F.log(F.lit(n) / F.col("n_least")) >= threshold * content)
    near = near.groupBy("entity", "term", "unit", "n_e", "s_e", "n_least", "s_t").agg(F.count(F.lit(1)).alias("c"))
    joint = near.groupBy("entity", "term", "n_e", "s_e", "n_least", "s_t").agg(F.sum("c").alias("n_te"), F.count(F.lit(1)).alias("s_te"))
    joint = settle(joint.filter(pmi("n_least") >= threshold * content), "joint")
    if joint.isEmpty():
        return None
    # how many documents of the corpus have each of those terms
    wanted, frequency = settle(joint.select("term").distinct(), "terms"), None
    have = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
    for block in blocks(wanted, "term"):
        part = have.join(block, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
        frequency = part if frequency is None else frequency.unionByName(part)
    # Chernoff bounds on the chance of so much company by accident, over all pairs and all terms that are tried
    expected = F.col("n_t") * F.col("s_e") / F.lit(n)
    of_pair = F.when(F.col("s_te") > expected, F.col("s_te") * (1 + F.log(expected / F.col("s_te"))) - expected).otherwise(0.0)
    tries, share = F.col("s_t") + F.greatest(F.col("n_t") - F.col("n_least"), F.lit(0)), holding / n
    part = F.col("s_t") / tries
    apart = F.when(part < 1, (1 - part) * F.log((1 - part) / F.lit(max(1 - share, 1e-300)))).otherwise(0.0)
    of_term = F.when(part > share, -tries * (part * F.log(part / F.lit(share)) + apart)).otherwise(0.0)
    sure = (of_pair <= math.log(level / joint.count())) | (of_term <= math.log(level / wanted.count()))
    rated = joint.join(frequency, "term").filter((pmi("n_t") >= threshold * content) & sure).select("entity", "term")
    marked = settle(known.select("entity", "rid").join(settle(rated, "disclosing"), "entity").select("rid", "term").distinct(), "marked")
    places = _places(rest.join(marked.select("rid").distinct(), "rid", "left_semi"))
    return places.join(marked, ["rid", "term"]).select("rid", "start", "end")


def _is_kind(i: int):
    return lambda s: s["kind"] == i


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, level: float = 0.05) -> DataFrame:
    """The personal data of each document.

    Returns one row per input row: ``doc_id, key`` (hash of the text), ``n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` and ``found``, the
    spans as an array of (start, kind, end) in code points. Terms inside base spans are not listed again.
    Null texts are empty; empty texts have no spans; a null id is kept. Repeated rows get equal rows. An empty table gives none. Only the named columns are read.
    """
    base, spans = matches(docs, id_col, text_col)
    span = F.struct("start", "kind", "end")
    found = spans.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("base"))
    rows = base.join(found, "rid", "left")
    terms = disclosing_terms(docs, base, spans, text_col, threshold, level)
    if terms is None:
        rows = rows.withColumn("terms", F.lit(None).cast(rows.schema["base"].dataType))
    else:
        terms = terms.withColumn("kind", F.lit(len(PATTERNS)))
        rows = rows.join(terms.groupBy("rid").agg(F.collect_list(span).alias("terms")), "rid", "left")
    none = F.array().cast(rows.schema["base"].dataType)
    rows = rows.select("doc_id", "key", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.select("doc_id", "key", "base", F.sort_array(F.concat("base", apart)).alias("found"))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id",
        "key",
        *[F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
        "found",
    )


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every span of its texts generalised to its kind, as in ``<EMAIL>``; overlapping spans become one.

    Null texts stay null, empty ones empty. Repeated rows stay as many. An empty table stays empty.
    """
    found = personal_data(docs, id_col, text_col, **how).filter(F.size("found") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("found").alias("_found")).dropDuplicates(["_id", "_key"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (text_key(text) == found["_key"]), "left")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"])).alias("out"))
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    new = F.aggregate("_found", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.col("_found").isNull(), F.col(text_col)).otherwise(new)
    return rows.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("key", "found")
