"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def windows(docs, size=13):
    """op4: {(row number): (n_words, n_removed, kept_sha256)}; docs are (doc_id, text)."""
    last = 1 << 63
    words = [WORD.findall(t or "") for _, t in docs]
    least: dict = {}
    for (d, _), ws in zip(docs, words, strict=True):
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            least[w] = min(least.get(w, last), last if d is None else d)
    out = []
    for (d, _), ws in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(ws) - size + 1):
            if least[tuple(ws[i : i + size])] < (last if d is None else d):
                gone.update(range(i, i + size))
        out.append((len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return out


def byte_repeats(texts, size=400):
    """op3: (n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone, end = bytearray(len(t)), 0
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                start = max(i, end)
                gone[start : i + size] = b"\1" * (i + size - start)
                end = i + size
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def near_classes(docs, threshold=0.8, size=5):
    """op5: class id of each row; docs are (doc_id, text) with ids."""
    sets = []
    for _, t in docs:
        ws = WORD.findall(t or "")
        sets.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in having[x])
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                parent[find(i)] = find(j)
        for x in s:
            having[x].append(i)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(docs))]


def contaminated(docs, bench, size=13):
    """op7: (n_words, n_hit, n_items, items_sha256, contaminated) of each text."""
    lower = lambda t: TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for item, t in bench:
        ws = lower(t)
        for i in range(max(1, len(ws) - size + 1)) if ws else ():
            wins[tuple(ws[i : i + size])].add("" if item is None else str(item))
    out = []
    for _, t in docs:
        ws, hit, items = lower(t), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                found = wins.get(tuple(ws[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((len(ws), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def base_spans(text):
    """op8: sorted (start, kind number, kind, end)."""

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m.group()))


def mix_targets(sizes, weights=(1, 2, 3), most=3):
    """op1: the target of each source, by sharing again and again what is above the most."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def readings(token, options, score):
    """op6: the value of every reading of a token; ``options`` gives (text, cost) for a character, the one before and the length of its run."""
    paths, before, run = {"": 0.0}, "", 0
    for c in token:
        run, new = (run + 1 if c == before else 1), {}
        for out, cost in paths.items():
            for x, y in options(c, before, run):
                new[out + x] = max(new.get(out + x, float("-inf")), cost + y)
        paths, before = new, c
    return {out: cost + score(out) for out, cost in paths.items()}


def disclosing(docs, threshold=0.7, level=0.05):
    """op8: {(row number): {(start, end)}} of disclosing terms; no document has more than one base span."""
    import math

    import regex

    term = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}")
    n, held, rest = len(docs), {}, {}
    for i, (_, t) in enumerate(docs):
        spans = base_spans(t)
        assert len(spans) < 2
        for a, kind, _, b in spans:
            held[i] = ((kind, t[a:b].lower()), (t[max(0, a - 80) : a], t[b : b + 80]))
            rest[i] = t[:a] + " " * (b - a) + t[b:]
    words = {i: {w.lower() for w in term.findall(r)} for i, r in rest.items()}
    everywhere = Counter(w for _, t in docs for w in {x.lower() for x in term.findall((t or "").lower())})
    near = Counter(w for ws in words.values() for w in ws)
    units, of_entity, entity_units, joint, joint_units = defaultdict(set), Counter(), defaultdict(set), Counter(), defaultdict(set)
    for i, (entity, unit) in held.items():
        of_entity[entity] += 1
        entity_units[entity].add(unit)
        for w in words[i]:
            units[w].add(unit)
            joint[entity, w] += 1
            joint_units[entity, w].add(unit)
    content = {e: math.log(n / k) for e, k in of_entity.items()}
    pmi = lambda e, w, k: math.log(n * joint[e, w] / (k * of_entity[e]))
    tried = [(e, w) for e, w in joint if content[e] > 0 and math.log(n / near[w]) >= threshold * content[e] - 1e-12 and pmi(e, w, near[w]) >= threshold * content[e] - 1e-12]
    marked = set()
    for e, w in tried:
        expected, seen = everywhere[w] * len(entity_units[e]) / n, len(joint_units[e, w])
        of_pair = seen * (1 + math.log(expected / seen)) - expected if seen > expected else 0.0
        tries, share = len(units[w]) + max(everywhere[w] - near[w], 0), len(held) / n
        part = len(units[w]) / tries
        apart = (1 - part) * math.log((1 - part) / max(1 - share, 1e-300)) if part < 1 else 0.0
        of_term = -tries * (part * math.log(part / share) + apart) if part > share else 0.0
        sure = of_pair <= math.log(level / len(tried)) or of_term <= math.log(level / len({w for _, w in tried}))
        if sure and pmi(e, w, everywhere[w]) >= threshold * content[e] - 1e-12:
            marked.add((e, w))
    return {i: {(m.start(), m.end()) for m in term.finditer(rest[i]) if (held[i][0], m.group().lower()) in marked} if i in held else set() for i in range(n)}
