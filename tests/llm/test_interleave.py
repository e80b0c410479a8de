"""The interleave refinement against plain counting."""

import random
from collections import Counter

import pytest

from docquire.llm.interleave import repeated_starts


@pytest.mark.parametrize("shards", [2, 4, 5])
def test_repeats(shards):
    rng = random.Random(shards)
    for size in (1, 3, 20):
        base = bytes(rng.choice(b"abc") for _ in range(120))
        texts = [base, b"", b"a", base[10:70], bytes(rng.choice(b"ab") for _ in range(90)), b"a" * 50, base[60:] + base[:30], b"\x00\xff" * 20]
        seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        want = {(d, i) for d, t in enumerate(texts) for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1}
        assert repeated_starts(texts, size, shards) == want
