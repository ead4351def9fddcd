"""Phrase mining against plain counts and whole numbers, with every kind of trouble."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import phrases
from tests.llm import brute


def pieces_of(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER))]


def counts_of(rows, longest):
    out = defaultdict(Counter)
    for text, lang in rows:
        for w in pieces_of(text):
            for m in range(1, longest + 1):
                out[lang or "und"].update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
            out[lang or "und"][""] += len(w)
    return out


def plain(counts, least=10, percent=50, top=2000):
    out = []
    for lang, f in counts.items():
        chosen = {p: a for p, a in f.items() if " " in p and a >= least}
        rows = []
        for p, a in chosen.items():
            w = p.split(" ")
            if any(100 * b >= percent * a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in chosen.items()):
                continue
            cuts = [(1000000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, f[""], -s))
    return sorted(out)


def texts(rng, n):
    words = "alpha Beta gamma ÀB delta é zeta x1".split()
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", " \x0b", "é "]) for _ in range(rng.randrange(80))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("longest,shard", [(3, 1 << 24), (3, 500), (5, 2000), (2, 500)])
def test_collocations(spark, monkeypatch, longest, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rows = texts(random.Random(longest), 150) + [(None, "en"), ("", None), ("...", "xx"), (" lone ", "yy"), ("same pair here " * 30, "en"), ("z z " * 50, "de")]
    df = spark.createDataFrame([(i, t, g, 5, "p") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, f int, phrase string").repartition(4)
    got = sorted(map(tuple, phrases.collocations(df, longest=longest).collect()))
    assert got == plain(counts_of(rows, longest)) and len(got) > 20
    few = sorted(map(tuple, phrases.collocations(df, longest=longest, top=3).collect()))
    assert few == plain(counts_of(rows, longest), top=3)
    none = phrases.collocations(df.limit(0))
    assert none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and none.count() == 0


def test_long_text_and_repeats(spark):
    rows = [(brute.sentence(random.Random(1), 30000), "en")] + [("one two, three four five", "fr")] * 40
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain(counts_of(rows, 3))


def test_exact_beyond_64_bits(spark):
    """Squares and products of counts that pass 64 bits, with quotients just at a whole number."""
    a = 3 * 10**13
    f = {"": 10**15, "x": a, "y": a + 1, "z": a * 7, "x y": a, "y z": a, "u": 10**14, "v": 10**14 - 1, "u v": 10**14 - 1}
    df = spark.createDataFrame([("en", p, n) for p, n in f.items()], "lang string, phrase string, f long")
    assert sorted(map(tuple, phrases.ranked(df).collect())) == plain({"en": Counter(f)})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=3), max_size=60), st.integers(min_value=1, max_value=6))
def test_suffix_array(ids, depth):
    """The suffixes are in order of ``depth`` ids, and neighbours have in common what they have."""
    a = np.array(ids, dtype=np.int64)
    order = phrases.suffix_array(a, depth).tolist()
    heads = [(ids[i:] + [0] * depth)[:depth] for i in order]
    assert sorted(order) == list(range(len(ids))) and heads == sorted(heads)
    want = [0] + [next((d for d in range(depth) if x[d] != y[d]), depth) for x, y in zip(heads, heads[1:])]
    assert phrases.common_prefixes(a, np.array(order, dtype=np.int64), depth).tolist() == want[: len(ids)]
