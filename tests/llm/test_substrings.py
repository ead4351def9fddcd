"""Removal of repeated passages against plain windows, with every kind of trouble."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import substrings
from tests.llm import brute


def plain(texts, length=35):
    """(n_words, spans, kept) by text, from the words themselves."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        spans = [(a, b) for a in range(len(w)) if gone[a] and (a == 0 or not gone[a - 1]) for b in [next((i for i in range(a, len(w)) if not gone[i]), len(w))]]
        out.append((len(w), spans, b" ".join(x for x, y in zip(w, gone) if not y).decode()))
    return out


def check(spark, rows, schema, length=35):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = sorted((repr(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r.kept) for r in substrings.repeated_passages(df, length=length).collect())
    assert got == sorted((repr(r[0]), *p) for r, p in zip(rows, plain([r[1] for r in rows], length)))


def passages(rng, n, length):
    """Texts that share passages just at, below and above the length, at starts, ends and inside, and loops in one text."""
    parts = [brute.sentence(rng, k) for k in (length - 1, length, length + 1, 3 * length)]
    out = []
    for i in range(n):
        part = parts[i % 4]
        before, after = brute.sentence(rng, rng.randrange(60)), brute.sentence(rng, rng.randrange(60))
        out.append((i, " \t".join([before, part, after]) if i % 5 else f"{part}\n{after}{' round and' * 40 if i % 3 == 0 else ''}"))
    return out


@pytest.fixture
def small(monkeypatch):
    """Small chunks, groups and samples, so that every path is taken."""
    for name, value in {"CHUNK_BYTES": 4000, "SLAB": 256, "SAMPLE": 2, "SEEN": 2, "HEAVY": 4, "GROUP": 64, "PART_BYTES": 500}.items():
        monkeypatch.setattr(substrings, name, value)
    substrings.MADE.clear()


@pytest.mark.parametrize("length", [35, 10, 3])
def test_passages(spark, small, length):
    rng = random.Random(3)
    rows = passages(rng, 80, length) + [(200 + i, brute.sentence(rng, 20) + " " + "x " * 50) for i in range(5)]
    check(spark, rows, "doc_id long, text string", length)


def test_trouble(spark, small):
    rows = [(r[0], r[1], *r[2:]) for r in brute.documents()] + [(70, "w" * 3000 + " " + "é" * 900, *[None] * 6), (71, " ".join(["same"] * 34), *[None] * 6), (72, " ".join(["self"] * 36), *[None] * 6)]
    check(spark, rows, brute.SCHEMA)
    empty = spark.createDataFrame(rows, brute.SCHEMA).limit(0)
    assert substrings.repeated_passages(empty).columns == ["doc_id", "n_words", "spans", "kept"] and substrings.repeated_passages(empty).count() == 0
    clash = spark.createDataFrame([("k", "a b", 1, 2, 3)], "key string, text string, chunk int, place int, n_words int")
    assert substrings.repeated_passages(clash, key="key").collect() == [("k", 2, [], "a b")]


def test_heavy_prefixes_and_paths():
    """Frequent prefixes are extended, a frequent whole path has no group, and equal suffixes share theirs."""
    rng = np.random.default_rng(1)
    paths = rng.integers(0, 3, size=(500, 3)).astype(np.uint32)
    keys = list(substrings.prefix_keys(paths))
    heavy = [np.unique(keys[0]), keys[1][:1]]
    whole = {paths[0].tobytes()}
    place = substrings.partition(paths, heavy, whole, 50)
    assert [(p == -1) for p in place] == [(r == paths[0]).all() for r in paths]
    assert len({(tuple(r), p) for r, p in zip(paths, place)}) == len({tuple(r) for r in paths})
    found = substrings.below_deep_nodes(paths)
    counts = Counter(map(tuple, paths.tolist()))
    assert found.tolist() == [counts[tuple(r)] > 1 for r in paths.tolist()]
    assert substrings.below_deep_nodes(paths[:0]).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né", max_size=700), max_size=6), st.sampled_from([8, 64]))
def test_words(texts, slab):
    """Word hashes are those of the words, whatever slab they lie in, and words stay with their text."""
    keep, substrings.SLAB = substrings.SLAB, slab
    substrings.MADE.clear()
    try:
        raw = [t.encode() for t in texts]
        chunk = substrings.Chunk(raw, 2)
        assert chunk.words.tolist() == [len(t.split()) for t in raw]
        words = [w for t in raw for w in t.split()]
        hashes = substrings.words_of(np.frombuffer(b" ".join(raw), dtype=np.uint8))[1].tolist()
        assert len(hashes) == len(words) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    finally:
        substrings.SLAB = keep
        substrings.MADE.clear()
