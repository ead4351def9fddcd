"""Heavy nodes of the SimHash index: split until they are light, without losing a link."""

import random
from itertools import combinations

import pytest

from corpusloom.llm import simhash
from tests.llm import brute

FULL = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def same_classes(spark, fps, blocks=6, bits=8):
    got = simhash.linked_classes(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, blocks, bits).collect()
    root, want = {r.node & FULL: r.root for r in got}, brute.groups(fps)
    mine, theirs = {}, {}
    for f in fps:
        mine.setdefault(root.get(f, signed(f)), set()).add(f)
        theirs.setdefault(want[f], set()).add(f)
    return sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_tables_below_a_mask():
    """Whatever 4 free bits differ, some table below a mask still agrees; masks grow, shifts point into the free bits."""
    rng = random.Random(1)
    for _, mask, _ in simhash.index_tables(4, 6, 8)[:3]:
        for _, sub, _ in simhash.index_tables(4, 6, 8, mask & FULL)[:2]:
            below = simhash.index_tables(4, 6, 8, sub & FULL)
            free = [i for i in range(64) if not sub >> i & 1]
            assert all(m & sub == sub and (m & FULL).bit_count() > (sub & FULL).bit_count() and not m >> s & 1 for _, m, s in below)
            for _ in range(200):
                flips = sum(1 << i for i in rng.sample(free, 4))
                assert any(not flips & m & FULL for _, m, _ in below)


@pytest.mark.parametrize("heavy,blocks,bits", [(2, 6, 8), (20, 7, 2)])
def test_split_nodes_lose_nothing(spark, monkeypatch, heavy, blocks, bits):
    """Families that share some bits, chains within them, and strangers, with nodes split at a few members."""
    monkeypatch.setattr(simhash, "HEAVY_NODE", heavy)
    rng = random.Random(heavy)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        top = rng.getrandbits(30) << 34
        family = [top | rng.getrandbits(34) for _ in range(90)]
        fps.update(family)
        for f in family[:30]:  # links at 1 to 5 bits, some of which are too far
            fps.add(f ^ sum(1 << i for i in rng.sample(range(34), rng.randrange(1, 6))))
    centre = rng.getrandbits(64)
    fps.update(centre ^ (1 << i | 1 << j) for i, j in combinations(range(12), 2))
    assert same_classes(spark, fps, blocks, bits)


def test_family_in_one_node(spark, monkeypatch):
    """Members of one pattern that aren't linked don't meet each other in pairs: what is compared stays near their number."""
    rng = random.Random(9)
    top = rng.getrandbits(22) << 42
    fps = {top | rng.getrandbits(42) for _ in range(3000)}
    planted = [(f, f ^ sum(1 << i for i in rng.sample(range(42), 4))) for f in sorted(fps)[:50]]
    fps.update(b for _, b in planted)
    sizes = []
    real = simhash._split

    def seen(classed, distance, group_bits):
        out = real(classed, distance, group_bits)
        sizes.extend(r["count"] for r in out.groupBy("mask", "node").count().collect())
        return out

    monkeypatch.setattr(simhash, "_split", seen)
    got = {r.node & FULL: r.root for r in simhash.linked_classes(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert all(got[a] == got[b] for a, b in planted)
    assert sum(n * n for n in sizes) < 0.05 * len(fps) ** 2 and max(sizes) <= simhash.HEAVY_NODE
