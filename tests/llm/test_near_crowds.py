"""Crowded buckets and bands: no link is lost, chance meetings join nothing, and work stays linear."""

import collections

import numpy as np
import pytest

from beatspark.llm import simhash


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    least = {}
    for n in sorted(nodes):
        least.setdefault(find(n), n)
    return {n: least[find(n)] for n in nodes}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_in_crowded_buckets(spark, monkeypatch, radius):
    rng = np.random.default_rng(radius)
    fps = {0b1000, 0b1001, 0b0000, 0b0011}
    for _ in range(40):
        base = int(rng.integers(1 << 62))
        for _ in range(int(rng.integers(1, 8))):
            fps.add(base ^ sum(1 << int(b) for b in rng.integers(0, 62, int(rng.integers(0, 4)))))
    for limit in (1, 24):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in got)
        want = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius]
        assert roots(got, fps) == roots(want, fps)


def crowd(seed, texts, own, shared, copies):
    """Texts that share a passage, so that bands meet by chance, and near copies of some of them."""
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(shared)]
    rows = []
    for k in range(texts):
        words = passage + [f"o{k}x{j}" for j in range(own)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(copies if k % 10 == 0 else 0):
            near = words.copy()
            near[int(rng.integers(shared + 5, shared + own))] = f"c{len(rows)}"
            rows.append((len(rows), " ".join(near)))
    return rows


@pytest.mark.parametrize("limit", [2, 5])
def test_chance_meetings_do_not_percolate(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIRWISE", limit)
    rows = crowd(5, 120, 60, 90, 6)
    sets = [set(simhash.shingles(t).tolist()) for _, t in rows]
    want = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    frame = spark.createDataFrame(rows, "node bigint, text string")
    found = simhash.materialise(simhash._signatures(frame), "t")
    bands = simhash._bands(found)
    sized = simhash.materialise(bands.groupBy("key").agg(simhash.F.count("*").alias("n"), simhash.F.min("node").alias("least")).where("n > 1"), "t")
    assert sized.agg({"n": "max"}).first()[0] > 5  # bands are crowded by chance
    proposed = [(r.a, r.b) for r in simhash._candidates(found, bands, sized).collect()]
    # what is compared as a group are the copies of a text, and no others
    assert max(collections.Counter(roots(proposed, range(len(rows))).values()).values()) <= 7
    got = {r.node: r.root for r in simhash.near_duplicates(frame).collect()}
    assert {n: got.get(n, n) for n in range(len(rows))} == roots(want, range(len(rows)))


def test_a_large_group_of_copies(spark, monkeypatch):
    """A third of all texts are variants of one, every one different."""
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join([f"v{k}", *base, f"u{k}"])) for k in range(150)] + [(1000 + k, " ".join(f"w{j}" for j in rng.integers(0, 5000, 120))) for k in range(300)]
    got = {r.node: r.root for r in simhash.near_duplicates(spark.createDataFrame(rows, "node bigint, text string")).collect()}
    assert got == {k: 0 for k in range(150)}


def test_pipeline_drops_fingerprint_copies(spark):
    """Texts within 2 bits of each other are copies in the pipeline too, where their shingles are less alike than 0.8."""
    import corpus_pipeline

    rng = np.random.default_rng(21)
    low = " ".join("abc" for _ in range(60))  # one shingle outweighs all others: equal fingerprints whatever follows
    far = [" ".join([low, *(f"n{k}x{j}" for j in range(20))]) for k in range(3)]
    other = " ".join(f"w{j}" for j in rng.integers(0, 5000, 80))
    rows = [(5, far[0]), (3, far[1]), (None, far[2]), (8, other), (9, other.upper()), (1, None), (2, "")]
    sets = [set(simhash.shingles(t).tolist()) for t in far]
    assert 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1])
    fps = [simhash.simhash(t) for t in far]
    assert max((a ^ b).bit_count() for a in fps for b in fps) <= 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
    assert kept.columns == frame.columns
