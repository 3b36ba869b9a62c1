"""The classifier's risk, gradient, prior and features, and the recall of the search in the query's own settings, each against an independent computation."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark.llm import pu_quality, queries


def test_risk_and_gradient():
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.7, 1, (60, 4)), rng.normal(-0.2, 1, (90, 4))
    regimes = set()
    for seed in range(40):
        w, prior = np.random.default_rng(seed).normal(0, 3, 4), 0.1 + 0.02 * seed
        loss = lambda x, side: sum(math.log1p(math.exp(-side * float(r @ w))) for r in x) / len(x)
        want = prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)
        assert np.allclose(pu_quality.risk(w, p, u, prior), want, rtol=1e-10)
        below = want[1] < 0
        regimes.add(below)
        aim = lambda v: (-pu_quality.risk(v, p, u, prior)[1] if below else sum(pu_quality.risk(v, p, u, prior))) + 0.05 * v @ v
        steps = np.eye(4) * 1e-6
        slopes = [(aim(w + d) - aim(w - d)) / 2e-6 for d in steps]
        assert np.allclose(pu_quality.risk_gradient(w, p, u, prior, 0.1), slopes, atol=1e-6)
    assert regimes == {True, False}


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.8):
        unlabelled = np.concatenate([rng.normal(2, 1, int(8000 * prior)), rng.normal(-2, 1, int(8000 * (1 - prior)))])
        assert abs(pu_quality.estimate_prior(rng.normal(2, 1, 5000), unlabelled) - prior) < 0.06


def test_features_by_plain_counting():
    for text in ("Hello hello world, world!\n\nHello hello world, world!\n| a | 9 |", "ÉÀ été 12 $$", "", "one"):
        data = text.encode()
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, share = max(1, len(words)), lambda test: sum(map(test, data)) / max(1, len(data))
        upper, lower = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122)
        pairs = collections.Counter(zip(words, words[1:]))
        want = {
            "log_words": math.log(len(words) + 1), "word_length": sum(len(w.encode()) for w in words) / n / 10, "pipes": share(lambda b: b == ord("|")), "upper": upper / max(upper + lower, 1e-9),
            "other_letters": 1 - upper - lower, "digits": share(lambda b: 48 <= b <= 57), "distinct_words": len(set(words)) / n, "distinct_pairs": len(pairs) / max(1, sum(pairs.values())),
            "same_as_before": sum(c for (a, b), c in pairs.items() if a == b) / max(1, sum(pairs.values())), "distinct_lines": len(set(lines)) / max(1, len(lines)), "exclaims": share(lambda b: b in b"!?"),
        }
        got = dict(zip(pu_quality.FEATURES, pu_quality.features(text)))
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_ties_repeated_rows_and_clashing_names(spark):
    rows = [(k % 40, ("good words in a line " * (k % 7 + 1)) if k % 2 else "## | ## " * (k % 5 + 1), "x") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id string").withColumn("id", F.lit(1)).withColumn("chosen", F.lit("c"))
    model = pu_quality.train(docs, docs.where("doc_id % 2 = 1"), docs)
    scored = pu_quality.score(docs, model).collect()
    assert len(scored) == 120
    by = {}
    for r, (k, text, _) in zip(sorted(scored, key=lambda r: r.id), sorted(rows, key=lambda r: r[0])):
        by.setdefault(k, set()).add(r.score)
    assert min(s for k, x in by.items() if k % 2 for s in x) > max(s for k, x in by.items() if k % 2 == 0 for s in x)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    found = collections.defaultdict(dict)
    for r in queries.QUERIES["op4_kmeans_tree_search"](spark, path).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    assert set(found) == {i for i in ids if i % 100 == 0}
    for q, ranked in found.items():
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, away)) if ids[k] != q][:10]
        assert sorted(ranked) == list(range(1, 11)) and all(abs(away[ids == v][0] - s) < 1e-9 for v, s in ranked.values())
        hits += len({ids[k] for k in order} & {v for v, _ in ranked.values()})
        total += 10
    assert hits / total >= 0.95, hits / total
