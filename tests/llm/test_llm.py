"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from beatspark.llm import ann, license_scan, mixing, ngram_lm, packing, pu_quality, quality_rules, queries, simhash, substring_dedup, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, null ids and a column that clashes with names used inside."""
    long = " ".join(f"w{k * 7919 % 3000}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One two\none two"), (5, "One two\none two"), (None, "x y z"), (None, None), (6, long), (7, long + " end"), (8, "MIT License " * 60), (9, "é " * 400)]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 2}", 0) for i, t in rows], SCHEMA).withColumn("words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("bytes", F.lit("b"))


def docs(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def test_simhash_components(spark, odd):
    for size, rows, frame in ((3, texts(spark), spark.read.parquet(f"{SF}/documents.parquet")), (3, docs(odd), odd), (3, [], odd.limit(0))):
        fps = []
        for i, t in rows:
            w = (t or "").encode().lower().split()
            h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))] if w else []
            fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    parent[find(a)] = find(b)
        least = collections.defaultdict(list)
        for k, (i, _) in enumerate(rows):
            least[find(k)].append(i)
        want = sorted(((i, fps[k], min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)
        got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(frame, size=size).collect()), key=str)
        assert got == want


def test_simhash_large_buckets(spark, monkeypatch):
    """Hubs connect the same fingerprints as pairwise comparison."""
    rng = np.random.default_rng(0)
    fps = sorted({int(x) for x in np.int64(7) ^ (np.int64(1) << rng.integers(0, 60, (60, 2))).sum(axis=1)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    roots = {}
    for limit in (1000, 2):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        roots[limit] = sorted(map(tuple, simhash.components(simhash.links(frame, 2)).collect()))
    assert roots[1000] == roots[2]


def test_masks_cover():
    rng = np.random.default_rng(1)
    for r in (1, 2, 3):
        m = simhash.masks(r)
        for _ in range(200):
            d = sum(1 << int(b) for b in rng.choice(64, r, replace=False))
            assert any(d & x == 0 for x in m)


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 2000, 300)]
    near = base.copy()
    near[100] = "other"
    far = [f"v{k}" for k in rng.integers(0, 2000, 300)]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (4, " ".join(far)), (5, ""), (6, None), (7, "few words"), (None, " ".join(far))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame).collect()) == [1, 4, 5, 7]


def kept_by_brute_force(rows):
    """The least id of each component of pairs of exact five-word Jaccard similarity 0.8 and more."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def kept_near(spark, rows):
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


@pytest.mark.parametrize("limit,block", [(24, 1_000_000), (2, 1_000_000), (2, 700)])
def test_near_duplicates_of_one_word_bag(spark, monkeypatch, limit, block):
    """Near copies among texts of the same words in other orders, whatever text is the least of their group."""
    monkeypatch.setattr(simhash, "PAIRWISE", limit)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(24):
        order = list(rng.permutation(words))
        near = order.copy()
        near[100], near[101] = near[101], near[100]
        rows += [(2 * k, " ".join(order)), (2 * k + 1, " ".join(near))]
    assert kept_near(spark, rows) == kept_by_brute_force(rows) == [2 * k for k in range(24)]


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """Different texts whose 64-bit hash is the same are told apart."""
    monkeypatch.setattr(simhash, "NODE_BITS", 3)
    rng = np.random.default_rng(16)
    rows = [(k, " ".join(f"w{w}" for w in rng.integers(0, 5000, 80))) for k in range(30)]
    rows += [(100 + k, t) for k, t in rows[:5]] + [(200, rows[7][1] + " more")]
    assert kept_near(spark, rows) == kept_by_brute_force(rows) == list(range(30))


def changed_pairs(seed, pairs, words, changes):
    """Pairs of texts of distinct words, `changes` words of the second replaced, far enough apart to hit five shingles each."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(pairs):
        text = [f"p{k}w{w}" for w in rng.permutation(words)]
        other = text.copy()
        for c in range(changes):
            other[10 + 6 * c] += "x"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    return rows


def test_near_duplicates_at_the_threshold(spark):
    """Every pair of similarity 0.80 to 0.83 is found."""
    for seed, changes in ((12, 22), (13, 26)):
        rows = changed_pairs(seed, 150, 1200, changes)
        assert kept_near(spark, rows) == kept_by_brute_force(rows) == [2 * k for k in range(150)]


def test_near_duplicates_below_the_threshold(spark):
    """No pair of similarity 0.75 to 0.79 is taken for a copy."""
    for seed, changes in ((14, 28), (15, 33)):
        rows = changed_pairs(seed, 40, 1200, changes)
        assert kept_near(spark, rows) == kept_by_brute_force(rows) == list(range(80))


def lm_by_hand(rows, order):
    """Token counts, base score and backed-off score of every text, from plain counters."""
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    grams = [collections.Counter(), collections.Counter(), collections.Counter()]
    for w, t in zip(tokens, train):
        if t:
            grams[0].update(w)
            grams[1].update(zip(["start", *w], w))
            grams[2].update(zip(["start", *w], w, w[1:]))
    n, v = sum(grams[0].values()), len(grams[0])
    ones = [sum(c == 1 for c in g.values()) for g in grams]
    twos = sum(c == 2 for c in grams[0].values())
    d = min(0.95, ones[0] / (ones[0] + 2 * twos)) if ones[0] else 0.5

    def level(short, long, singles):
        """a of the failure weights: the histories' failure mass is the share of n-grams seen once."""
        mass, power = collections.Counter(), collections.Counter()
        for c in short.values():
            mass[int(math.log2(c))] += c
            power[int(math.log2(c))] += c ** (1 - ngram_lm.G)
        low, high = 0.0, 1e9
        for _ in range(200):
            a = (low + high) / 2
            got = sum(ngram_lm.TOP * mass[k] if a * (2 ** (k + 0.5)) ** -ngram_lm.G > ngram_lm.TOP else a * power[k] for k in mass) / max(n, 1)
            low, high = (a, high) if got < singles / max(sum(long.values()), 1) else (low, a)
        return a

    a2, a3 = level(grams[0], grams[1], ones[1]), level(grams[1], grams[2], ones[2])
    bow = lambda a, c: min(max(a * c**-ngram_lm.G, 1e-6), ngram_lm.TOP)
    starts = grams[0][None]

    def p1(w):
        if not n:
            return 1.0
        return (grams[0][w] - d if grams[0][w] else d * v) / n

    def p2(u, w):
        c = starts if u == "start" else grams[0][u]
        return (1 - bow(a2, c)) * grams[1][u, w] / c + bow(a2, c) * p1(w) if c else p1(w)

    def p3(u, v_, w):
        c = grams[1][u, v_]
        return (1 - bow(a3, c)) * grams[2][u, v_, w] / c + bow(a3, c) * p2(v_, w) if c else p2(v_, w)

    out = []
    for (i, _), w in zip(rows, tokens):
        logs = [math.log10(p2("start", w[0])), *(math.log10(p3(u, x, y) if order == 3 else p2(x, y)) for u, x, y in zip(["start", *w], w, w[1:]))]
        base = sum(math.log10((grams[0][x] + 1) / (n + v + 1)) for x in w)
        out.append((repr(i), len(w), sum(grams[0][x] > 0 for x in w), n, base, sum(logs)))
    return sorted(out)


def near_rows(got, want):
    assert [x[:-2] for x in got] == [x[:-2] for x in want]
    assert np.allclose([x[-2:] for x in got], [x[-2:] for x in want], rtol=1e-9, atol=1e-6)


def test_lm(spark, odd):
    """Every score against counters, for both orders, with one level of the exchange and with several."""
    learns = F.coalesce(ngram_lm.fold(F.col("doc_id")) != 2, F.lit(True))
    for rows, frame, settings in (
        (texts(spark), spark.read.parquet(f"{SF}/documents.parquet"), {"block": 1 << 17, "range_bytes": 1 << 17, "order": 2}),
        (texts(spark), spark.read.parquet(f"{SF}/documents.parquet"), {"block": 1 << 16, "range_bytes": 1 << 16, "fan": 2, "order": 3}),
        (docs(odd), odd, {"block": 1 << 17, "range_bytes": 1 << 17, "fan": 2, "order": 2}),
    ):
        found = ngram_lm.score(frame, learns, **settings).collect()
        near_rows(sorted((repr(r.id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), lm_by_hand(rows, settings["order"]))
    assert sum(r.score for r in found if r.train) > sum(r.base_score for r in found if r.train)
    assert ngram_lm.score(odd.limit(0), learns).count() == 0
    assert [(r.n_known, r.score) for r in ngram_lm.score(odd.limit(3), F.lit(False)).collect()] == [(0, 0.0)] * 3


@pytest.mark.parametrize("order", [2, 3])
def test_lm_sums_to_one(order):
    """Over all words and the unknown one, the arcs and failure arcs of each state share out a probability of one."""
    t = ngram_lm.Tokens([b"a b a c a b b a", b"b c zz"], order)
    counts = t.counts(np.array([True, False]))
    totals = np.ones((order, 4 + 2 * ngram_lm.CLASSES))
    totals[0, :4] = counts[0].sum(), (counts[0] > 0).sum(), (counts[0] == 1).sum(), (counts[0] == 2).sum()
    machine = ngram_lm.Automaton(t, counts, ngram_lm.Parameters(totals))
    words = [w for w in range(len(t.words)) if counts[0][w] > 0] + [next(w for w in range(len(t.words)) if not counts[0][w])]
    known = set(words)
    for path in ([], [0], [0, 1], [0, 1, 2]):
        path = [int(t.of[k]) for k in path]
        before = machine.traverse(path)
        assert abs(sum(10 ** (machine.traverse([*path, w]) - before) for w in known) - 1) < 1e-9


def test_lm_packing_round_trip():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (ngram_lm._lengthen(ngram_lm._shorten(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (ngram_lm._lengthen_counts(ngram_lm._shorten_counts(counts)) == counts).all()


def test_pu_quality(spark, odd):
    out = queries.QUERIES["op3_pu_quality"](spark, "/root/testdata/sf0.01")
    held = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.95 * held.count()
    model = pu_quality.train(odd, odd.limit(0), odd)
    scores = [r.score for r in pu_quality.score(odd, model).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    x[100:160] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = collections.defaultdict(list)
    for r in ann.search(ann.index(frame, recall=1.0), frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.id, r.score))
    hits = 0
    for q in range(0, 800, 100):
        away = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(800), away)) if k != q][:10]
        hits += len(set(best) & {i for i, _ in found[q]})
        assert all(abs(s - away[i]) < 1e-12 for i, s in found[q]) and len(found[q]) == 10
    assert set(found) == set(range(0, 800, 100)) and hits >= 72
    assert ann.search(ann.index(frame.limit(0)), frame.limit(0)).count() == 0


def xx(*values):
    """Spark's xxhash64 of integers, given as (value, bytes)."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 8 * size)).to_bytes(size, "little"), seed)
    return seed


def mixed_by_hand(rows, repetitions, bits):
    """(place in `rows`, epoch, place) of every copy, rows being (source, tokens, hash)."""
    tokens = collections.Counter()
    for s, t, _ in rows:
        tokens[s] += t
    total = sum(tokens.values())

    def weights(a):
        z = sum(t**a for t in tokens.values() if t)
        return {s: t**a / z if t else 0.0 for s, t in tokens.items()}

    most = lambda a: max(w * total / tokens[s] for s, w in weights(a).items() if tokens[s])
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if most(mid) <= repetitions else (mid, hi)
    w = weights(0.0 if most(0.0) <= repetitions else hi)

    def place(h, e):
        mask = (1 << bits) - 1
        block = (h >> (64 - bits)) if bits else 0
        return (((block ^ (xx((e, 4), (1, 4)) & mask)) * ((xx((e, 4), (2, 4)) & mask) | 1)) & mask) << (62 - bits) | xx((h, 8), (e, 4)) >> (2 + bits)

    out = []
    for s in tokens:
        mine = [k for k, r in enumerate(rows) if r[0] == s]
        epochs = w[s] * total / tokens[s] if tokens[s] else 1.0
        whole = int(epochs + 1e-9)
        out += [(k, e, place(rows[k][2], e)) for k in mine for e in range(whole)]
        left, rest, last = (epochs - whole) * tokens[s], [], sorted((place(rows[k][2], -1), k) for k in mine)
        if left > 0:
            for p in sorted({p for p, _ in last}):
                here = [(k, whole, p) for q, k in last if q == p]
                left -= sum(rows[k][1] for k, *_ in here)
                if left < -1e-6:
                    break
                rest += here
        out += rest
    return sorted(out)


def test_ann_scattered_leaves(spark):
    """Outliers with leaves of their own still get k neighbours; repeated rows count once; fewer candidates than k are all returned."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) + 5
    x[::100] = rng.normal(size=(4, 4)) * 1e6
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, x[100].tolist())] * 3
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.search(ann.index(frame, recall=0.5), frame.where("vec_id % 100 = 0"))
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {0: 10, 100: 10, 200: 10, 300: 10}
    few = frame.where("vec_id < 6")
    assert ann.search(ann.index(few), few.where("vec_id = 0")).count() == 5


@pytest.mark.parametrize("rows_a_block,parts", [(4096, 4096), (8, 4), (2, 2)])
def test_mixing(spark, odd, monkeypatch, rows_a_block, parts):
    """The mixed rows, epochs and places against a plain computation, with one and with several levels of parts."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(mixing, "PARTS", parts)
    for frame, repetitions in ((spark.read.parquet(f"{SF}/documents.parquet"), 4.0), (odd, 1.3)):
        seen = [(r.source, r.tokens, r.row % (1 << 64)) for r in mixing.measured(frame).collect()]
        want = sorted((seen[k][0], seen[k][2], e, p) for k, e, p in mixed_by_hand(seen, repetitions, mixing.block_bits(len(seen))))
        out = mixing.mix(frame, repetitions=repetitions)
        got = sorted((r.key, r.row % (1 << 64), r.epoch, r.place) for r in out.select(mixing._key(F.col("doc.source")).alias("key"), F.xxhash64("doc.doc_id", "doc.text", F.lit(mixing.SEED)).alias("row"), "epoch", "place").collect())
        assert got == want and {r.copies for r in out.collect()} >= {1}
        assert out.groupBy("doc", "tokens", "copies").count().where("count % copies <> 0").count() == 0


def test_mixing_weights(spark, odd):
    out = queries.QUERIES["op5_temperature_mixing"](spark, SF).toPandas()
    by = out.drop_duplicates(["source"]).set_index("source")
    assert abs(by["weight"].sum() - 1) < 1e-9 and by["epochs"].max() <= 4 + 1e-6
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    every = mixing.mix(frame, repetitions=2.0, budget=None).select("doc.doc_id")
    assert every.distinct().count() == frame.count() and every.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(odd, repetitions=2.0, budget=None).where("epoch = 0").count() == 12
    assert mixing.mix(odd.limit(0), entropy=0.9).count() == 0
    clash = odd.withColumns({c: F.lit(1) for c in ("epoch", "place", "weight", "exponent", "copies", "block", "n", "whole", "__salt", "__parts", "doc")})
    assert sorted(map(str, mixing.mix(clash, repetitions=2.0, budget=None).select("doc.*").distinct().collect())) == sorted(map(str, clash.distinct().collect()))
    sources = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1)], "source string, tokens bigint, n bigint")
    a, _ = mixing.exponent(sources, entropy=0.8)
    p = np.array([0.9, 0.09, 0.01]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 0.8 * np.log(3)) < 1e-3


def test_warc(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "x" * 300_000), (6, "y\r\n\r\nWARC/1.1" * 9000), (7, "x" * 300_000), (None, "q"), (9, "q"), (9, "q")]
    frame = spark.createDataFrame([(p, "http://x y/\nz", h, "e") for p, h in rows], "page_id bigint, url string, html string, payload string")
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    least = {}
    for p, h in rows:
        least.setdefault(h or "", []).append(p)
    want = []
    for p, h in rows:
        first = min(x for x in least[h or ""] if x is not None)
        again = p != first
        want.append((p, len(h or ""), digest((h or "").encode()), "revisit" if again else "response", first if again else None))
    for segment in (1000, 64 * 1024):
        back = warc.reassemble(warc.read(spark, warc.archive(frame, 0, segment))).collect()
        assert all(r.whole for r in back)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in back), key=str) == sorted(want, key=str)
    assert warc.reassemble(warc.read(spark, warc.archive(frame.limit(0)))).count() == 0


def test_warc_broken(spark):
    assert warc.dechunked(warc.chunked(b"ab" * 9000)) == b"ab" * 9000
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabX\r\n0\r\n\r\n")
    frame = spark.createDataFrame([(1, "u", "z" * 5000)], "page_id bigint, url string, html string")
    segments = warc.read(spark, warc.archive(frame, 0, 1000)).where("number <> 2")
    assert [(r.whole, r.payload) for r in warc.reassemble(segments).collect()] == [(False, None)]


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        out = packing.pack_documents(frame, path, group=100).toPandas()
        want = []
        for i, t in [(r.doc_id, r.text) for r in frame.collect()]:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
            want += [(repr(i), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        got = [(repr(None if i != i else int(i)), *map(int, r)) for i, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert sorted(got) == sorted(want)
        for _, s in out.sort_values("offset").groupby("sequence_id"):
            assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 2048
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_fit_is_optimal_for_large_items():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(34, 100, 9)
        bins, _ = packing.fit(sizes, 100)
        pairs = lambda left: max([0, *(1 + pairs(left - {a, b}) for a in [max(left)] for b in left - {a} if sizes[a] + sizes[b] <= 100), pairs(left - {max(left)})]) if len(left) > 1 else 0
        assert len(set(bins)) == 9 - pairs(frozenset(range(9)))


def test_tokenizer_memory(spark):
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), remembered=5)
    for text in ("á b c <|endoftext|>x d e f", "don't  I'll\t\nx\r\ny", "", "b c Σας"):
        assert list(t.encode(text)) == t._tokenizer.encode(text, add_special_tokens=False).ids


PHRASES = {"apache": b"apache license", "cc-by": b"cc by", "gpl": b"gnu general public license", "mit": b"mit license"}


def test_license_scan(spark, odd):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.limit(0)):
        want = []
        for r in frame.collect():
            w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
            hits = sorted((k, n) for n, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            want.append((repr(r.doc_id), len(w), [k for k, _ in hits], sorted({n for _, n in hits})))
        found = license_scan.scan(frame).select("doc.doc_id", "n_words", F.sort_array(F.transform("phrases", lambda s: s["first"])).alias("at"), "base_labels", "labels", "score").collect()
        assert sorted((repr(r.doc_id), r.n_words, r["at"], r.base_labels) for r in found) == sorted(want)
        assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in found)


def spans_by_hand(words, template):
    """(first, last, votes) of a template's verified spans, best first where they overlap."""
    t = license_scan._template_words(template)
    reach = 0 if template.share == 1.0 else license_scan.NEAR
    hits = [(p, q) for p in range(len(words) - 1) for q in range(len(t) - 1) if (words[p], words[p + 1]) == (t[q], t[q + 1])]
    found = set()
    for d in {p - q for p, q in hits}:
        near = sorted(h for h in hits if abs(h[0] - h[1] - d) <= reach)
        chains = []
        for p, q in near:
            before = max([(c[0], c[1]) for c in chains if c[2] < p and c[3] < q], default=None)
            chains.append((1, p, p, q) if before is None else (before[0] + 1, before[1], p, q))
        votes, end, start = max((c[0], -c[2], c[1]) for c in chains)
        if votes >= math.ceil(template.share * (len(t) - 1) - 1e-9):
            found.add((start, -end + 1, votes))
    if template.share == 1.0:
        return sorted(found)
    return sorted(s for s in found if not any(x[0] <= s[1] and x[1] >= s[0] and (x[2], -x[0]) > (s[2], -s[0]) for x in found))


def notices(rng):
    """Texts with license notices: whole, with words left out, put in, repeated, cut short, reversed and shuffled."""
    out = []
    for t in license_scan.NOTICES:
        w = license_scan._template_words(t)
        out += [w, w[:-2], w[len(w) // 3 :], w + ["and"] + w, ["so"] + w[:3] + ["newly"] + w[3:], w[:4] + w[5:], w[::-1], [w[k] for k in rng.permutation(len(w))]]
        pairs = [w[k : k + 2] for k in range(len(w) - 1)]
        out.append([x for p in pairs[::-1] for x in p])
    return [" ".join(w) for w in out] + ["of the of the " * 40, "the license the license of the license " * 9]


def test_license_labels_and_scores(spark):
    """Spans, labels and scores against a plain search, on the corpus and on altered notices."""
    rng = np.random.default_rng(9)
    every = license_scan.PHRASES + license_scan.NOTICES
    odd_texts = [(k, t) for k, t in enumerate(notices(rng))]
    for rows in (texts(spark), odd_texts):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        for r in license_scan.scan(frame).collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (dict(rows)[r.doc.doc_id] or "").lower())
            want = sorted((k, *s) for k, t in enumerate(every) for s in spans_by_hand(words, t))
            assert sorted((s.template, s["first"], s["last"], s.votes) for s in r.spans) == want, dict(rows)[r.doc.doc_id]
            assert r.labels == sorted({every[k].label for k, *_ in want})
            shares = [v / (len(license_scan._template_words(every[k])) - 1) for k, _, _, v in want if k >= len(license_scan.PHRASES)]
            assert abs(r.score - max([0.5 if any(k < len(license_scan.PHRASES) for k, *_ in want) else 0.0, *shares])) < 1e-12


def test_license_reversed_words_have_no_label(spark):
    t = next(t for t in license_scan.NOTICES if t.name == "mit-grant")
    w = license_scan._template_words(t)
    text = " ".join(x for k in range(len(w) - 2, -1, -1) for x in w[k : k + 2])
    found = license_scan.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert found.labels == [] and found.score == 0


def test_license_notice_with_a_word_left_out(spark):
    frame = spark.createDataFrame([("x Permission is hereby granted free of charge to any person obtaining copy of this software and associated documentation files to deal in the software without restriction y",)], "text string")
    assert license_scan.scan(frame).first().labels == ["mit"]


def test_quality_rules(spark, odd):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.limit(0)):
        want = []
        for r in frame.collect():
            t = r.text or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            spots = collections.defaultdict(list)
            for k in range(len(w) - 4):
                spots[tuple(w[k : k + 5])].append(k)
            covered = {k + j for s in spots.values() if len(s) > 1 for k in s for j in range(5)}
            want.append((repr(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
        book = quality_rules.apply_policy(quality_rules.ledger(frame), "base-1").collect()
        assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) for r in book) == sorted(want)


def test_quality_ablation_and_filter(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    book = quality_rules.ledger(frame)
    kept = quality_rules.apply_policy(book, "web-1").where("kept").count()
    assert quality_rules.filter_documents(frame).count() == kept and quality_rules.filter_documents(frame).columns == frame.columns
    bits = [r.failed_bits for r in book.collect()]
    for r in quality_rules.ablation(book).collect():
        one = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only) == (sum(b & one != 0 for b in bits), sum(b == one for b in bits))


def substrings(rows, length):
    count = collections.Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        out.append((repr(i), len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_substring_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("ab c\n"), n))
    shared = [word(70) for _ in range(3)]
    rows = [(k, word(int(rng.integers(0, 60))) + shared[k % 3][int(rng.integers(0, 30)) :] + word(40)) for k in range(40)]
    rows += [(60 + k, word(5 + k) + shared[0][:55] + word(9)) for k in range(30)]  # one group of many classes
    rows += [(50, "z" * 500), (51, None), (52, ""), (53, shared[0]), (53, shared[0]), (None, "abc" * 40), (54, "é" * 80)]
    for length in (40, 41):
        found = substring_dedup.cut(substring_dedup.marked(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, packed int"), length=length))
        got = sorted((repr(r.doc.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())
        assert got == substrings([(i, (t or "").encode()) for i, t in rows], length)


def test_substring_dedup_corpus(spark):
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op10_substring_dedup"](spark, SF).collect())
    assert got == substrings([(i, (t or "").encode()) for i, t in texts(spark)], 400)
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_dedup.dedup(frame).count() == 0


def cut_by_hand(rows, length):
    """Texts without their repeated passages, a character that a cut splits left out, for rows that keep a word."""
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, dtype=int)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=1, append=1))
        kept = "".join(d[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
        if kept.split():
            out.append((repr(i), kept))
    return sorted(out)


def test_pipeline_stages(spark, odd):
    """Each stage on what the one before it keeps, and on odd rows, against plain computations."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    clash = odd.withColumns({c: F.lit(c) for c in ("epoch", "place", "kept", "node", "at", "row", "ka", "failed_bits", "weight")})
    for start in (spark.read.parquet(f"{SF}/documents.parquet"), clash):
        docs = start
        for name in ("quality rules", "near duplicates", "repeated passages", "source mixing"):
            before = [(r.doc_id, r.text) for r in docs.collect()]
            docs = stages[name](spark, docs, SF).persist()
            after = [(r.doc_id, r.text) for r in docs.collect()]
            assert docs.columns == start.columns, name
            if name == "quality rules":
                good = collections.Counter(repr(r.doc_id) for r in quality_rules.apply_policy(quality_rules.ledger(start), "web-1").where("kept").collect())
                assert collections.Counter(repr(i) for i, _ in after) == good and set(after) <= set(before)
                assert all(len((t or "").split()) >= 10 for _, t in after)
            if name == "near duplicates" and all(i is not None for i, _ in before):
                assert sorted(i for i, _ in after) == kept_by_brute_force([(i, t or "") for i, t in before])
            if name == "repeated passages":
                assert sorted((repr(i), t) for i, t in after) == cut_by_hand(before, corpus_pipeline.PASSAGE)
            if name == "source mixing":
                times = collections.Counter(map(repr, after))
                assert set(times) == set(map(repr, before)) and max(times.values(), default=1) <= 2 * max(collections.Counter(map(repr, before)).values(), default=1)
        pieces = stages["packing"](spark, docs, SF).select("doc_id").distinct().count()
        assert pieces == docs.select("doc_id").distinct().count()
        for stage in stages.values():
            assert stage(spark, start.limit(0), SF).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    seen = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == frame.columns and seen.count() > 0, name
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
