"""Language-model scores by a weighted backoff automaton of order two or three.

States are the empty history, every word of the training texts (and the start of a text) and, at order three, every
pair of words seen there. An arc u -> w carries the smoothed log-probability of w after the history u and leads to the longest history that
is a state: (u, w) from a word u, (v, w) from a pair (u, v), w from the empty history. A failure arc leads from a pair
to its last word and from a word to the empty history, with the weight bow. One left-to-right traversal of a text
carries the state: as long as the state has no arc for the word, it adds the failure weight and falls back, then it
takes the arc.

    P(w | u) = (1 - bow(u)) * c(u, w) / c(u) + bow(u) * P(w | shorter u)         P(w) = (c(w) - D) / N    D * V / N if unknown

bow falls with the number of times a history was seen, as unseen successors get rarer: bow(u) = min(TOP, a * c(u)^-G),
where a is set for each length of history so that, over all training histories, the mass of the failure arcs is the
share of longer n-grams that were seen once (Good-Turing). D is n1 / (n1 + 2 n2) of the word counts. All counts come
from all training texts; P sums to one over the known words and the unknown one.

At scale the model is never in one place. Texts are dealt into blocks of about `BLOCK` bytes. A block sends its
distinct words, pairs (and triples), as sorted 64-bit hashes with its own counts, to the range of hashes that counts
them; the range adds up all blocks' counts and answers each block with the corpus counts in the order it was asked.
From these each block builds just the part of the automaton that its texts can reach. A word that fills a third of the
corpus is one number for each block. The answers carry no keys. Texts cross the network twice, compressed: to ask, and
to be scored.

A block speaks to `FAN` ranges at most. With more, the exchange has levels: a team of blocks is merged in each of the
wide ranges, the merged sets ask the ranges inside it, and the answers come back the same way. So messages grow in
proportion to the blocks, whatever their number.

Defined results: a null text is empty (one end token); a null id counts as training text and is not held out;
repeated rows count and are scored one by one; an empty table gives no rows; without training text all words are
unknown with probability 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, materialise

#: Bytes of text in a block, about, and hashes in a counting range, about (for texts of natural language).
BLOCK = 4 << 20
RANGE_BYTES = 8 << 20
#: Ranges that a block speaks to at most.
FAN = 4096
#: Words of the longest n-grams. Three needs about twice the disk and memory of two.
ORDER = 2
TOP, G = 0.995, 0.15
#: Classes of histories by the logarithm of their count, for setting a.
CLASSES = 48
_START, _END = 1, 2  # hashes of the start and the end of a text
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_TRIPLE = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def fold(id_: Column, folds: int = 7) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % folds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Tokens:
    """Tokens of a block's texts: `words` are the distinct hashes (sorted), `of` the place of each token there."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        known: dict[bytes, int] = {}
        parts, sizes = [], []
        for text in texts:
            split = text.lower().split()
            own = [known.setdefault(w, len(known)) for w in split]
            parts.append(np.array(own, dtype=np.int32))
            sizes.append(len(own) + 1)
        hash_ = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((max(hash_(w), 3) for w in known), "<u8", len(known))
        hashes = np.concatenate((hashes, np.array([_END], dtype="<u8")))
        self.words, place = np.unique(hashes, return_inverse=True)
        self.sizes = np.array(sizes, dtype=np.int64)
        end = np.array([len(known)], dtype=np.int32)
        flat = np.concatenate([x for p in parts for x in (p, end)]) if parts else np.zeros(0, dtype=np.int32)
        self.of = place[flat]
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate((np.array([_START], dtype="<u8"), self.words[self.of][:-1])) if len(flat) else np.zeros(0, dtype="<u8")
        before[first] = _START
        pairs = _mix(before * _PAIR + self.words[self.of])
        # for each length of n-gram: the distinct hashes (sorted), and the place of each token's there (-1: none)
        self.grams = [(self.words, self.of), np.unique(pairs, return_inverse=True)]
        if order == 3:
            later = np.ones(len(flat), dtype=bool)
            later[first] = False
            triples = _mix(np.concatenate((pairs[:1], pairs[:-1])) * _TRIPLE + self.words[self.of])
            distinct, place = np.unique(triples[later], return_inverse=True)
            of = np.full(len(flat), -1, dtype=np.int64)
            of[later] = place
            self.grams.append((distinct, of))
        self.first = first

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """How often the block's training texts hold each distinct n-gram, for each length."""
        of_train = train[self.doc]
        return [np.bincount(of[of_train & (of >= 0)], minlength=len(distinct)) for distinct, of in self.grams]


def _levels(ranges: int, fan: int) -> tuple[int, int]:
    """Levels of the exchange, and ranges that each of a level's ranges is cut into."""
    levels = 1
    while fan**levels < ranges:
        levels += 1
    parts = 1
    while parts**levels < ranges:
        parts += 1
    return levels, parts


def _cuts(keys: np.ndarray, path: int, parts: int, level: int) -> np.ndarray:
    """Where each part of the range of hashes `path` of a level starts in sorted keys that lie in it."""
    every = parts ** (level + 1)
    edges = [-(-((path * parts + r) << 64) // every) for r in range(1, parts)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype="<u8")), [len(keys)])).astype(np.int64)


def _unpack(packed: pd.Series) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(x) for x in packed]


_ASK = "member bigint, path bigint, kind int, keys binary, counts binary"
_ANSWER = "member bigint, path bigint, kind int, counts binary, totals array<double>"


def _messages(member: int, path: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int, level: int) -> list[tuple]:
    """From one member to the parts of a range: the steps between sorted hashes, and counts."""
    cuts = _cuts(keys, path, parts, level)
    return [
        (member, path * parts + r, kind, _shorten(keys[cuts[r] : cuts[r + 1]]), _shorten_counts(counts[cuts[r] : cuts[r + 1]]))
        for r in range(parts) if cuts[r + 1] > cuts[r]
    ]


def _ask(blocks: DataFrame, parts: int, order: int) -> DataFrame:
    """From each block to each range: kind (length of the n-grams, less one), keys and counts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(_unpack(pdf["packed"]), order)
        block, counts = int(pdf["block"].iloc[0]), t.counts(pdf["train"].to_numpy())
        rows = [m for kind in range(order) for m in _messages(block, 0, kind, t.grams[kind][0], counts[kind], parts, 0)]
        return pd.DataFrame(rows, columns=["member", "path", "kind", "keys", "counts"])

    return blocks.groupBy("block").applyInPandas(run, _ASK)


def _merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each message, all distinct keys, each message key's place there (one after the other), and summed counts."""
    keys = [_lengthen(k) for k in pdf["keys"]]
    all_, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(where, weights=np.concatenate([_lengthen_counts(c) for c in pdf["counts"]]).astype(float), minlength=len(all_)).astype(np.int64)
    return keys, all_, where, sums


def _told(pdf: pd.DataFrame, keys: list[np.ndarray], counts: np.ndarray) -> pd.DataFrame:
    """The answer to each message: its part of `counts`, given in the order of the messages' keys."""
    ends = np.cumsum([len(k) for k in keys])
    rows = [(int(m), int(p), int(k), _shorten_counts(counts[e - len(x) : e]), None) for m, p, k, x, e in zip(pdf["member"], pdf["path"], pdf["kind"], keys, ends)]
    return pd.DataFrame(rows, columns=["member", "path", "kind", "counts", "totals"])


def _shorten(keys: np.ndarray) -> bytes:
    """Sorted keys as steps, their eight bytes one plane after the other, so that the high bytes compress to nothing."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    used = 8 - next((k for k in range(8) if planes[7 - k].any()), 8)
    return bytes([used]) + planes[:used].tobytes()


def _lengthen(data: bytes) -> np.ndarray:
    used = data[0]
    n = (len(data) - 1) // used if used else 0
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(data, np.uint8, offset=1).reshape(used, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype="<u8")


def _shorten_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each, 255 standing for a count that follows in eight bytes."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(8, "little") + small.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _lengthen_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return counts


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for each message to a range, and the range's own sums as a row with member -1."""
    keys, _, where, sums = _merged(pdf)
    seen = sums[sums > 0]
    classes = np.minimum(np.log2(seen).astype(int), CLASSES - 1) if len(seen) else np.zeros(0, dtype=int)
    # N, V, n1, n2, then mass and histories by class
    totals = [float(seen.sum()), float(len(seen)), float((seen == 1).sum()), float((seen == 2).sum())]
    totals += np.bincount(classes, weights=seen.astype(float), minlength=CLASSES).tolist() + np.bincount(classes, weights=seen.astype(float) ** (1 - G), minlength=CLASSES).tolist()
    own = pd.DataFrame([(-1, int(pdf["path"].iloc[0]), int(pdf["kind"].iloc[0]), None, totals)], columns=["member", "path", "kind", "counts", "totals"])
    return pd.concat([_told(pdf, keys, sums[where]), own])


def _exchange(sent: DataFrame, levels: int, parts: int, level: int = 0) -> DataFrame:
    """The answers to the messages `sent` to the ranges of a level."""
    if level == levels - 1:
        return sent.groupBy("path", "kind").applyInPandas(_count, _ANSWER)
    team = F.expr(f"member div {parts}")
    sent = materialise(sent, "messages")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, all_, _, sums = _merged(pdf)
        rows = _messages(int(pdf["member"].iloc[0]) // parts, int(pdf["path"].iloc[0]), int(pdf["kind"].iloc[0]), all_, sums, parts, level + 1)
        return pd.DataFrame(rows, columns=["member", "path", "kind", "keys", "counts"])

    def share(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        keys, _, where, _ = _merged(asked)
        counts = np.concatenate([_lengthen_counts(c) for c in told.sort_values("part")["counts"]])
        return _told(asked, keys, counts[where])

    below = materialise(_exchange(sent.groupBy("path", "kind", team).applyInPandas(ask, _ASK), levels, parts, level + 1), "answers")
    inner = below.where("member >= 0").select("member", F.expr(f"path div {parts}").alias("path"), "kind", F.col("path").alias("part"), "counts")
    back = sent.groupBy("path", "kind", team).cogroup(inner.groupBy("path", "kind", "member")).applyInPandas(share, _ANSWER)
    return back.union(below.where("member < 0"))


class Parameters:
    """What all texts share: N, V, D and a for each length of history, from the sums over all ranges (a row for each length of n-gram)."""

    def __init__(self, totals: np.ndarray):
        self.n, self.v, n1, n2 = totals[0][:4]
        self.d = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
        self.a = [self._level(short, long) for short, long in zip(totals, totals[1:])]

    @staticmethod
    def _level(short: np.ndarray, long: np.ndarray) -> float:
        """Smallest a whose failure mass is the wanted share; classes whose weight would pass TOP are held there."""
        mass, powers = short[4 : 4 + CLASSES], short[4 + CLASSES :]
        wanted = long[2] / max(long[0], 1)
        low, high, a = 0.0, 1e9, 0.0
        count = 2.0 ** (np.arange(CLASSES) + 0.5)
        for _ in range(200):
            a = (low + high) / 2
            got = np.where(a * count**-G > TOP, TOP * mass, a * powers).sum() / max(short[0], 1)
            low, high = (a, high) if got < wanted else (low, a)
        return a

    def bow(self, history: np.ndarray, size: int) -> np.ndarray:
        """Weight of the failure arcs of histories of `size` words seen so often."""
        return np.clip(self.a[size - 1] * np.maximum(history, 1.0) ** -G, 1e-6, TOP)

    def word(self, counts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.d, self.d * self.v) / self.n


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State 0 is the empty history, 1 the start of a text, then come the block's words, then (at order three) its pairs;
    only those with a count are ever reached. `arcs` maps state * width + word to the number of an arc, `weight` and
    `target` are its log10 probability and the state it leads to; `fail` and `bow` (log10) belong to states.
    """

    def __init__(self, t: Tokens, counts: list[np.ndarray], p: Parameters):
        words, pairs, *triples = (c.astype(float) for c in counts)
        n_words, n_pairs = len(words), len(pairs)
        starts = words[np.searchsorted(t.words, np.uint64(_END))]
        self.width = n_words
        word_of, pair_of = t.grams[0][1], t.grams[1][1]
        first = np.zeros(len(word_of), dtype=bool)
        first[t.first] = True
        word_state = np.where(words > 0, 2 + np.arange(n_words), 0)

        unigram = p.word(words)
        token = self._shown(pair_of, n_pairs)
        last = word_of[token]  # the last word of each pair
        before = np.where(first[token], 1, word_state[word_of[token - 1]])
        history = np.where(first[token], starts, words[word_of[token - 1]])
        bow = p.bow(history, 1)
        bigram = (1 - bow) * pairs / np.maximum(history, 1) + bow * unigram[last]
        seen = pairs > 0
        keys, weights = [np.arange(n_words), before[seen] * self.width + last[seen]], [unigram, bigram[seen]]
        targets, fail = [word_state, word_state[last][seen]], [[0, 0], np.zeros(n_words, dtype=np.int64)]
        back = [[1.0], p.bow(np.array([starts]), 1) if starts else [1.0], p.bow(words, 1)]

        if triples:
            pair_state = 2 + n_words + np.arange(n_pairs)
            triple_of, triples = t.grams[2][1], triples[0]
            token = self._shown(triple_of, len(triples))
            inner, outer = pair_of[token], pair_of[token - 1]  # of each triple, the last two words and the first two
            bow = p.bow(pairs[outer], 2)
            trigram = (1 - bow) * triples / np.maximum(pairs[outer], 1) + bow * bigram[inner]
            there = triples > 0
            keys.append(pair_state[outer[there]] * self.width + word_of[token[there]])
            weights.append(trigram[there])
            targets[1:] = [pair_state[seen], pair_state[inner[there]]]
            fail.append(word_state[last])
            back.append(p.bow(pairs, 2))
        keys = np.concatenate(keys).tolist()
        self.arcs = dict(zip(keys, range(len(keys))))
        self.weight, self.target = np.log10(np.concatenate(weights)).tolist(), np.concatenate(targets).tolist()
        self.fail, self.bow = np.concatenate(fail).tolist(), np.log10(np.concatenate(back)).tolist()

    @staticmethod
    def _shown(of: np.ndarray, n: int) -> np.ndarray:
        """One token of each distinct n-gram: it shows the word, and what comes before it."""
        token, here = np.zeros(n, dtype=np.int64), np.flatnonzero(of >= 0)
        token[of[here]] = here
        return token

    def traverse(self, text: list[int]) -> float:
        """log10 probability of a text, given by the places of its tokens among the block's words."""
        state, total = 1, 0.0
        arcs, weight, target, fail, bow, width = self.arcs, self.weight, self.target, self.fail, self.bow, self.width
        for word in text:
            while (arc := arcs.get(state * width + word)) is None:
                total += bow[state]
                state = fail[state]
            total += weight[arc]
            state = target[arc]
        return total


def _pack(text: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3).compress
    return text.map(lambda t: pack((t or "").encode("utf-8", "surrogatepass")))


def _totals(answers: DataFrame, order: int) -> np.ndarray:
    """Sums over all ranges, for each length of n-gram: a few dozen numbers."""
    each = answers.where("member < 0").select("kind", F.posexplode("totals").alias("k", "x")).groupBy("kind", "k").agg(F.sum("x").alias("x"))
    sums = np.zeros((order, 4 + 2 * CLASSES))
    for row in each.collect():
        sums[row.kind, row.k] = row.x
    return sums


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, range_bytes: int = RANGE_BYTES, fan: int = FAN, order: int = ORDER) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score and score of every row, learning from rows with `train`."""
    check_columns(docs, id_col, text_col)
    if order not in (2, 3):
        raise ValueError("order: 2 or 3")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    blocks = max(1, -(-size // block))
    levels, parts = _levels(max(1, -(-size // range_bytes)), fan)
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    dealt = docs.select(
        id_.alias("id"), F.pandas_udf(_pack, "binary")(text).alias("packed"), F.coalesce(train, F.lit(True)).alias("train"),
        F.pmod(F.xxhash64(id_, text), F.lit(blocks)).cast("bigint").alias("block"),
    )
    answers = materialise(_exchange(_ask(dealt, parts, order), levels, parts), "answers")
    p = Parameters(_totals(answers, order))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"id": [], "train": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        t = Tokens(_unpack(left["packed"]), order)
        right = right.sort_values("path")
        counts = [np.concatenate([np.zeros(0, dtype=np.int64), *(_lengthen_counts(c) for c in right.loc[right["kind"] == kind, "counts"])]) for kind in range(order)]
        c, n = counts[0][t.of].astype(float), len(t.sizes)
        base = np.bincount(t.doc, weights=np.log10((c + 1) / (p.n + p.v + 1)), minlength=n)
        automaton, of = Automaton(t, counts, p), t.of.tolist()
        logs = [automaton.traverse(of[a : a + k]) for a, k in zip(t.first.tolist(), t.sizes.tolist())]
        return pd.DataFrame({"id": left["id"], "train": left["train"], "n_tokens": t.sizes, "n_known": np.bincount(t.doc, weights=c > 0, minlength=n).astype(np.int64), "base_score": base, "score": logs})

    told = answers.where("member >= 0").select(F.col("member").alias("block"), "path", "kind", "counts")
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("id", "train", "n_tokens", "n_known", F.lit(int(p.n)).cast("bigint").alias("train_tokens"), "base_score", "score")
