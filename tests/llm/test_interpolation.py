"""Deleted interpolation against a plain version, and that it is a probability."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lendspark.llm import interpolation, queries
from lendspark.llm.common import table

SCHEMA = "doc_id long, text string, block int, train string"


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2



def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [" end"]


class Plain:
    """The same model in plain Python; gone: texts that are deleted from the counts."""

    def __init__(self, rows, gone, order=2):
        self.order = order
        train = [(tokens(t), t in gone) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.weights = [defaultdict(lambda: 0.5) for _ in range(order)]
        self.count([t for t, g in train if not g])
        if self.c[0]:
            for _ in range(interpolation.ROUNDS):
                sums = [defaultdict(lambda: [0.0, 0.0]) for _ in range(order)]
                for t, g in train:
                    for levels in self.levels(t) if g else ():
                        reach = 1.0
                        p = self.mixed(levels)
                        for k in reversed(range(order)):
                            c, x = levels[k]
                            if x == 0:
                                continue
                            b = 0 if k == 0 else int(math.log2(x))
                            used = reach * self.weights[k][b] * c / x / p[k]
                            sums[k][b][0] += used
                            sums[k][b][1] += reach
                            reach -= used
                new = [(k, b, (u + 1) / (r + 2)) for k, s in enumerate(sums) for b, (u, r) in s.items()]
                moved = max((abs(w - self.weights[k][b]) for k, b, w in new), default=0)
                for k, b, w in new:
                    self.weights[k][b] = w
                if moved < interpolation.STILL:
                    break
        self.count([t for t, _ in train])

    def count(self, texts):
        self.c, self.x = [Counter() for _ in range(self.order)], [Counter() for _ in range(self.order)]
        for t in texts:
            for k, g in self.grams(t):
                self.c[k][g] += 1
                self.x[k][g[:-1]] += 1
        self.types, self.n = len(self.c[0]), sum(self.c[0].values())

    def grams(self, t):
        for i in range(len(t)):
            for k in range(self.order):
                yield k, tuple(t[j] if j >= 0 else " start" for j in range(i - k, i + 1))

    def levels(self, t):
        at = [(self.c[k][g], self.x[k][g[:-1]]) for k, g in self.grams(t)]
        return [at[i : i + self.order] for i in range(0, len(at), self.order)]

    def mixed(self, levels):
        p, out = 1 / (self.types + 1), []
        for k, (c, x) in enumerate(levels):
            if x:
                w = self.weights[k][0 if k == 0 else int(math.log2(x))]
                p = w * c / x + (1 - w) * p
            out.append(p)
        return out

    def score(self, text):
        return sum(math.log10(self.mixed(levels)[-1]) for levels in self.levels(tokens(text)))


def deleted(spark, rows):
    df = docs(spark, rows).where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(interpolation.DELETED)) == 0)
    return {r["text"] for r in df.collect()}


def corpus(rng, n):
    words = ["the", "The", "of", "sun", "sea", "run", "été", "x1", "?", "a\x1fb"] + [f"w{k}" for k in range(40)]
    out = []
    for k in range(n):
        w = rng.choice(words)
        text = [w]
        for _ in range(rng.randint(0, 60)):
            w = words[(words.index(w) * 7 + rng.choice([1, 1, 1, 2, 5])) % len(words)]
            text.append(w + str(rng.randint(0, 999)) * (rng.random() < 0.05))
        out.append((k, rng.choice([" ", "\n", "\t \x0b"]).join(text)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", 2000)  # several blocks and shards
    monkeypatch.setattr(interpolation, "SHARD_BYTES", 9000)
    rng = random.Random(order)
    rows = corpus(rng, 300)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "sun of sea"), (5, rows[9][1]), (5, rows[9][1]), (1003, "wide " * 3000), (1004, "new never seen")]
    rows += [(2000 + k, "a line that many texts hold") for k in range(200)]
    want = Plain(rows, deleted(spark, rows), order)
    got = interpolation.score_texts(docs(spark, rows), held(), order).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        fits = [t for t in texts[r["doc_id"]] if len(tokens(t)) == r["n_tokens"] and r["score"] == pytest.approx(want.score(t), rel=1e-9)]
        assert fits, r
        t = tokens(fits[0])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["train_tokens"] == want.n and r["n_known"] == sum(want.c[0][w,] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((want.c[0][w,] + 1) / (want.n + want.types + 1)) for w in t), rel=1e-9)
    if order == 2:
        unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
        assert len(unseen) > 20 and sum(r["score"] for r in unseen) > 0.9 * sum(r["base_score"] for r in unseen)


def test_probabilities_add_up(spark):
    """Over all tokens that may follow, and one for unknown words, they come to 1."""
    rows = [(k, "a b a c") for k in range(50)] + [(100 + k, "b c") for k in range(50)]
    probes = [("a", w) for w in ("a", "b", "c", "zzz")]
    texts = [" ".join(p) for p in probes] + ["a"]
    out = [i for i in range(3000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(texts)]
    got = {r["doc_id"]: r["score"] for r in interpolation.score_texts(docs(spark, rows + list(zip(out, texts, strict=True))), held()).collect()}
    model = Plain(rows, deleted(spark, rows))
    first = math.log10(model.mixed(model.levels(["a"])[0])[-1])
    ends = {w: math.log10(model.mixed(model.levels([w, " end"])[1])[-1]) for w in ("a", "b", "c", "zzz")}
    total = sum(10 ** (got[i] - first - ends[w]) for i, (_, w) in zip(out, probes, strict=False)) + 10 ** (got[out[-1]] - first)
    assert total == pytest.approx(1, rel=1e-9)


def test_little_and_no_training(spark):
    assert interpolation.score_texts(docs(spark, []), held()).count() == 0
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = interpolation.score_texts(docs(spark, [(i, "no training here") for i in out[:3]]), held()).collect()
    assert len(got) == 3 and all((r["train_tokens"], r["n_known"], r["score"], r["base_score"]) == (0, 0, 0.0, 0.0) for r in got)
    one = interpolation.score_texts(docs(spark, [(next(i for i in range(100) if i not in out), None)]), held()).first()
    assert (one["n_tokens"], one["train_tokens"]) == (1, 1) and math.isfinite(one["score"])


def test_query_beats_the_unigram_model(spark):
    rows = queries.QUERIES["op11_interpolation"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == table(spark, "/root/testdata/sf0.001", "documents").count()
    unseen = [r for r in rows if r["held_out"]]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
