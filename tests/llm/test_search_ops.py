"""Toxicity, suffix-array dedup, nearest neighbours, near duplicates and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendspark.llm import ann, components, fuzzy, minhash, queries, suffix_dedup, suffixes, toxicity

DIR, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")


# ── toxicity ─────────────────────────────────────────────────────────────────


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_trie_is_edit_distance():
    terms = ["idiot", "scum", "worthless", "moron", "stupidest"]
    trie, rng = fuzzy.FuzzyTrie(terms, ["vequ"]), random.Random(1)
    words = ["".join(rng.choice("idotscumwrhlep") for _ in range(rng.randint(0, 10))) for _ in range(300)]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i"])
            words.append("".join(w))
    for w in words:
        near = {t: edits(t, w) for t in terms if edits(t, w) <= fuzzy.max_distance(t)}
        found, _ = trie.match(w)
        assert (found is None) == (not near) and (not near or found[1] == min(near.values()) == near[found[0]])
    assert trie.match("vequaire") == (None, ["vequ"])


def test_quotation_and_address():
    m = toxicity.Matcher(["idiot"], {})
    inside, reported, addressed = toxicity.INSIDE, toxicity.REPORTED, toxicity.ADDRESSED
    assert m.text('he wrote "idiot" there') == {("idiot", 0, "idiot", inside + reported)}
    assert m.text('she said "you are an idiot"') == {("idiot", 0, "idiot", inside + reported)}  # the speaker's "you" is no address
    assert m.text("you idiiot") == {("idiot", 1, "idiiot", addressed)}
    assert m.text('you "idiot"') == {("idiot", 0, "idiot", inside + addressed)}
    assert m.text("an 1d10t here") == {("idiot", 0, "1d10t", 0)} and m.text("fine") == set()
    assert m.text('"' + "x " * 80 + 'idiot "') == {("idiot", 0, "idiot", 0)}  # no quotation is that long


def test_edits_and_contexts_decide(spark):
    """Misspellings that the labels lack are caught, quoted ones and ordinary words aren't; without edits or contexts it is otherwise."""
    rng = random.Random(9)
    filler = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    # "brute" and "oaf" are learned from labels; "loses" is an ordinary word next to "loser".
    rows = [(k, f"{filler(8)} {['the brute', 'a nasty oaf', 'you loser'][k % 3]} {filler(8)}", 1) for k in range(60)]
    rows += [(k, f"{filler(12)} loses {filler(5)}", 0) for k in range(60, 200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "brute" in model.words and "brute" not in toxicity.SEEDS
    probes = {"you idiiot": 1, "such a worthles thing": 1, "what a brutte": 1, 'she said "you are an idiot"': 0, "you are an idiot": 1, 'he called it "stupid" once': 0, "who loses here": 0, "a fine day": 0, "": 0}
    texts = spark.createDataFrame(list(enumerate(probes)), "doc_id int, text string")
    predict = lambda **kw: [r["predicted"] for r in toxicity.score(texts, model, **kw).orderBy("doc_id").collect()]
    assert predict() == list(probes.values())
    assert predict(edits=False)[:4] == [0, 0, 0, 0] and predict(contexts=False)[3:6] == [1, 1, 1]


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, MID).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{MID}/labels.parquet").collect()]
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p and not y for p, y in held) <= 1 and sum(p and y for p, y in held) >= 0.6 * sum(y for _, y in held)


def test_toxicity_learns_from_any_number_of_rows(spark):
    table, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    for rows in (0, 1, 50):
        some = table.where(F.col("doc_id") < rows)
        assert toxicity.score(some, toxicity.fit(some, labels)).count() == rows


def test_toxicity_edges(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "idiot " * 3), (3, "fine"), (None, "x"), (4, "you moron! " + "word " * 60_000)])
    rows = rows.withColumns({"score": F.lit("s"), "predicted": F.lit(7)})
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    got = toxicity.score(rows, model, keep=["doc_id", "text", "n"]).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["predicted"]} == {3, 4}
    kept = toxicity.clean(rows, model)
    assert kept.columns == rows.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3]
    none = toxicity.fit(rows.where("false"), labels.where("false"))
    assert toxicity.score(rows.where("false"), none).count() == 0 and toxicity.clean(rows.where("false"), none).count() == 0


# ── suffix arrays ────────────────────────────────────────────────────────────


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_array(small, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
    rng = random.Random(2)
    for _ in range(150):
        k = rng.choice([1, 2, 3, 9])
        t = [rng.randint(1, k) for _ in range(rng.randint(0, 50))] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert list(suffixes.suffix_array(np.array(t), k + 1)) == want
        lcp = [0] * len(t)
        for a, b in zip(want, want[1:], strict=False):
            while max(a, b) + lcp[b] < len(t) and t[a + lcp[b]] == t[b + lcp[b]]:
                lcp[b] += 1
        assert list(suffixes.common_prefixes(np.array(t), np.array(want))) == lcp


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(spark, rows, **kw):
    got = suffix_dedup.remove_repeats(docs(spark, rows), **kw)
    return sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(3)
    words = ["über", "the", "an", "ring", "x", "né"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows = text(40), [(None, "a" * 400), (0, "ab" * 300), (1, None), (2, ""), (3, "short")]
    rows += [(k, text(rng.randint(1, 60)) + (passage[rng.randint(0, 30) :] if k % 3 == 0 else "") + text(20)) for k in range(10, 60)]
    rows += [(70, rows[20][1]), (71, rows[20][1])]
    want = brute_repeats(rows, 100)
    assert repeats(spark, rows) == want and sum(r[2] for r in want) > 1000
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 2)  # all anchors with more runs are cut
    assert repeats(spark, rows) == want
    for name, value in {"LOOKED_AT": 1, "FREQUENT": 1, "SALTS": 3, "COPY_SALTS": 2}.items():
        monkeypatch.setattr(suffix_dedup, name, value)  # all anchors are frequent and dealt over groups
    assert repeats(spark, rows) == want
    assert repeats(spark, []) == []
    twice = repeats(spark, [(5, "q" * 50 + passage), (5, "q" * 50 + passage)])
    assert twice[0] == twice[1] and twice[0][2] == 0


def test_suffix_dedup_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op6_suffix_dedup(spark, DIR).collect()), key=str) == brute_repeats(rows, 100)


# ── nearest neighbours ───────────────────────────────────────────────────────


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 4)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=6))]) for k in range(120)]
    rows += [(200 + k, rows[5][1]) for k in range(20)]
    sound = dict(rows)
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [math.nan] * 6), (304, [math.inf] + [1.0] * 5), (305, [None] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for shard_rows, sample in ((20_000, 8192), (30, 8192), (7, 40)):
        monkeypatch.setattr(ann, "SAMPLE", sample)
        out = ann.nearest(df, F.col("vec_id") % 5 == 0, k=5, shard_rows=shard_rows).collect()
        got[shard_rows] = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    x = {i: np.array(v, dtype=np.float64) for i, v in sound.items()}
    for q in (i for i in x if i % 5 == 0):
        cos = sorted(((-round(float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), 12), i) for i, v in x.items() if i != q))[:5]
        for g in got.values():
            assert [g[q, k][0] for k in range(1, 6)] == [i for _, i in cos] and [g[q, k][1] for k in range(1, 6)] == pytest.approx([-c for c, _ in cos])
    assert ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, k=5).count() == 2
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_nearest_of_extreme_and_repeated_rows(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e-200, 2e-200, 1e-200]), (2, [3.0, 1.0, 1.0]), (3, [1.0, 2.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [5e-324, 0.0, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id").isin(0, 3), k=2).collect()
    assert len(out) == 2 + 3 * 2
    far = {r["vec_id"]: r["score"] for r in out if r["query_id"] == 0}
    assert far == {1: pytest.approx(5 / math.sqrt(5 * 6)), 2: pytest.approx(5 / math.sqrt(5 * 11))}
    assert sorted(round(r["score"], 9) for r in out if r["query_id"] == 3) == [0.8, 0.8, 0.8, 0.8, 1.0, 1.0]


def test_relaxed_search_recall(spark):
    exact = {(r["query_id"], r["vec_id"]) for r in queries.op9_ann(spark, MID).collect()}
    vectors = spark.read.parquet(f"{MID}/embeddings.parquet").select("vec_id", "embedding")
    loose = {(r["query_id"], r["vec_id"]) for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0, relax=0.8).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)


# ── near duplicates ──────────────────────────────────────────────────────────


def test_components(spark):
    rng = random.Random(5)
    for n in (0, 3, 60):
        edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)] + [(200 + k, 201 + k) for k in range(20) if n]
        root = {v: v for e in edges for v in e}
        for _ in range(200):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {v: r for v, r in root.items() if v in got} and all(root[v] == v for v in set(root) - set(got))


def brute_duplicates(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    comp = [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        before = list(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return sorted((rows[k][0], len(sets[k]), comp[k], comp[k] == rows[k][0]) for k in range(len(rows)))


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(30))
    rows, base = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "É É É É É"), (7, "é é é é é")], [word() for _ in range(90)]
    for k in range(10, 60):  # a chain: each text is near the one before
        base[rng.randrange(90)] = word()
        rows.append((k, " ".join(base)))
    shared = " ".join(word() for _ in range(40))
    rows += [(k, shared + " " + " ".join(word() for _ in range(40))) for k in range(60, 100)]
    rows += [(k, rows[20][1].upper()) for k in range(100, 110)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(spark, rows), words=4).collect())
    assert got == brute_duplicates(rows, 4, 80)


@pytest.mark.parametrize("hot", [64, 8])
def test_near_duplicates_in_a_family(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(7)
    words = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    passage = words(200)
    own = [words(33) for _ in range(400)]  # mutually at 0.75
    own += [own[k][:9] + words(24) for k in range(0, 400, 10)]  # at 0.81 to one each
    rows = [(k, " ".join(passage + w)) for k, w in enumerate(own)]
    want = brute_duplicates(rows, 4, 80)
    assert sum(kept for *_, kept in want) == 400
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs(spark, rows), words=4).collect()) == want


def test_exact_pairs_lose_no_component(spark):
    """Families of sets near the threshold, with hot parts that differ, against all pairs."""
    rng = random.Random(8)
    sets = {}
    for f in range(3):
        body = [1000 * f + k for k in range(30)]
        for m in range(25):
            part = set(rng.sample(body, rng.choice([24, 27, 29, 30]))) if m % 3 else set(body)
            sets[100 * f + m] = part | {rng.randrange(10**6, 10**6 + 40) for _ in range(rng.choice([0, 2, 5, 7, 9]))}
    links = [(a, b) for a in sets for b in sets if a < b and 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]))]

    def reach(edges):
        root = {k: k for k in sets}
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    known = [e for e in links if rng.random() < 0.02]  # what earlier stages linked
    start = reach(known)
    df = spark.createDataFrame([(k, len(v), start[k], sorted(v)) for k, v in sets.items()], "node long, size long, comp long, items array<long>")
    for hot in (2, 8, 64):
        found = {tuple(sorted(r)) for r in minhash.exact_pairs(df, 80, hot).collect()}
        assert reach(known + [e for e in links if e in found]) == reach(links)
    assert len(set(start.values())) > len(set(reach(links).values())) > 3


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    nobody = " ".join(f"w{k}" for k in range(60))  # without an id, and a near copy with one
    got = minhash.near_duplicates(docs(spark, [(None, nobody), (7, nobody + " more")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 7, False), (7, 7, True)}
    got = minhash.near_duplicates(docs(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (5, "q"), (5, "q"), (5, "r s")])).collect()
    assert [(r["component_id"], r["kept"]) for r in sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_shingles"]))] == [(9, False)] * 2 + [(5, True)] * 3 + [(9, True)]


def test_near_duplicates_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op10_minhash(spark, DIR).collect()) == brute_duplicates(rows, 4, 80)


# ── pipeline ─────────────────────────────────────────────────────────────────


def test_pipeline(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, stage = table.columns, dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    clean = stage["toxicity"](spark, table, DIR)
    unique = stage["near_duplicates"](spark, clean, DIR)
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert {r["doc_id"] for r in unique.collect()} == {i for i, _, _, kept in brute_duplicates(rows, 5, 80) if kept}
    pure = stage["decontamination"](spark, unique, DIR)
    leaks = {r["doc_id"] for r in queries.op3_decontamination(spark, DIR).collect()}
    assert {r["doc_id"] for r in pure.collect()} == {r["doc_id"] for r in unique.collect()} - leaks
    mixed = stage["mixing"](spark, pure, DIR)
    assert all(df.columns == columns for df in (clean, unique, pure, mixed))
    assert all(1 <= r["count"] <= 2 for r in mixed.groupBy("doc_id").count().collect())
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() == mixed.count() and set(out.columns) == {*columns, "shard", "slot"}
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r["n"] == r["d"] == r["m"] + 1


def test_pipeline_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, null and empty texts, and columns called like the stages' own."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two = text(60), text(60)
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = [(5, one), (5, one), (None, one + " end"), (None, two), (None, text(40)), (3, None), (3, ""), (3, text(30)), (3, text(30)), (9, "you idiot and moron"), (None, f"so. {item} and on")]
    extra = ["score", "predicted", "shard", "Slot", "row", "id", "copy", "copies", "comp", "leak", "size", "target", "taken", "luck", "node", "text_digest", "drawn", "a.b"]
    rows = [(i, t, "en", "s", 0, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    clean = stage["toxicity"](spark, df, DIR)
    assert clean.columns == df.columns and ids(clean) == ids(df.where("doc_id is null or doc_id <> 9"))
    unique = stage["near_duplicates"](spark, clean, DIR)
    left = unique.collect()
    assert unique.columns == df.columns and [r["doc_id"] for r in left if (r["text"] or "").startswith(one)] == [5] and len(left) == 8
    pure = stage["decontamination"](spark, unique, DIR)
    assert pure.columns == df.columns and pure.count() == 7 and not pure.where(F.col("text").contains(item)).count()
    mixed = stage["mixing"](spark, pure, DIR)
    words = {r["row"]: len(r["text"].split()) for r in pure.collect() if r["text"]}
    taken = [r["row"] for r in mixed.collect()]
    assert mixed.columns == df.columns and set(taken) == set(words) and max(taken.count(k) for k in words) <= 2
    assert abs(sum(words[k] for k in taken) - 1.5 * sum(words.values())) <= max(words.values()) / 2
    out = stage["sharding"](spark, mixed, DIR)
    assert set(out.columns) == {c for c in df.columns if c not in ("shard", "Slot")} | {"source_shard", "source_Slot", "shard", "slot"} and out.count() == mixed.count()


def test_pipeline_of_nothing(spark):
    docs_ = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, DIR)
    assert docs_.count() == 0
