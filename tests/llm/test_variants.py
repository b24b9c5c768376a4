"""Spelling variants against brute force, with crowded chunks, slips and edge cases."""

import random
import re
import zlib

import pytest

from lendspark.llm import variants

SCHEMA = "doc_id long, text string, word string, key int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, least_n=5):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] = count.get(run, 0) + 1
    words = {w: n for w, n in count.items() if n >= least_n}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()}


def got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def family(rng, stem, n):
    """Words within a few edits of a stem, so that many share its halves and quarters."""
    out = [stem]
    for _ in range(n):
        w = list(rng.choice(out))
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "ß"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("shared", [1, 64])
def test_groups_equal_brute_force(spark, shared):
    rng = random.Random(7)
    words = [w for stem in ("constructions", "Élévation", "abababababab", "ababab", "aaaaaaa") for w in family(rng, stem, 60)]
    words += ["wörter" + c for c in "abcdefghijklmnopqrstuvwxyz"] + ["x" + c + "yyyyyyyy" for c in "abcdefgh"]
    rows = [(k, " ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=120))) for k in range(60)]
    rows += [(100 + k, "gardening " * 60 + "Gardning/" * 11 + "gardnin; gardnin") for k in range(3)]  # a chain of forms
    rows += [(200, None), (201, ""), (None, "constructions wörtera"), (1, rows[1][1]), (1, rows[1][1]), (300, "a" * 3000 + " " + "b" * 6)]
    out = variants.group_variants(docs(spark, rows), shared=shared)
    want = brute(rows)
    assert got(out) == want and len(want) > 150 and any(f and r != f for _, f, r, *_ in want)


def test_slips(spark):
    """Some runs lose a sign; a word of six signs that loses one is none."""
    rows = [(k, "analysis Zürich banana") for k in range(3000)]
    out = got(variants.group_variants(docs(spark, rows), least_n=1))
    assert out == brute(rows, 1) and sum(r == "analysis" for _, _, r, *_ in out) > 4 and not any(len(w) < 6 for w, *_ in out)


def test_no_words(spark):
    assert variants.group_variants(docs(spark, [])).count() == 0
    assert variants.group_variants(docs(spark, [(1, None), (2, "short ab 123456")])).count() == 0
