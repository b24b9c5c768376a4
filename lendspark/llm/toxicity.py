"""Toxicity by a lexicon that labels teach, matched with spelling errors.

Words and stems that labelled toxic texts have and clean ones lack make the
lexicon; a few seeds are its start. Words of a text are matched against it by
Levenshtein automata over its trie. What a match is worth is learned at three
levels: the term's share of toxic texts, what an edit takes off it, and what
its context takes off it - a window around the match, and the quotation marks
around it, tell quotation from abuse. A word that clean texts use is no
misspelling, however near to a term.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .fuzzy import FuzzyTrie

#: Common insults to begin with; labels add terms and give all of them their weights.
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumbass asshole bastard bitch retard freak pig idiota imbécil estúpido basura connard salaud ordure crétin trottel arschloch dummkopf abschaum".split()

#: Words that introduce a quotation, and that address somebody.
REPORTING = frozenset("said says wrote writes quote quoted quoting called term word phrase dit écrit sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your yours u ur du dich dein ihr sie tu te vous toi tú usted vosotros".split())

#: Letters that digits and signs stand for.
LEET = str.maketrans("013457@$", "oieastas")

#: Labelled rows that the lexicon and its weights are fitted on, at most: a sample by hash.
TRAIN_ROWS = 10_000

#: Contexts of a match: bits that add up, and what a match is worth in each before labels.
INSIDE, REPORTED, ADDRESSED = 1, 2, 4
CONTEXT_PRIOR = {0: 1.0, ADDRESSED: 1.0, REPORTED: 0.6, REPORTED + ADDRESSED: 0.9, INSIDE: 0.45, INSIDE + ADDRESSED: 0.6, INSIDE + REPORTED: 0.2, INSIDE + REPORTED + ADDRESSED: 0.35}

#: What an edited term is worth before labels, by edits and whether the term is long.
EDIT_PRIOR = {(1, False): 0.75, (1, True): 0.85, (2, True): 0.6}
LONG_TERM = 9

#: Weights of the priors, in texts (terms, stems) or kinds (edits, contexts).
TERM_WEIGHT, POOL_WEIGHT = 3, 10

#: Matches of less than this share add nothing to each other.
FAINT = 0.25

STEM_LENGTHS = (4, 5, 6, 7)
MOST_TIMES = 4

#: A stem's density is told by the words of the text for each word that has the stem.
DENSITIES = (300, 150, 100, 60)

WINDOW = 4
QUOTE_WORDS = 60
_WORD = re.compile(r"[\w@$]+")
_PLAIN = re.compile(r"\w+")
_SPAN = re.compile(r"[\w@$]+|[\"“”«»„]")
_CACHE = 500_000

#: A match: (term, edits, the word as written, context) or (stem and a star, times, "", density).
Match = tuple[str, int, str, int]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of all training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quotations(spans: list[str]) -> tuple[list[str], list[tuple[int, int] | None]]:
    """The words of ``spans``, which also has quotation marks, and for each word
    the quotation (first word, end) that it lies in. A mark that isn't closed
    within ``QUOTE_WORDS`` words opens none."""
    words: list[str] = []
    inside: list[tuple[int, int] | None] = []
    start = None
    for s in spans:
        if s not in "\"“”«»„":
            words.append(s)
            inside.append(None)
        elif s in "“«„" or start is None or len(words) - start > QUOTE_WORDS:
            start = None if s in "”»" else len(words)
        else:
            inside[start:] = [(start, len(words))] * (len(words) - start)
            start = None
    return words, inside


class Matcher:
    """Matches of a text; ``edits=False`` takes exact ones only."""

    def __init__(self, words: list[str], stems: dict[str, int], edits: bool = True):
        self.trie = FuzzyTrie(words, list(stems))
        self.stems, self.edits = stems, edits
        self.known: dict[str, tuple[tuple[str, int] | None, list[str]]] = {}

    def word(self, w: str) -> tuple[tuple[str, int] | None, list[str]]:
        """The nearest term with its edits, and all stems that the word begins with."""
        if w not in self.known:
            if len(self.known) >= _CACHE:
                self.known.clear()
            found, stems = self.trie.match(w)
            if found is None and not w.isalpha():
                plain = w.translate(LEET)
                found = self.trie.match(plain)[0] if plain != w else None
            if found and found[1] and not self.edits:
                found = None
            self.known[w] = found, stems
        return self.known[w]

    def context(self, k: int, words: list[str], inside: list[tuple[int, int] | None]) -> int:
        """Of the word at ``k``: whether it is quoted, whether a quotation is
        introduced next to it, and whether somebody is addressed near it.
        What stands in a quotation is the quoted speaker's: of a quoted word,
        the words before and after the quotation tell."""
        quote = inside[k]
        a, z = (quote[0] - WINDOW, quote[1] + WINDOW) if quote else (k - WINDOW, k + WINDOW + 1)
        near = {words[i] for i in range(max(0, a), min(len(words), z)) if inside[i] is None}
        return (INSIDE if quote else 0) + (REPORTED if near & REPORTING else 0) + (ADDRESSED if near & ADDRESS else 0)

    def text(self, text: str) -> set[Match]:
        low = text.lower()
        hit = {w for w in set(_WORD.findall(low)) if any(self.word(w))}
        if not hit:
            return set()
        words, inside = quotations(_SPAN.findall(low))
        out: set[Match] = set()
        times: Counter = Counter()
        for k, w in enumerate(words):
            if w not in hit:
                continue
            found, stems = self.word(w)
            times.update(stems)
            if found:
                out.add((*found, w, self.context(k, words, inside)))
        dense = lambda n: sum(d * n >= len(words) for d in DENSITIES)
        return out | {(f"{s}*", min(n, MOST_TIMES), "", dense(n)) for s, n in times.items() if n >= self.stems[s]}


def features(text: str) -> set[str]:
    """The text's words, and its stems: "stem*", "stem**" and so on if a stem
    occurs at least once, twice and so on."""
    words = _PLAIN.findall(text.lower())
    stems = Counter(w[:n] for w in words for n in STEM_LENGTHS if len(w) > n)
    return {*words, *(s + "*" * k for s, n in stems.items() for k in range(1, min(n, MOST_TIMES) + 1))}


def _rows(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    """Typed columns, also if they are empty or all null."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_COUNTS = pa.schema([("f", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("f", pa.string()), ("h", pa.int64())])
_KINDS = pa.schema([("toxic", pa.int32()), ("term", pa.string()), ("a", pa.int32()), ("word", pa.string()), ("b", pa.int32())])


def _counted(wanted: set[str] | None):
    """Counts of texts by feature, of each batch, so that little is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 500):
                counts: Counter = Counter()
                for text in texts[k : k + 500]:
                    counts.update(features(text) if wanted is None else features(text) & wanted)
                yield _rows(_COUNTS, list(counts), list(counts.values()))

    return run


def _terms(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], dict[str, int]]:
    """Words, and stems with the times they must occur, that mark toxic texts.

    Chosen greedily by the toxic texts that they add, until what is left may be
    chance. ``sample`` (h, text, toxic) is bounded, and each choice adds
    several of its toxic texts, so the lexicon is bounded by it alone.
    """
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    least = max(3, math.ceil(0.002 * n_toxic))
    rate = math.log((n_toxic + n_clean) / n_toxic)
    telling = lambda t: t * rate >= 9  # noqa: E731  # so many toxic texts, and hardly a clean one, are rare by chance
    count = lambda df, wanted: df.select("text").mapInArrow(_counted(wanted), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    seen = {r["f"]: r["n"] for r in count(toxic, None).where(F.col("n") >= least).collect() if telling(r["n"])}
    in_clean = {r["f"]: r["n"] for r in count(clean, set(seen)).collect()} if n_clean and seen else {}
    strong = {f for f, t in seen.items() if (t + 1) / (t + in_clean.get(f, 0) + 2) >= 0.8}

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, h) for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in features(text) & strong]
            yield _rows(_PAIRS, [f for f, _ in rows], [h for _, h in rows])

    pairs = toxic.select("h", "text").mapInArrow(having, "f string, h long").groupBy("f").agg(F.collect_set("h").alias("hs"))
    left = {r["f"]: set(r["hs"]) for r in pairs.collect()} if strong else {}
    chosen: list[str] = []
    covered = 0
    while left:
        best = min(left, key=lambda f: (-len(left[f]), f.endswith("*"), -len(f), f))
        new, open_ = left.pop(best), n_toxic - covered
        if len(new) * math.log((open_ + n_clean) / open_) < 9:
            break
        chosen.append(best)
        covered += len(new)
        left = {f: rest for f, hs in left.items() if len(rest := hs - new) >= least}
    stems: dict[str, int] = {}
    for f in (f for f in chosen if f.endswith("*")):
        stem = f.rstrip("*")
        stems[stem] = min(len(f) - len(stem), stems.get(stem, MOST_TIMES))
    return [f for f in chosen if not f.endswith("*")], stems


class Model:
    """The lexicon and what its matches are worth."""

    def __init__(self, words: list[str], stems: dict[str, int], base: float):
        self.words, self.stems, self.base = words, stems, base
        self.terms: dict[str, float] = {}
        self.edits: dict[tuple[str, int], float] = {}
        self.pool = dict(EDIT_PRIOR)
        self.contexts = dict(CONTEXT_PRIOR)
        self.written: dict[tuple[str, int, str], tuple[int, int]] = {}
        self.dense: dict[tuple[int, int], float] = {}
        self.stem_shares: dict[tuple[str, int, int], float] = {}

    def learn(self, kinds: list[tuple[str, int, str, int, int, int]]) -> None:
        """From (term, a, word, b, toxic texts, texts) of all matches, and of the
        plainest context of each text as term ""."""
        words = [k for k in kinds if k[0] and not k[0].endswith("*") and k[3] in (0, ADDRESSED)]
        for term, a, word, _, t, n in words:
            had = self.written.get((term, a, word), (0, 0))
            self.written[term, a, word] = had[0] + t, had[1] + n
        exact: dict[str, tuple[int, int]] = {}
        near: dict[tuple[str, int], list[float]] = {}
        for (term, a, _), (t, n) in self.written.items():
            if a == 0:
                had = exact.get(term, (0, 0))
                exact[term] = had[0] + t, had[1] + n
            else:
                near.setdefault((term, a), []).append(t / n)
        self.terms = {term: (t + TERM_WEIGHT * 0.9) / (n + TERM_WEIGHT) for term, (t, n) in exact.items()}
        # Each word next to a term counts once, then each term: what the words next to a term say is the term's own first.
        for (a, long), prior in EDIT_PRIOR.items():
            all_ = [sum(v) / len(v) if (v := near.get((w, a))) else prior for w in self.words if (len(w) >= LONG_TERM) == long]
            self.pool[a, long] = (sum(all_) + POOL_WEIGHT * prior) / (len(all_) + POOL_WEIGHT)
        self.edits = {(w, a): (sum(v) + TERM_WEIGHT * self.pool[a, len(w) >= LONG_TERM]) / (len(v) + TERM_WEIGHT) for (w, a), v in near.items()}
        for _, _, _, b, t, n in (k for k in kinds if not k[0]):
            if b not in (0, ADDRESSED):
                self.contexts[b] = (t + POOL_WEIGHT * CONTEXT_PRIOR[b]) / (n + POOL_WEIGHT)
        stems = [k for k in kinds if k[0].endswith("*")]
        total: dict[tuple[int, int], tuple[int, int]] = {}
        for _, a, _, b, t, n in stems:
            had = total.get((a, b), (0, 0))
            total[a, b] = had[0] + t, had[1] + n
        self.dense = {k: (t + 1) / (n + 2) for k, (t, n) in total.items()}
        self.stem_shares = {(s, a, b): (t + TERM_WEIGHT * self.dense[a, b]) / (n + TERM_WEIGHT) for s, a, _, b, t, n in stems}

    def share(self, match: Match) -> float:
        """How likely a text with this match is toxic, by it alone."""
        term, a, word, b = match
        if term.endswith("*"):
            return self.stem_shares.get((term, a, b), self.dense.get((a, b), 0.5))
        worth = self.terms.get(term, 0.9) * (self.edits.get((term, a), self.pool[a, len(term) >= LONG_TERM]) if a else 1.0)
        t, n = self.written.get((term, a, word), (0, 0))
        return (t + TERM_WEIGHT * worth) / (n + TERM_WEIGHT) * self.contexts[b]

    def score(self, matches: set[Match]) -> float:
        """1 minus the chance that all matches mislead. Of faint and of quoted
        ones only the strongest counts, as they say nothing together."""
        lone, rest = self.base, 1.0
        for m in matches:
            share = self.share(m)
            if share < FAINT or (not m[0].endswith("*") and m[3] & (INSIDE | REPORTED) and share < 0.5):
                lone = max(lone, share)
            else:
                rest *= 1 - share
        return min(1.0, max(lone, 1 - rest))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled ``docs`` (doc_id, text) that aren't held out.

    ``labels`` has doc_id and toxic. At most about ``train_rows`` rows are used,
    a sample by hash of doc_id. Equal texts count once, as toxic if one of them
    is. Null doc_ids, labels and texts teach nothing. Without usable labels the
    seeds and the priors remain.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    # About ``train_rows`` ids, so they may be broadcast, and texts stay where they are.
    kind = docs.schema["doc_id"].dataType
    sample = docs.select("doc_id", "text").join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast(kind))), "doc_id").where("text is not null")
    sample = written(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n_toxic, n_clean = int(total["t"]), int(total["n"] - total["t"])
    learned, stems = _terms(sample, n_toxic, n_clean) if n_toxic else ([], {})
    words = list(dict.fromkeys([*learned, *SEEDS]))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words, stems)
        plainest = lambda ms: max((m[3] for m in ms), key=lambda b: (CONTEXT_PRIOR[b], b))
        for batch in batches:
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = matcher.text(text)
                exact = [m for m in found if m[1] == 0 and not m[0].endswith("*")]
                rows += [(y, *m) for m in found] or [(y, None, 0, "", 0)]
                rows += [(y, "", 0, "", plainest(exact))] if exact else []
            yield _rows(_KINDS, *([list(c) for c in zip(*rows, strict=True)] or [[]] * 5))

    seen = sample.select("text", "toxic").mapInArrow(kinds, "toxic int, term string, a int, word string, b int")
    seen = seen.groupBy("term", "a", "word", "b").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    base = next((min(0.4, (r["t"] + 0.1) / (r["n"] + 1)) for r in seen if r["term"] is None), 0.2 * n_toxic / max(1, n_toxic + n_clean))
    model = Model(words, stems, base)
    model.learn([(r["term"], r["a"], r["word"], r["b"], r["t"], r["n"]) for r in seen if r["term"] is not None])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, edits: bool = True, contexts: bool = True) -> DataFrame:
    """``keep`` (default doc_id) with score and predicted, 1 from a score of 0.5.

    Only text is looked at. Null and empty texts get the score of a text
    without matches. A row is scored on its own, however long its text.
    ``edits`` and ``contexts`` switch off the automata's edits and the contexts,
    to see what they decide. Columns of ``keep`` may not be called score or
    predicted; ``clean`` takes any.
    """
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model, edits, contexts)
        for batch in batches:
            scores = [scorer(t) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't predict to be toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < 0.5 for t in batch.column(text).to_pylist()], pa.bool_()))

    # Plain names on the way, as Python functions don't take names with dots.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = docs.columns.index("text")
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class _Scorer:
    """Scores of texts; it lives as long as a task."""

    def __init__(self, model: Model, edits: bool = True, contexts: bool = True):
        self.model, self.matcher, self.contexts = model, Matcher(model.words, model.stems, edits), contexts

    def __call__(self, text: str | None) -> float:
        found = self.matcher.text(text) if text else set()
        if not self.contexts:
            found = {m if m[0].endswith("*") else (*m[:3], 0) for m in found}
        return self.model.score(found) if found else self.model.base
