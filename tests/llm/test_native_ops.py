"""Chat formatting, WARC derivatives, decontamination, mixing, licences, sharding."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendspark.llm import chat, decontam, licenses, mixing, oracles, queries, sharding, warc

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) with the table's other columns and clashing extra ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "x") for r in rows]
    return spark.createDataFrame(full, DOCS + ", n int, w string")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    want = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\e", "\\l", "\\b", "<", "[", "a", "é", "\n", " ", "😀"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", None]), st.none() | PIECES), min_size=1, max_size=7))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, k, r, t, 5) for k, (r, t) in enumerate(turns)], "conv_id int, turn int, role string, text string, n int")
    row = chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(r["role"], r["text"]) for r in row["back"]] == [(r or "", t or "") for r, t in turns]
    assert row["loss"] == "".join(t or "" for r, t in turns if r == "assistant")
    assert row["formatted_chars"] == len(row["formatted"])


def test_chat_edges(spark):
    schema = "conv_id int, turn int, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, "user", "b"), (None, None, "user", "a"), (1, 1, "user", "y"), (1, 1, "user", "x"), (1, 1, "user", "x")]
    out = chat.format_chats(spark.createDataFrame(rows, schema)).select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [t["text"] for t in r["t"]] for r in out} == {None: ["a", "b"], 1: ["x", "x", "y"]}


def test_warc(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><!-- no --><p>One</p><a href="/a?b&amp;c">Two</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x/", html, 0), (2, None, None, 0), (3, "u", "", 0)], "page_id long, url string, html string, block int")
    records = warc.responses(pages)
    rows = {(r["page_id"], r["record_type"]): r for r in warc.derive(records).collect()}
    ids = {r["page_id"]: r["record_id"] for r in records.collect()}
    assert len(rows) == 6 and len({r["record_id"] for r in rows.values()}) == 6
    conversion, metadata = rows[1, "conversion"], rows[1, "metadata"]
    assert conversion["block"] == "A & B\nOne\nTwo"
    assert "outlink: /a?b&c\r\n" in metadata["block"] and "title: A & B\r\n" in metadata["block"] and "source-HTTP/1.1 200 OK" in metadata["block"]
    for (page, _), r in rows.items():
        assert r["refers_to"] == ids[page] and f"WARC-Refers-To: {ids[page]}\r\n" in r["header"]
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    assert rows[1, "conversion"]["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", metadata["record_id"])
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0


ITEM = "a train leaves the old station at 9 with Maria and travels 120 km to the far coast where Maria waits for 9 more people"


def test_decontamination_catches_new_values(spark):
    benchmark = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (9, "too short", 1), (10, ITEM, 1)], "item_id long, text string, pos int")
    changed = ITEM.replace("Maria", "Peter").replace("9", "5").replace("120", "80")
    uneven = ITEM.replace("with Maria", "with Peter").replace("at 9", "at 4")  # one name and number became two
    rows = [(1, f"so it goes. {ITEM} and on"), (2, f"and then {changed} ok"), (3, f"but {uneven} no"), (4, "a clean text about trains and stations " * 5), (5, None), (6, ""), (2, f"and then {changed} ok")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert set(got) == {(1, 7), (1, 10), (2, 7), (2, 10)}
    assert got[1, 7]["exact"] and not got[2, 7]["exact"] and got[2, 7]["n_slots"] == 6
    assert decontam.contaminated(docs(spark, rows).where("false"), benchmark).count() == 0
    assert decontam.contaminated(docs(spark, rows), benchmark.where("false")).count() == 0


def test_decontamination_checks_matched_slots_only(spark):
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    part = ITEM[: ITEM.index("where Maria")] + "and finds with 4 others that none of the Peters is at home by now"
    got = decontam.contaminated(docs(spark, [(1, f"so it goes. {part}")]), benchmark).collect()
    assert [(r["n_slots"], r["exact"]) for r in got] == [(4, True)]


def test_decontamination_adds_up_close_shifts(spark):
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    words = ITEM.split()
    more, less = words[:12] + ["slowly"] + words[12:], words[:12] + words[13:]
    far = words[:12] + ["filler"] * 40 + words[12:]
    rows = [(k, "so it goes. " + " ".join(w) + " and on") for k, w in enumerate([more, less, far])]
    got = {r["doc_id"]: r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert set(got) == {0, 1} and all(r["exact"] for r in got.values())


def leaks(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}


def test_decontamination_of_short_items(spark):
    items = [(1, "What is the capital of France?"), (2, "ok then"), (3, "Add 7 to 9 and double it")]
    rows = [(1, "they asked: what is the capital of France? nobody knew"), (2, "what is the capital of Spain? ok then"), (3, "please add 7 to 9 and double it now"), (4, "please add 7 to 8 and double it now")]
    assert set(leaks(spark, rows, items)) == {(1, 1), (3, 3)}


def test_decontamination_slots_anywhere(spark):
    """Names at the start of sentences and lines and in quotes, and slots of several words."""
    item = 'Maria Gomez has 1 200 apples. Peter takes some of them away and says "Maria counts what is left" to the child'
    changed = 'Anna has 900 apples. John Smith takes some of them away and says "Anna counts what is left" to the child'
    uneven = changed.replace('"Anna', '"Lisa').replace("Anna has", "Anna Berg has")
    got = leaks(spark, [(1, f"a start. {changed}\nend"), (2, f"first\n{item}"), (None, f"so. {item}"), (3, "so. " + uneven), (4, f"told by Zoe {item}")], [(5, item)])
    # "maria gomez" and "maria" are two values, so each may stand for its own.
    assert set(got) == {(1, 5), (2, 5), (None, 5), (3, 5), (4, 5)}
    assert got[2, 5]["exact"] and got[4, 5]["exact"] and got[None, 5]["exact"] and not got[1, 5]["exact"] and got[1, 5]["n_slots"] == 4
    twice = "a Maria and a Peter went to see whether Maria or Peter had won"
    assert leaks(spark, [(1, twice.replace("or Peter", "or Lisa")), (2, twice.replace("Peter", "Lisa"))], [(6, twice)]).keys() == {(2, 6)}


def test_decontamination_of_rows_with_one_id(spark):
    half = ITEM.split()
    rows = [(1, " ".join(half[:10])), (1, " ".join(half[14:])), (None, "x"), (None, ITEM), (2, ITEM), (2, ITEM)]
    assert set(leaks(spark, rows, [(7, ITEM)])) == {(None, 7), (2, 7)}


def test_decontamination_matches_brute_force(spark):
    items = {r["item_id"]: re.findall(r"[^\W\d_]+", r["text"].lower()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        words = re.findall(r"[^\W\d_]+", r["text"].lower())
        have = {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        for item, w in items.items():
            grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            if grams and sum(g in have for g in grams) >= 0.8 * len(grams):
                want.add((r["doc_id"], item))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontamination(spark, DIR).collect()}
    assert want and got == want


def test_mixing(spark):
    rows = [(k, "w " * (1 + k % 40), ["b", "a", "ü", None][(k * k) % 4]) for k in range(400)] + [(900, None, "a"), (901, "", "zero"), (None, "x y", "a"), (None, "x y", "a")]
    got = mixing.mix(docs(spark, rows), buckets=7).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs(spark, rows).repartition(7), buckets=7).collect()}
    assert {(r["doc_id"], r["taken"]) for r in got} == again and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    sources = sorted({r["source"] for r in got}, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    left = 1.5 * total
    while True:  # reshare until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    for s in sources:
        biggest = max(r["size"] for r in got if r["source"] == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= biggest / 2 + 1e-6
    assert mixing.mix(docs(spark, rows).where("false")).count() == 0


def test_mixing_takes_the_smallest_keys(spark):
    """Which documents: those of the smallest exponential keys, by quality, until the words come nearest the target."""
    table = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "source", "text")
    keys = table.select("doc_id", "source", (-F.log(mixing.uniform(F.lit(17), F.col("doc_id"), F.xxhash64("text"))) / mixing.quality_weight(F.col("text"))).alias("key")).collect()
    got = {r["doc_id"]: r for r in mixing.mix(table).collect()}
    assert len({r["taken"] // r["size"] for r in got.values() if r["size"]}) > 1
    for source in {r["source"] for r in got.values()}:
        mine = [got[r["doc_id"]] for r in sorted((k for k in keys if k["source"] == source), key=lambda r: (r["key"], r["doc_id"]))]
        epochs, rest = divmod(mine[0]["target"], mine[0]["source_size"])
        at = 0
        for r in mine:
            assert r["taken"] == r["size"] * (epochs + (at + r["size"] / 2 < rest))
            at += r["size"]


HIDDEN = ("any", "at", "range", "s", "r", "n", "first", "before", "key", "b", "c", "t", "within")


def test_hidden_names_may_be_taken(spark):
    """Columns called like the operators' own helpers pass through."""
    rows = docs(spark, [(k, "word " * (k % 7), f"s{k % 3}") for k in range(60)])
    taken = rows.withColumns({f"__{x}": F.lit(x) for x in HIDDEN})
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix(rows).collect()}
    mixed = mixing.mix(taken).collect()
    assert {r["doc_id"]: r["taken"] for r in mixed} == plain and all(r[f"__{x}"] == x for r in mixed for x in HIDDEN)
    slots = sharding.number_slots(sharding.assign_shards(taken, "doc_id", 4), "doc_id").collect()
    assert all(r[f"__{x}"] == x for r in slots for x in HIDDEN)
    assert {(r["shard"], r["slot"]) for r in slots} == {(s, i) for s in range(4) for i in range(sum(r["shard"] == s for r in slots))}


def test_ranges_of_keys_are_even(spark):
    """Low quality doesn't crowd the last range."""
    luck = (F.col("id") + 0.5) / 100_000
    for weight in (0.25, 1.0):
        key = -F.log(luck) / weight
        n = spark.range(100_000).groupBy(F.floor(F.lit(64) * (1 - F.exp(-key * mixing.LEAST_WEIGHT)))).count().agg(F.max("count")).first()[0]
        assert n <= 4 * 100_000 / 64 + 2


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def check_licenses(rows, got):
    assert len(got) == len(rows)
    for r in got:
        words = license_words(rows[r["doc_id"]])
        places = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        every = [k for v in places.values() for k in v]
        assert r["n_words"] == len(words) and r["n_base"] == len(every)
        assert r["first_word"] == (min(every) if every else None) and r["last_word"] == (max(every) if every else None)
        assert r["base_labels"] == ",".join(sorted(k for k, v in places.items() if v))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    # Labels and scores, one place after the other.
    texts = {i: license_words(t) for i, t in rows.items()}
    df = Counter(w for ws in texts.values() for w in set(ws))
    index = [sorted({*passage.split()}, key=lambda w: (df[w], w)) for _, _, passage in licenses.TEMPLATES]
    for r in got:
        ws, labels, shares = texts[r["doc_id"]], set(filter(None, r["base_labels"].split(","))), [1.0] if r["base_labels"] else []
        for (label, key, passage), words in zip(licenses.TEMPLATES, index, strict=True):
            p, key, rare = passage.split(), key.split(), [w for w in words if w in ws][:8]
            votes = max((len({p[k] for k in range(len(p)) if p[k] in rare and 0 <= k + rel < len(ws) and ws[k + rel] == p[k]}) for rel in range(-len(p), len(ws))), default=0)
            if votes >= max(1, min(3, len(words))) and any(ws[k : k + len(key)] == key for k in range(len(ws))):
                labels.add(label)
                shares.append(votes / len(rare))
        assert r["labels"] == ",".join(sorted(labels)) and r["score"] == pytest.approx(max(shares, default=0))


def test_licenses(spark):
    rows = {
        1: "Released under the MIT License.",
        2: "mit LICENSE mit license, The Apache\nLicense",
        3: "mitlicense mit-license MIT",
        4: "Redistribution and use in source and binary forms, with or without modification, are permitted",
        5: None,
        6: "",
        7: "Licensed under CC BY-NC 4.0.",
        8: "the license is under the software of the mit",
        9: "İmit license K license general public  license",
        10: " ".join(t for _, _, t in licenses.TEMPLATES) + " " + "prose about software and copies " * 200,
        11: "filler " * 3000 + licenses.TEMPLATES[9][2].upper() + " then " + licenses.TEMPLATES[14][2],
        12: licenses.TEMPLATES[7][2].replace("redistribution and use in source and binary forms", "use"),
    }
    got = licenses.scan(docs(spark, list(rows.items()))).collect()
    check_licenses(rows, got)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[4] == "bsd" and labels[7] == "cc-by-nc" and labels[8] == "" and labels[2] == "apache,mit"
    assert labels[10] == ",".join(sorted({x for x, _, _ in licenses.TEMPLATES})) and labels[11] == "isc,zlib" and labels[12] == ""
    assert licenses.scan(docs(spark, [(1, "a")]).where("false")).count() == 0


@pytest.mark.parametrize("holders", [10, 60, 200])
def test_common_licenses_are_found(spark, holders):
    """However many of 200 files hold a passage, all of them are found, and no other."""
    passage = licenses.TEMPLATES[7][2]
    rows = {k: f"file {k} has some code of its own, the source and the forms of it. " + passage * (k < holders) + " end" for k in range(200)}
    got = licenses.scan(docs(spark, list(rows.items()))).collect()
    assert {r["doc_id"] for r in got if r["labels"] == "bsd"} == set(range(holders)) and {r["labels"] for r in got} <= {"bsd", ""}
    check_licenses(rows, got)


def test_licenses_on_documents(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    check_licenses({r["doc_id"]: r["text"] for r in table.collect()}, queries.op7_licenses(spark, DIR).collect())


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 8, 9, 300])
def test_jump_hash(spark, n):
    keys = [0, 1, 2, 17, -1, -(2**63), 2**63 - 1, *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    got = df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r["s"] == jump(r["k"] or 0, n) for r in got)


def test_sharding(spark):
    rows = [(k, "é" * (k % 5)) for k in range(0, 30_000, 3)] + [(None, None), (None, ""), (3, "x"), (3, "x")]
    df = docs(spark, rows).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    got = sharding.number_slots(sharding.assign_shards(df, "doc_id", 8, grown="g"), "doc_id", ties=("crc",)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in mine]
        assert ids == sorted(ids)
    assert all(r["g"] in (r["shard"], 8) for r in got) and any(r["g"] == 8 for r in got)
    assert sharding.number_slots(sharding.assign_shards(df.where("false"), "doc_id", 8), "doc_id").count() == 0


def test_slots_of_sparse_and_repeated_keys(spark):
    """Ranges follow the rows, not the keys: there are no more of them than tasks and shards."""
    sparse = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.lit("a").alias("slot"))
    hot = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("k"), F.lit("b").alias("slot"))
    df = sharding.assign_shards(sparse.unionByName(hot), "k", 8)
    got = sharding.number_slots(df, "k").groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("z")).collect()
    assert sum(r["n"] for r in got) == 30_000 and all((r["d"], r["a"], r["z"]) == (r["n"], 0, r["n"] - 1) for r in got)


def test_op8(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op8_sharding(spark, DIR).collect():
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "key", jump(r["doc_id"], 8), jump(r["doc_id"], 9))
