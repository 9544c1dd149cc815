"""Jaccard join, suffix dedup, components and decontamination against brute force."""

import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from hearthpanel.llm import decontaminate, jaccard, suffixes
from hearthpanel.llm.components import components

# Extra columns clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, n long, k1 string, tile long, name string, whole string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", 2, "b", "c", 3) for i, t in rows], SCHEMA)


def corpus(seed):
    """Random texts with near copies, exact copies, shared passages, short, empty and null ones."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = make(60)
    texts = []
    for _ in range(25):
        base = make(rnd.randint(5, 120))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            near = list(base)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append(" ".join(near))
    texts += [" ".join(make(30) + passage + make(30)) for _ in range(8)]
    texts += ["one two", "One  TWO", "one", "", None, " \n ", "É é É é É", "a" * 300, "a" * 200, "ab" * 100, "x y z", "x y z"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def linked(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    degree, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {rows[i][0]: (len(sets[i]), degree[i], rows[root(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [1 << 20, 3000])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: tiles of several
    rows = corpus(n)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard.jaccard_join(frame(spark, rows), n=n, percent=percent).collect()}
    assert got == linked(rows, n, percent)


def test_jaccard_edges(spark):
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "a b c d"), (5, "e f g h"), (5, "a b c d")]
    got = sorted((tuple(r) for r in jaccard.jaccard_join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 1, None, 0), (4, 1, 4, 3), (4, 1, 4, 3), (9, 1, 4, 3), (5, 1, 5, 0), (5, 1, 4, 3)], key=str)


def test_links_drop_pairs_below_their_bound():
    import numpy as np

    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(60, 160), np.arange(0, 40)]
    block = [(i, 0, 1, s.astype(np.uint64), np.array([7])) for i, s in enumerate(sets)]
    assert sorted(jaccard.links(block, 7, 0, 0, 85)) == [(0, 0, 1), (1, 0, 1)]
    # A pair that shares an earlier tile is joined here too but counted there.
    block = [(i, 0, 1, s.astype(np.uint64), np.array([3, 7])) for i, s in enumerate(sets)]
    assert sorted(jaccard.links(block, 7, 0, 0, 85)) == [(0, 0, 0), (1, 0, 0)]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3), (8, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def removed(rows, length=50):
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            least[raw[s : s + length]] = min(doc, least.get(raw[s : s + length], doc))
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if least[raw[s : s + length]] < doc:
                gone[s : s + length] = b"\1" * length
        spans = re.findall(rb"\x01+", bytes(gone))
        out[doc] = (len(raw), sum(gone), len(spans), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    rnd = random.Random(seed)
    passage = "".join(rnd.choice("abcdefg é") for _ in range(90))
    for k in range(12):  # stretches of one passage from one byte short of the length up, at any offset
        a = rnd.randrange(40)
        rows.append((1000 + k, "".join(rnd.choice("xyz") for _ in range(rnd.randrange(30))) + passage[a : a + rnd.choice([48, 49, 50, 51, 60])] + "!" * k))
    rows += [(2000, "ab" * 60), (2001, "b" + "ab" * 60), (2002, "z" * 49), (2003, "z" * 49), (2004, "é" * 60), (2005, "ü" + "é" * 40)]
    got = suffixes.repeated_spans(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)


def test_suffix_edges(spark):
    assert suffixes.repeated_spans(frame(spark, [])).count() == 0
    long = "the quick brown fox jumps over the lazy dog and then it sleeps well"
    rows = [(None, long), (7, long), (7, long), (7, long + " again"), (8, long), (9, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.repeated_spans(frame(spark, rows)).collect())
    n = len(long)
    assert got == sorted([("None", n, 0), ("7", n, 0), ("7", n, 0), ("7", n + 6, 0), ("8", n, n), ("9", 0, 0)])


def test_texts_without_spans(spark):
    long = "é" * 40 + " and a tail of its own"
    docs = frame(spark, [(1, "é" * 40), (2, "é" + long), (3, None), (4, "é" * 40)])
    out = suffixes.without_spans(docs, suffixes.repeated_spans(docs))
    assert out.schema == docs.schema
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: "é" * 40, 2: " and a tail of its own", 3: None, 4: ""}


ITEM = "On Monday the farmer Harold drove 120 km to market and sold 45 kg of apples while young Harold waited for 120 minutes near the gate"


def leak_rows(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, item_id long, hash string, raw string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}


def test_leaks(spark):
    filler = "some words before it that are of no use at all, "
    changed = ITEM.replace("120", "75").replace("45", "9").replace("Harold", "Quentin")
    torn = ITEM.replace("120 km", "75 km").replace("45", "9")  # 120 has two values now
    texts = [filler + ITEM + filler, filler + changed + ".", torn, " ".join(ITEM.split()[8:15]), None, "", filler * 400 + ITEM.upper().lower(), ITEM + " " + ITEM]
    found = leak_rows(spark, texts)
    assert set(found) == {(0, 0), (1, 0), (6, 0), (7, 0)}  # not the torn one, whose number has two values, nor the short quote
    assert found[0, 0].kind == "verbatim" and found[0, 0].coverage > 0.9
    assert found[1, 0].kind == "reparameterised" and found[1, 0].n_changed >= 3


def test_leak_edges(spark):
    assert not leak_rows(spark, [])
    assert not leak_rows(spark, ["anything at all"], items=())
    assert not leak_rows(spark, [ITEM], items=("too short an item", None, ""))
    slots = "1 2 3 4 5 6 7 8 9 10 11 12"
    assert not leak_rows(spark, ["9 8 7 6 5 4 3 2 1 0 1 2"], items=(slots,))  # placeholders alone are no evidence


def test_leaks_at_every_alignment(spark):
    item = "a calm river runs along two green hills towards an old stone bridge downtown"
    words = item.split()
    words[6], words[13] = "brown", "uptown"  # the equal windows begin at one word, or seven words on
    texts = ["so " * k + " ".join(words) for k in range(7)]
    found = leak_rows(spark, texts, items=(item,))
    assert set(found) == {(k, 0) for k in range(7)}


def test_leaks_of_short_and_slot_heavy_items(spark):
    short, heavy, digits = "which planet has the most moons", "What is 12 * 34 + 56 - 78 * 90?", "1 2 3 4 5 6 7 8"
    texts = ["so. " * k + t for t in (short, heavy, "What is 21 * 43 + 65 - 87 * 9?", digits, "8 7 6 5 4 3 2 1") for k in range(3)]
    found = leak_rows(spark, texts, items=(short, heavy, digits))
    assert {k: r.kind for k, r in found.items()} == {
        **{(k, 0): "verbatim" for k in (0, 1, 2)}, **{(k, 1): "verbatim" for k in (3, 4, 5)},
        **{(k, 1): "reparameterised" for k in (6, 7, 8)}, **{(k, 2): "verbatim" for k in (9, 10, 11)},
    }


def test_leaks_with_names_at_sentence_starts(spark):
    item = "Tom has 5 red apples. Sam has 7 green apples."
    story = "The old farmer walked to the market with two baskets. The young baker bought some of his ripe plums."
    texts = [
        "Bob has 5 red apples. Ann has 7 green apples.", 'She said: "Bob has 6 red apples.\nAnn has 8 green apples."', "12 Bob has 5 red apples (Ann has 7 green apples)",
        item.lower(), "Then, Bob has 5 red apples; Ann has 7 green apples.", "Kim has 5 blue chairs. Kim has 7 wooden tables.",
        story.replace("The old", "An old").replace("The young", "One young"),
    ]
    found = leak_rows(spark, texts, items=(item, story))
    assert {k: r.kind for k, r in found.items()} == {(0, 0): "reparameterised", (1, 0): "reparameterised", (2, 0): "reparameterised", (3, 0): "verbatim", (4, 0): "reparameterised", (6, 1): "verbatim"}
    assert found[0, 0].coverage == 1.0 and found[0, 0].n_changed == 2


def test_leaks_are_native_and_complete(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.leaks(docs, bench)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    flat = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in flat(r.text)}
    assert whole and {(r.doc_id, r.item_id) for r in found.collect()} == whole


def test_windows_meet_where_templates_do(spark):
    """Window hashes of a document against those of templates made word by word in Python."""
    rnd = random.Random(8)
    units, vocabulary = ["km", "Kg", "hours"], ["red", "Étude", "Anna", "bob", "McKay", "NASA", "e\u0301cole", "x\ue000y", "km", "Ü", "ǅemal"]
    pieces = lambda: rnd.choice([rnd.choice(vocabulary), str(rnd.randrange(99)), f"{rnd.randrange(9)} {rnd.choice(units)}", "1,5", "a. Bob"])
    texts = [rnd.choice([" ", ", ", "\n"]).join(pieces() for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + ["", "a b c d e", "a b c d e f"]

    def tokens(text):
        found = regex.findall(r"\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,][0-9]+)*", text.replace("\ue000", "").replace("\ue001", ""))
        typed = []
        for i, w in enumerate(found):
            if w[0].isdigit():
                typed.append("#number")
            elif i and found[i - 1][0].isdigit() and w.lower() in decontaminate.UNITS:
                typed.append("#unit")
            else:
                typed.append("#name" if regex.match(r"\p{Lu}\p{Ll}", w) else w.lower())
        return typed, [w.lower() for w in found]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.place, r.hash) for r in decontaminate.windows(docs).collect()}
    want = set()
    for doc, text in enumerate(texts):
        typed, bare = tokens(text)
        for i in range(len(typed) - decontaminate.WINDOW + 1):
            window = typed[i : i + decontaminate.WINDOW]
            want.add((doc, i + 1, tuple(window)))
            if sum(w[0] != "#" for w in window) < decontaminate.PLAIN:
                want.add((doc, i + 1, tuple(bare[i : i + decontaminate.WINDOW])))
    rows = spark.createDataFrame([(d, p, list(w)) for d, p, w in want], "doc_id long, place int, w array<string>")
    assert got == {(r.doc_id, r.place, r.hash) for r in rows.select("doc_id", "place", decontaminate._key(F.col("w")).alias("hash")).collect()}
    raw = docs.select("doc_id", decontaminate.words(F.col("text")).alias("raw"))
    made = {r.doc_id: r.canon for r in raw.select("doc_id", decontaminate.template(F.col("raw")).alias("canon")).collect()}
    assert made == {doc: tokens(text)[0] for doc, text in enumerate(texts)}
