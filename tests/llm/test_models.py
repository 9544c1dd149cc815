"""Quality field, URL filter, nearest neighbours and language model."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthpanel.llm import hilbert, language_model, quality, url_filter
from hearthpanel.llm.common import table
from hearthpanel.llm.gru import Gru

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_labelings():
    rnd = np.random.default_rng(4)
    row = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, moves = rnd.normal(size=8), rnd.normal(size=(2, 2))
    good, expected, log_z = quality.marginals(score, moves, row)
    want, pairs, total = np.zeros(8), np.zeros((2, 2)), 0.0
    for text in range(3):
        at = np.flatnonzero(row == text)
        weights = {}
        for labels in itertools.product((0, 1), repeat=len(at)):
            weights[labels] = math.exp(sum(score[i] * y for i, y in zip(at, labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        total += math.log(z)
        for labels, w in weights.items():
            want[at] += np.array(labels) * w / z
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += w / z
    assert np.allclose(good, want) and np.allclose(expected, pairs) and abs(log_z - total) < 1e-9


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = quality.classify(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark):
    schema = "doc_id long, text string, score string, label int, lines string"
    good, bad = "A calm line of words goes here.\nAnd then another one follows it.\n", "$$$ ### !!! *** ;;;\n%%% $$$ @@@ ###\n"
    rows = [(i, (good if i % 2 else bad) * (1 + i % 3), "x", 0, "y") for i in range(40)]
    rows += [(100, None, "x", 0, "y"), (101, "", "x", 0, "y"), (102, " \n\n", "x", 0, "y"), (None, good, "x", 0, "y"), (1, good, "x", 0, "y"), (103, "word " * 50_000, "x", 0, "y")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, 0), (8, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.doc_id: r.score for r in got if r.doc_id in (100, 101, 102)}
    assert len(set(empty.values())) == 1
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 40)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    nothing = quality.classify(docs.limit(0), labels.limit(0))
    assert nothing.count() == 0
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.classify(docs, labels.limit(0)).collect())


def by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, name, prefix in url_filter.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
            best = (name + prefix, verdict)
    return host, path, best and best[0], best and best[1]


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://ORG/x", "http://a.org", "http://a.org/", "http://borg/", "x://example.org/en/1", "x://www.example.org/en/2",
        "http://EXAMPLE.org/es/1?q=1&r=2#t", "http://a.com/fr/", "http://a.com/de/x://y", "ftp://com/de/", "http://com?x=/de/", "http://É.com/de/ü", "http://a.com\n/fr/", "http://x.net/" + "a1/" * 5000,
    ]
    rows = [(i, u, "h", "p", 0.0) for i, u in enumerate(urls + urls)] + [(None, urls[5], "h", "p", 0.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label string, score double")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        url = urls[5] if r.page_id is None else (urls + urls)[r.page_id]
        host, path, rule, verdict = by_hand(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_trees_learn_the_labels(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    good = [(f"https://{word(6)}.net/{word(5)}/{word(8)}", 1) for _ in range(150)]
    bad = [(f"http://{word(3)}-{rnd.randrange(10**6)}.net/{rnd.randrange(10**9)}?a={word(3)}&b={rnd.randrange(999)}&c=1", 0) for _ in range(150)]
    data = spark.createDataFrame(good + bad, "url string, label int")
    host, path = url_filter.parts(F.col("url"))
    data = data.withColumns({"host": host, "path": path})
    train, test = data.filter(F.crc32("url") % 3 != 1), data.filter(F.crc32("url") % 3 == 1)
    rates, model = url_filter.fit(train)
    right = model.transform(url_filter._vectors(url_filter.lexical(test), rates)).filter("prediction = label").count()
    assert right >= 0.95 * test.count()
    one, share = url_filter.fit(train.filter("label = 1"))
    assert share == 1.0 and one.count() == 1


def test_url_rates_leave_out_the_fold_of_a_url(spark):
    rnd = random.Random(3)
    rows = [(f"http://{i}.x", rnd.choice("abc"), rnd.randrange(2)) for i in range(60)] + [("http://one.x", "rare", 1), ("http://one.x", None, 1)]
    labelled = spark.createDataFrame(rows, "url string, suffix string, label int")
    folds = {r.url: r.fold for r in labelled.select("url", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(url_filter.FOLDS)).alias("fold")).collect()}
    got = url_filter.out_of_fold(labelled).collect()
    assert sorted(map(str, ((r.url, r.suffix, r.label) for r in got))) == sorted(map(str, rows))
    for r in got:
        others = [label for url, suffix, label in rows if suffix == r.suffix and folds[url] != folds[r.url]]
        if r.suffix is None or len(others) < url_filter.SUFFIX_SUPPORT:
            assert r.suffix_rate is None
        else:
            assert r.suffix_rate == pytest.approx((sum(others) + 1) / (len(others) + 2))


def test_url_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("",), ("aaaa",), ("abcd",)], "t string").select(url_filter._entropy(F.col("t")).alias("e")).collect()
    assert [r.e for r in rows] == [1.0, 0.0, 0.0, 2.0]


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    key = hilbert.hilbert(grid, bits).astype(int)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def test_neighbours_recall_and_distances(spark, monkeypatch):
    """With the least reach below the table's size, windows leave vectors out and blocks are several."""
    monkeypatch.setattr(hilbert, "LEAST", 32)
    monkeypatch.setattr(hilbert, "BLOCK", 256)
    rnd = np.random.default_rng(2)
    data = rnd.normal(size=(2000, 12)).astype(np.float32)
    data[1500:1510] = data[0]
    got = hilbert.neighbours(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]), F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 2000, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        exact = np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(1))
        exact[q] = np.inf
        best = np.lexsort((np.arange(2000), exact))[:10]
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in [r.vec_id for r in mine]
        assert all(abs(exact[r.vec_id] - r.score) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 200
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(1500, 1510))


def test_neighbours_of_many_copies(spark, monkeypatch):
    """Hundreds of equal vectors, more than a window reaches: the smallest ids, for queries inside and near the group."""
    monkeypatch.setattr(hilbert, "LEAST", 32)
    monkeypatch.setattr(hilbert, "BLOCK", 256)
    rnd = np.random.default_rng(6)
    data = rnd.normal(size=(1500, 12)).astype(np.float32)
    data[rnd.permutation(1500)[:600]] = data[0]
    data[900] = data[0] + np.float32(0.01)
    copies = [i for i in range(1500) if (data[i] == data[0]).all()]
    asked = {*copies[::40], 900}
    got = hilbert.neighbours(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]), F.col("vec_id").isin(asked)).collect()
    for q in asked:
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for i in copies if i != q][:10]


def test_neighbours_of_every_length(spark):
    rnd = np.random.default_rng(7)
    data = [(i, rnd.normal(size=(8, 5, 1)[i % 3 if i < 90 else 0]).astype(np.float32)) for i in range(300)]
    got = hilbert.neighbours(vectors(spark, [(i, v.tolist()) for i, v in data]), F.col("vec_id") % 10 == 0).collect()
    for q, mine in data[::10]:
        exact = sorted((np.sqrt(((v.astype(float) - mine.astype(float)) ** 2).sum()), i) for i, v in data if len(v) == len(mine) and i != q)[:10]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in exact]


def test_nearest_keeps_ties_at_the_cut():
    """Different vectors at one distance: the signs of a unit vector in 300 dimensions."""
    block = [(i, 600 - i, (np.eye(300)[i // 2] * (1 - 2 * (i % 2))).tolist()) for i in range(600)]
    found = hilbert.nearest(block, [(300, 1000, [0.0] * 300)], 1000, 10)
    assert [v for _, v, _ in found] == list(range(1, 11))


def test_neighbours_on_the_table(spark):
    from hearthpanel.llm.queries import QUERIES

    rows = table(spark, SF, "embeddings").collect()
    data, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = {(r.query_id, r.vec_id) for r in QUERIES["op9_hilbert_neighbours"](spark, SF).collect()}
    exact = set()
    for q in ids[ids % 100 == 0]:
        distance = ((data - data[ids == q]) ** 2).sum(1)
        distance[ids == q] = np.inf
        exact |= {(q, v) for v in ids[np.lexsort((ids, distance))[:10]]}
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [2.0, 0.0]), (9, [0.0, 0.5]), (9, [0.0, 0.5]), (None, [1.0, 0.1]), (100, None), (200, [1.0, 1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hilbert.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 8, 1.0), (0, 2, 200, 1.0), (0, 3, 9, 1.118034), (200, 1, 0, 1.0), (200, 2, 9, 1.118034), (200, 3, 8, 1.414214)]
    for few in ([], [(0, [1.0])], [(0, None)]):
        assert hilbert.neighbours(vectors(spark, few), F.col("vec_id") % 100 == 0).count() == 0


def small_model(words=70):
    model = Gru(np.arange(words, 0, -1.0), 25.0)
    rnd = np.random.default_rng(0)
    for name, value in model.parameters.items():
        model.parameters[name] = value.astype(float) + rnd.normal(0, 0.1, value.shape) * (name != "word_bias")
    return model


def test_language_model_sums_to_one():
    model = small_model()
    state = np.random.default_rng(1).normal(size=(1, 24)) * 0.5
    logs, _ = model.outputs(np.repeat(state, 71, 0), np.arange(71))
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_language_model_slopes():
    model = small_model()
    rnd = np.random.default_rng(3)
    words, mask = rnd.integers(0, 71, (3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    seen, state = rnd.integers(0, 71, (3, 5)), rnd.normal(size=(3, 24)) * 0.1
    loss = lambda: -model.slopes(state, seen, words, mask)[2] / mask.sum()
    slopes = model.slopes(state, seen, words, mask)[1]
    for name, value in model.parameters.items():
        flat, slope = value.reshape(-1), slopes[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-4 + 1e-3 * abs(slope[i]), name


def test_language_model_carries_its_state():
    model = small_model()
    rnd = np.random.default_rng(5)
    sizes = [1, 200, 64, 65, 3]
    words, bounds = rnd.integers(0, 71, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    got = model.score(words, bounds, 0)
    for i in range(len(sizes)):
        state, total, before = np.zeros((1, 24)), 0.0, 0
        for w in words[bounds[i] : bounds[i + 1]]:
            state = model.step(state, np.array([before]))[0]
            total += model.outputs(state, np.array([w]))[0][0]
            before = w
        assert abs(total - got[i]) < 1e-3 * abs(total)


def base_by_hand(rows, folds=5):
    tokens = {}
    counts = Counter()
    for doc, text in rows:
        lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        tokens[doc] = re.findall(rb"[^\x20\x09-\x0D]+", lower) + [b" end"]
        if doc is None or zlib.crc32(str(doc).encode()) % folds != 1:
            counts.update(tokens[doc])
    n, v = sum(counts.values()), len(counts)
    return {d: (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in tokens.items()}


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD", 2000)  # most words are joined
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = base_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    rows = language_model.score_documents(docs).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    schema = "doc_id long, text string, n long, token string, key string, score string"
    rows = [(1, "a b A b", 0, "", "", ""), (1, "a b A b", 0, "", "", ""), (2, None, 0, "", "", ""), (3, "", 0, "", "", ""), (None, "b c", 0, "", "", ""), (4, "word " * 30_000, 0, "", "", ""), (5, " \n", 0, "", "", "")]
    got = language_model.score_documents(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 5)} == {1} and [r.held_out for r in got if r.doc_id is None] == [False]
    assert language_model.score_documents(spark.createDataFrame([], schema)).count() == 0
    only = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = language_model.score_documents(spark.createDataFrame([(only, "a b", 0, "", "", "")], schema)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (3, 0, 0) and abs(alone.base_score) < 1e-9 and math.isfinite(alone.score)


def test_language_model_learns_from_whole_texts(spark):
    """One long training text: what it repeats is learned only by reading on behind its first words."""
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    learned = next(i for i in range(50) if i not in held)
    rows = [(learned, "alpha beta gamma delta " * 3000), (held[0], "alpha beta gamma delta " * 50)]
    got = {r.doc_id: r for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base, score = got[held[0]].base_score / 201, got[held[0]].score / 201
    assert base < -0.55 and score > -0.2


def test_language_model_trains_on_every_word_once():
    rnd = np.random.default_rng(8)
    documents = [rnd.integers(0, 70, n) for n in (300, 1, 64, 65, 33, 2, 0, 90) * 9]
    model = small_model()
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    want = model.score(np.concatenate(documents), bounds, 0).sum()
    total, count = model.train(documents, 0, 0.0)  # without steps, the loss is that of whole texts
    assert count == bounds[-1] and abs(total - want) < 1e-3 * abs(want)


def test_language_model_slopes_end_where_a_document_begins():
    model = small_model()
    rnd = np.random.default_rng(3)
    words, seen, state = rnd.integers(0, 71, (2, 6)), rnd.integers(0, 71, (2, 6)), rnd.normal(size=(2, 24)) * 0.1
    mask, begins = np.ones((2, 6), bool), np.array([[0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 1, 1]], bool)
    loss = lambda: -model.slopes(state, seen, words, mask, begins)[2] / mask.sum()
    slopes = model.slopes(state, seen, words, mask, begins)[1]
    for name in ("inputs", "turn"):
        flat, slope = model.parameters[name].reshape(-1), slopes[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-4 + 1e-3 * abs(slope[i]), name


def test_language_model_takes_large_weights():
    """Chances whose logits leave the range of an exponential."""
    model = small_model()
    model.parameters["to_class"] *= 1000
    model.parameters["to_word"] *= 1000
    states = np.sign(np.random.default_rng(1).normal(size=(3, 24)))
    for state in states:
        logs, _ = model.outputs(np.repeat(state[None], 71, 0), np.arange(71))
        assert np.isfinite(logs).all() and abs(np.exp(logs).sum() - 1) < 1e-5


def test_language_model_reuses_its_arrays():
    """Windows of training and blocks of scoring work in arrays that are kept, which is most of their speed."""
    rnd = np.random.default_rng(9)
    model = Gru(np.arange(1024, 0, -1.0), 500.0)
    documents = [rnd.integers(0, 1025, 200) for _ in range(2000)]
    words, bounds = np.concatenate(documents), np.arange(2001) * 200
    model.train(documents, 0, 0.01)
    for work in (lambda: model.train(documents, 0, 0.01), lambda: model.score(words, bounds, 0)):
        work()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 9 << 20, peak


def test_vocabulary_finds_what_a_search_finds():
    rnd = np.random.default_rng(10)
    near = (np.uint64(7) << np.uint64(50)) + rnd.integers(0, 300, 200).astype(np.uint64)  # these share their leading bits
    name = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), near, [language_model.END, np.uint64(0), ~np.uint64(0)]]))
    rnd.shuffle(name)
    count = np.sort(rnd.integers(1, 1000, len(name)))[::-1]
    vocabulary = language_model.Vocabulary(name, count)
    asked = np.concatenate([name, name + np.uint64(1), near, rnd.integers(0, 1 << 63, 1000).astype(np.uint64)])
    ids, counts, held = vocabulary.find(asked)
    want = dict(zip(name.tolist(), count.tolist()))
    assert counts.tolist() == [want.get(x, 0) for x in asked.tolist()] and held.tolist() == [x in want for x in asked.tolist()]
    assert (ids < vocabulary.size).sum() == np.isin(asked, vocabulary.name[vocabulary.ids < vocabulary.size]).sum()
    assert vocabulary._places(asked).tolist() == np.searchsorted(vocabulary.name, asked).tolist()
