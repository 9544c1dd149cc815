"""Encoder, token files, packing and attribution against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthpanel.llm import attribution, packing, token_files
from hearthpanel.llm.common import new_folder
from hearthpanel.llm.tokens import encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
# Extra columns clash with names that the operators use inside.
EDGE = "doc_id long, text string, start long, ids string, n string, score string"


def edge_rows():
    texts = ["Two  words\n here", None, "", "word " * 9000, "é" * 30 + " 日本 ́x <|endoftext|>", "same text", "same text", "null id", " \t\n ", "42 apples, 3 l's."]
    ids = [7, 3, 5, 2, 1, 9, 9, None, 11, 4]
    return [(i, t, 1, "x", "y", "z") for i, t in zip(ids, texts)]


def library(name, text):
    return np.array(encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
def test_encoder_is_the_library(name):
    rnd = random.Random(3)
    letters = "aB'sre td  \n\t\r.,é ÀßŒ12½²́İ\xad—“x日😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [r[1] for r in edge_rows()]
    assert encoder(name).encode(pa.array(texts, pa.string())) == [library(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_encoder_forgets_and_relearns(name, monkeypatch):
    monkeypatch.setattr("hearthpanel.llm.tokens.REMEMBERED", 5)
    for text in ["a b c d e f", "g h i j k l", "a b c g h i", "z"]:
        assert encoder(name).encode(pa.array([text])) == [library(name, text)]


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    manifest = token_files.write_tokens(docs, new_folder(spark, "t"), tokenizer=NAMES[0], end_id=0)
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 7, 9, 9, 11]
    texts = {i: t for i, t, *_ in edge_rows()}
    start = 0
    for r in rows:
        assert r.start == start and bytes(r.ids) == library(NAMES[0], texts[r.doc_id]) + b"\0\0\0\0"
        start += len(r.ids) // 4
    for m in manifest.collect():
        only = list(token_files.read_file(m.file, [2, 9, None]))
        assert {r[0] for r in only} <= {2, 9, None}


def test_token_files_damage_is_seen(tmp_path):
    path = tmp_path / "a.zst"
    with path.open("wb") as sink:
        out = token_files.Writer(sink)
        for i in range(3):
            out.add(i, np.arange(20_000, dtype="<u4").tobytes())
        out.close()
    assert [r[0] for r in token_files.read_file(str(path))] == [0, 1, 2] and len(out.frames) == 3
    raw = bytearray(path.read_bytes())
    raw[out.frames[0][0] + 100] ^= 1  # in the second frame: the first stays readable
    path.write_bytes(raw)
    assert len(list(token_files.read_file(str(path), [0]))) == 1
    with pytest.raises(Exception):
        list(token_files.read_file(str(path), [1]))


def test_token_files_empty(spark):
    assert token_files.token_files(spark.createDataFrame([], EDGE)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4095), max_size=60))
def test_windows_hold_every_item_once(sizes):
    found = packing.windows(sizes, 4096)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 4096 for w in found)
    assert len(found) >= -(-sum(sizes) // 4096)


def test_differencing_known_case():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in part) for part in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_packing(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    rows = packing.pack(docs).collect()
    texts = {}
    for i, t, *_ in edge_rows():
        texts.setdefault(i, library(NAMES[1], t) + b"\2\0\0\0")
    for doc, ids in texts.items():
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        copies = 2 if doc == 9 else 1
        assert b"".join(bytes(p.ids) for p in pieces[::copies]) == ids
        assert all(p.doc_tokens == len(ids) // 4 and p.length == len(p.ids) // 4 for p in pieces)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    assert packing.pack(docs.limit(0)).count() == 0


def test_spans_are_the_library_offsets():
    enc = encoder(NAMES[0])
    for text in ["plain text here", "naïve “quoted” 日本語 😀 text", "x"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids = np.frombuffer(enc.encode(pa.array([text]))[0], "<u4")
        start, end = attribution.spans(ids, attribution.byte_lengths(NAMES[0]), data)
        assert list(zip(start.tolist(), end.tolist())) == enc.tokenizer.encode(text, add_special_tokens=False).offsets


def brute(start, end, first, last, rule):
    counts = [0.0] * len(first)
    for a, b in zip(start, end):
        shared = [max(0, min(b, y) - max(a, x)) for x, y in zip(first, last)]
        hit = [k for k, s in enumerate(shared) if s]
        if not hit:
            continue
        if rule == "split":
            for k in hit:
                counts[k] += shared[k] / sum(shared)
        else:
            counts[hit[0] if rule == "first" else max(hit, key=lambda k: (shared[k], -k))] += 1
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_allocation(rule):
    rnd = random.Random(1)
    for _ in range(200):
        cuts = sorted(rnd.sample(range(40), rnd.randint(0, 8)) + [rnd.randint(0, 40)])
        first, last = np.array(cuts[:-1][::2], int), np.array(cuts[1:][::2], int)
        n = min(len(first), len(last))
        edges = sorted(set([0, 40] + rnd.sample(range(1, 40), 12)))
        start, end = np.array(edges[:-1]), np.array(edges[1:])
        counts, _ = attribution.allocate(start, end, first[:n], last[:n], rule)
        assert np.allclose(counts, brute(start, end, first[:n], last[:n], rule))


def test_attribution(spark):
    schema = "doc_id long, text string, sections array<struct<name:string,first:long,last:long>>, tokens string, section string"
    rows = [
        (1, "alpha beta gamma", [("a", 0, 8), ("gap", 8, 8), ("b", 8, 16)], "x", "y"),
        (1, "alpha beta gamma", [("a", 0, 8), ("gap", 8, 8), ("b", 8, 16)], "x", "y"),
        (2, None, None, "x", "y"),
        (None, "", [("e", 0, 0)], "x", "y"),
        (3, "only part counts", [("p", 5, 9)], "x", "y"),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in attribution.attribute(docs).collect()]
    assert [r for r in got if r[0] == 1] == [(1, 0, "a", 2.0, 1, 3), (1, 1, "gap", 0.0, 0, 3), (1, 2, "b", 1.0, 0, 3)] * 2
    assert [r for r in got if r[0] is None] == [(None, 0, "e", 0.0, 0, 0)]
    assert [r[3] for r in got if r[0] == 3] == [1.0] and not [r for r in got if r[0] == 2]
    assert attribution.attribute(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="overlap"):
        attribution.attribute(spark.createDataFrame([(1, "abc", [("a", 0, 2), ("b", 1, 3)], "", "")], schema)).collect()


def test_record_sections_cover_the_record(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "head\nbody é", "s", None), (2, None, None, "de"), (3, "one line", "s", "en")], "doc_id long, text string, source string, lang string")
    text, sections = attribution.record_sections(F.col("source"), F.col("lang"), F.col("text"))
    for r in docs.select(text.alias("t"), sections.alias("s")).collect():
        assert [s.first for s in r.s] == [0] + [s.last for s in r.s][:-1] and r.s[-1].last == len(r.t)


def test_queries_match_the_library(spark):
    from hearthpanel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in sorted(QUERIES["op5_token_files"](spark, sf).collect()):
        ids = library(NAMES[0], texts[r.doc_id]) + b"\0\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    totals = {}
    for r in QUERIES["op7_packing"](spark, sf).collect():
        ids = (library(NAMES[1], texts[r.doc_id]) + b"\2\0\0\0")[4 * r.start : 4 * (r.start + r.length)]
        assert r.ids_crc32 == zlib.crc32(ids)
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.start + r.length
    assert set(totals) == set(texts)
    counted = QUERIES["op2_token_counts"](spark, sf).collect()
    for doc in list(texts)[:50]:
        mine = [r for r in counted if r.doc_id == doc]
        assert len(mine) == 4 and sum(r.tokens for r in mine) == mine[0].doc_tokens
