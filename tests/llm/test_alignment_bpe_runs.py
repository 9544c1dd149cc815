"""Alignment, merge-free BPE and periodic runs against plain models and the tokenizer libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthpanel.llm import alignment, bpe, queries, runs
from hearthpanel.llm.common import store, table

SF = "/root/testdata/sf0.001"
BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Extra columns clash with names that the operators use inside.
EDGE = "doc_id long, text string, ids string, runs string, links string, row_number string, pair_count string, start long"
LETTERS = "aB'sre td  \n\t\r.,é ÀßŒ12½²́İ\xad—“x日😀▁"


def edge_rows():
    texts = ["Two  words\n here", None, "", "word " * 3000, "é" * 30 + " 日本 ́x <|endoftext|>", "same text", "same text", "null id", " \t\n ", "a ▁ b", "x\0y", "ab " * 40]
    ids = [7, 3, 5, 2, 1, 9, 9, None, 11, 4, 12, 13]
    return [(i, t, "x", "y", "z", "r", "p", 1) for i, t in zip(ids, texts)]


def noise(n, seed=3, size=50):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    return [(i, t) for i, t in rows if len(t) < 3000]


# --- BPE -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(BYTE))


def test_coder_is_the_library(library):
    rnd = random.Random(5)
    names = [t.replace("Ġ", " ") for t in list(library.get_vocab())[:20000]]
    texts = noise(800) + ["".join(rnd.choice(names) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    texts += ["a" * 5000, "=" * 3000 + " " * 777 + "x", "\n" * 333, "x<|endoftext|> y<|endoftext|><|endoftext|>  <|endof", "<|endoftext|>", "", None]
    ids, at = bpe.coder(BYTE).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert bpe.texts_of(*bpe.coder(BYTE).decode(ids, at)).to_pylist() == [t or "" for t in texts]


def test_decode_of_any_ids(library):
    ids = np.random.default_rng(1).integers(0, 50_257, 4000).astype("<u4")
    at = np.arange(0, 4001, 8)
    found = bpe.texts_of(*bpe.coder(BYTE).decode(ids, at)).to_pylist()
    assert found == [library.decode(ids[a : a + 8].tolist(), skip_special_tokens=False) for a in at[:-1]]
    assert bpe.texts_of(*bpe.coder(BYTE).decode(np.array([64, 60_000, 65], "<u4"), np.array([0, 3]))).to_pylist() == ["ab"]


def test_pair_table_is_bpe(library):
    """A border is compatible exactly if the two tokens' text is encoded as the two tokens."""
    coder, rnd = bpe.coder(BYTE), random.Random(9)
    names = [i for t, i in library.get_vocab().items() if re.fullmatch("[a-z]+", t)]
    for _ in range(4000):
        a, b = rnd.choice(names), rnd.choice(names)
        text = library.id_to_token(a) + library.id_to_token(b)
        assert coder.compatible(a, b) == (library.encode(text, add_special_tokens=False).ids == [a, b])


def test_pair_table_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "PAIRS", 3)
    text = "unforeseeable reparameterisation of antidisestablishmentarianism"
    assert bpe.Coder(BYTE).encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, library):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    found = sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in bpe.code(docs).collect())
    ids = [np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes() for r in edge_rows()]
    assert found == sorted((r[0] or 0, i, r[1] or "") for r, i in zip(edge_rows(), ids))
    assert bpe.code(docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.op12_bpe(spark, SF).collect():
        raw = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert r.n_tokens == len(raw) and r.ids_sha256 == hashlib.sha256(raw.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- alignment ---------------------------------------------------------------


class Model:
    """Groups and links by comparing all pairs of tokens of a text."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path(BYTE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE))
        self.letters = bpe.byte_letters()

    def tokens(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        same = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        return (a, b, np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])) if same else None

    def align(self, text, kind="end"):
        if not text or not (found := self.tokens(text)):
            return 0, 0, 0, "", {}
        a, b, ends_a, ends_b = found
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        sides = [([], []) for _ in cuts]
        for i, g in zip(a, group_a):
            sides[g][0].append(str(i))
        for i, g in zip(b, group_b):
            sides[g][1].append(str(i))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in sides]
        links = {}
        starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
        for i in range(len(a)):
            if kind == "end":
                hits = ends_b == ends_a[i]
            elif kind == "group":
                hits = group_b == group_a[i]
            else:
                hits = (starts_b < ends_a[i]) & (ends_b > starts_a[i])
            for j in np.flatnonzero(hits):
                links[a[i], b[j]] = links.get((a[i], b[j]), 0) + 1
        return len(a), len(b), len(cuts), ";".join(groups), links


def test_product_is_the_matrix_product(monkeypatch):
    rng = np.random.default_rng(4)
    for block in (1, 7, 1 << 21):
        monkeypatch.setattr(alignment, "BLOCK", block)
        for _ in range(30):
            m, k, n = rng.integers(1, 9, 3)
            x, y = (rng.random((m, k)) < 0.4) * rng.integers(1, 5, (m, k)), (rng.random((k, n)) < 0.4) * rng.integers(1, 5, (k, n))

            def sparse(d):
                return alignment.Csr(np.append(0, np.cumsum((d > 0).sum(1))), np.nonzero(d)[1], d[d > 0], d.shape[1])

            found = alignment.product(sparse(x), sparse(y))
            dense = np.zeros((m, n), np.int64)
            dense[found.rows(), found.columns] = found.values
            assert (dense == x @ y).all() and found.width == n
            again = sparse(x).transposed()
            dense = np.zeros((k, m), np.int64)
            dense[again.rows(), again.columns] = again.values
            assert (dense == x.T).all()


@pytest.mark.parametrize("kind", ["end", "overlap", "group"])
def test_alignment_is_the_model(spark, kind):
    model = Model()
    texts = noise(500) + [r[1] for r in edge_rows()] + [t for _, t in documents(spark)][:60]
    texts += [" lead", "trail ", "\n", "<s> hi </s><unk>", "<0x0A>", "a" * 300]
    aligner = alignment.Aligner(BYTE, PIECE, kind)
    for text, r in zip(texts, aligner.batch(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())).to_pylist()):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups"], {(x["a"], x["b"]): x["n"] for x in r["links"]}) == model.align(text, kind)


def test_overlap_counts_bytes():
    found = alignment.link(np.array([2, 3, 1]), np.array([1, 3, 2]), "overlap")
    assert found.links.values.tolist() == [1, 1, 2, 1, 1] and found.group_a.tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        alignment.link(np.array([1]), np.array([1]), "other")


@pytest.mark.parametrize("kind", ["end", "group"])
def test_alignment_counts(spark, kind):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    aligned = store(alignment.align(docs, kind=kind), "aligned")
    found = [(r.doc_id, r.n_a, r.n_links, r.n_best, r.count_sum) for r in alignment.with_link_counts(aligned, kind=kind).collect()]
    model = Model()
    each = [(r[0], model.align(r[1], kind)) for r in edge_rows()]
    counts, best = {}, {}
    for _, m in each:
        for pair, n in m[4].items():
            counts[pair] = counts.get(pair, 0) + n
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = [(i, m[0], sum(m[4].values()), sum(n for p, n in m[4].items() if counts[p] == best[p[1]]), sum(n * counts[p] for p, n in m[4].items())) for i, m in each]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert alignment.with_link_counts(aligned.limit(0), kind=kind).count() == 0


def test_alignment_query(spark):
    model = Model()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    each = {i: model.align(t) for i, t in texts.items()}
    counts, best = {}, {}
    for m in each.values():
        for pair, n in m[4].items():
            counts[pair] = counts.get(pair, 0) + n
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = queries.op11_alignment(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_a, n_b, n_groups, groups, links = each[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, sum(links.values()))
        assert r.n_best == sum(n for p, n in links.items() if counts[p] == best[p[1]])
        assert r.count_sum == sum(n * counts[p] for p, n in links.items())
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


def test_link_counts_are_bounded():
    """Links of the kind "end" pair an entry with a suffix: as many pairs as the docstring says."""
    aligner = alignment.Aligner(BYTE, PIECE, "end")

    def entries(t):
        return [t.table[t.at[i] : t.at[i + 1]].tobytes() for i in range(len(t.sizes))]

    a, b = entries(aligner.bytes_a), entries(aligner.b)
    in_a, in_b = {x for x in a if x}, {}
    for x in b:
        in_b[x] = in_b.get(x, 0) + 1
    pairs = sum(in_b.get(x[k:], 0) for x in in_a for k in range(len(x))) + sum(x[k:] in in_a for x in b for k in range(1, len(x)))
    assert pairs < 500_000


# --- runs ----------------------------------------------------------------------


def all_runs(words, least=24, power=3):
    n, found, codes = len(words), {}, np.unique(words, return_inverse=True)[1] if words else np.zeros(0)
    for p in range(1, n // power + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], codes[p:] == codes[:-p], [False]]).astype(int)))
        for i, j in zip(same[::2].tolist(), same[1::2].tolist()):
            if j + p - i >= max(least, power * p):
                found.setdefault((i, j + p - i), p)
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(doc, text, least=24, power=3, share=10):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if share and h % share == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, least, power)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return n, found, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def repetitive(n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        letters = rnd.choice(["a", "ab", "abc", "abcdefghij"])
        words = [rnd.choice(letters) for _ in range(rnd.randint(0, 100))]
        for _ in range(rnd.randint(0, 3)):
            unit = [rnd.choice(letters) for _ in range(rnd.randint(1, 9))]
            at = rnd.randint(0, len(words))
            words[at:at] = unit * rnd.randint(2, 15) + unit[: rnd.randint(0, len(unit))]
        rows.append((k, rnd.choice([" ", "\n\t ", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("least", "power"), [(24, 3), (4, 2), (1, 2), (30, 5)])
def test_runs_are_all_runs(least, power):
    rows = repetitive(600, least) + [(None, None), (5, ""), (7, "  "), (8, "x " * 900), (9, " é ü" * 40)]
    batch = runs._collapsed(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), least, power, 10)
    for (doc, text), r in zip(rows, batch.to_pylist()):
        assert (r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]) == collapsed(doc, text, least, power)


def test_suffix_array():
    rnd = random.Random(8)
    for _ in range(200):
        symbols = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(0, 40))] + [99])
        found = runs.suffix_array(symbols)
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        assert found.order.tolist() == want and found.place[found.order].tolist() == list(range(len(symbols)))
        for k in range(1, len(want)):
            a, b = symbols[want[k - 1] :], symbols[want[k] :]
            shared = 0
            while a[shared] == b[shared]:
                shared += 1
            assert found.lcp[k] == shared


def test_smaller_before():
    rng = np.random.default_rng(2)
    for values in [rng.integers(0, 5, 60), np.arange(300), np.arange(300)[::-1], np.append(np.arange(300), 0), np.zeros(50, int)]:
        for equal in (False, True):
            want = [max((j for j in range(i) if values[j] < values[i] or (equal and values[j] == values[i])), default=-1) for i in range(len(values))]
            assert runs.smaller_before(values, equal=equal).tolist() == want


def test_runs_query(spark):
    docs = spark.createDataFrame(edge_rows(), EDGE)
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse(docs).collect()), key=str)
    assert found == sorted(((r[0], *collapsed(r[0], r[1], share=None)) for r in edge_rows()), key=str)
    assert runs.collapse(docs.limit(0)).count() == 0
    assert runs.collapse(docs).rdd.getNumPartitions() == docs.rdd.getNumPartitions()  # nothing is shuffled
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in queries.op13_periodic_runs(spark, SF).filter(F.col("doc_id") < 150).collect():
        _, all_, text = collapsed(r.doc_id, texts[r.doc_id])
        assert r.n_runs == len(all_)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in all_).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if not all_:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
        else:
            s, n, p = max(all_, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, p, 1000 * n // p)
