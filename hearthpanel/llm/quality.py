"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import chunks, flat_bytes
from hearthpanel.llm.textbytes import LOWER, SPACE, Hashes, words

#: At most so many labelled documents train the field, chosen by a hash of their id ...
SAMPLE = 4000
#: ... among those of at most so many bytes; longer ones are scored, not trained on.
SAMPLE_BYTES = 200_000
STEPS = 200
RATE = 0.1
L2 = 1e-3
L2_MOVES = 1e-2

CLASSES = np.zeros(256, np.int64)  # 0: other control bytes
for i, these in enumerate((b"abcdefghijklmnopqrstuvwxyz", bytes(range(65, 91)), b"0123456789", b" \t", b".,;:", b"!?", b"'\"()-", b"#$%&*@^~", b"|<>{}[]\\/_=+`", bytes(range(0x80, 0x100)))):
    CLASSES[list(these)] = i + 1
N_CLASSES = 11


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word in it, its row, and its length in bytes.

    Shares of character classes, lengths, words that repeat the one before, and
    lines seen before in the same text; then the same of the line before and
    of the line after.
    """
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([[0], ends + 1, offsets[:-1], [len(data)]]))
    begin, end = cuts[:-1], cuts[1:]
    row = np.searchsorted(offsets, begin, side="right") - 1
    n = len(begin)
    size = end - begin
    counts = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    starts, stops, _ = words(data, np.append(begin, len(data)))
    line = np.searchsorted(begin, starts, side="right") - 1
    n_words = np.bincount(line, minlength=n)
    hashes = Hashes(LOWER[data])
    word = hashes.of(starts, stops)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, minlength=n)
    long = np.bincount(line, stops - starts > 25, minlength=n)
    stop = np.where((size > 0) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end)
    text = hashes.of(begin, stop)
    key = np.lexsort((begin, text, row))
    seen = np.zeros(n, bool)
    same = (text[key][1:] == text[key][:-1]) & (row[key][1:] == row[key][:-1])
    seen[key[1:][same]] = True
    keep = n_words > 0
    w = np.maximum(n_words, 1)
    visible = np.maximum(size - counts[:, 4], 1)[:, None]
    features = np.column_stack([counts[:, 1:] / visible, counts[:, 6:10] / w[:, None], np.log1p(size), np.log1p(n_words), size / w, repeats / w, long / w, seen])[keep]
    row, size = row[keep], size[keep]
    before, after = np.zeros_like(features), np.zeros_like(features)
    joined = row[1:] == row[:-1]
    before[1:][joined] = features[:-1][joined]
    after[:-1][joined] = features[1:][joined]
    edges = np.column_stack([np.append(False, joined), np.append(joined, False)]) if len(row) else np.zeros((0, 2))
    return np.column_stack([features, before, after, edges]), row, size


def _layout(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of every text that has lines, those with most lines first."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(row)))
    order = np.argsort(-count, kind="stable")
    return first[order], count[order]


def marginals(score: np.ndarray, moves: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts at once: P(line is good), expected moves, sum of log partition functions.

    ``score`` is the log potential of a good line against a bad one; ``moves``
    holds the log potentials from bad and good (rows) to bad and good.
    """
    n = len(score)
    first, count = _layout(row)
    forward, back = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more than t lines
    forward[first, 1] = score[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        step = forward[at - 1]
        forward[at] = np.logaddexp(step[:, :1] + moves[0], step[:, 1:] + moves[1])
        forward[at, 1] += score[at]
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        to = back[at + 1].copy()
        to[:, 1] += score[at + 1]
        back[at] = np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:])
    last = first + count - 1
    total = np.logaddexp(forward[last, 0], forward[last, 1])
    per_line = np.zeros(n)
    per_line[first] = 1
    text = np.cumsum(per_line).astype(np.int64) - 1
    log_z = np.zeros(len(first))
    log_z[text[first]] = total
    good = np.exp(forward[:, 1] + back[:, 1] - log_z[text])
    pair = np.flatnonzero(row[1:] == row[:-1])
    to = back[pair + 1].copy()
    to[:, 1] += score[pair + 1]
    expected = np.exp(forward[pair][:, :, None] + moves + to[:, None, :] - log_z[text[pair]][:, None, None]).sum(0)
    return np.clip(good, 0, 1), expected, float(total.sum())


class Field:
    """The fitted field: standardised features, weights, moves, and the share of good documents."""

    def __init__(self, features: np.ndarray, row: np.ndarray, label: np.ndarray, prior: float):
        """``label`` has the document's label for each line: lines of a document share it, their neighbours tell them apart."""
        self.prior = prior
        self.mean = features.mean(0) if len(features) else np.zeros(features.shape[1])
        self.scale = features.std(0) + 1e-6 if len(features) else np.ones(features.shape[1])
        x = self._standard(features)
        self.weights, self.moves = np.zeros(x.shape[1]), np.zeros((2, 2))
        pair = row[1:] == row[:-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[:-1][pair], label[1:][pair]), 1)
        m = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for step in range(1, STEPS + 1 if len(x) else 1):
            good, expected, _ = marginals(x @ self.weights, self.moves, row)
            slopes = [x.T @ (label - good) / len(x) - L2 * self.weights, (seen - expected) / len(x) - L2_MOVES * self.moves]
            for k, (target, slope) in enumerate(zip((self.weights, self.moves), slopes)):
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.99 * v[k] + 0.01 * slope**2
                target += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def _standard(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((features - self.mean) / self.scale, -8, 8), np.ones(len(features))])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Marginals of the lines of each text, averaged by length; a text without words gets the share of good documents."""
        features, row, size = line_features(data, offsets)
        good, _, _ = marginals(self._standard(features) @ self.weights, self.moves, row)
        n = len(offsets) - 1
        weight = np.bincount(row, size, minlength=n)
        total = np.bincount(row, size * good, minlength=n)
        return np.where(weight > 0, total / np.maximum(weight, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit on a bounded sample of labelled documents; null labels, ids and repeated ids with two labels are no examples."""
    clean = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    clean = clean.filter("quality = other").select("doc_id", "quality")
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").filter(F.octet_length("text") <= sample_bytes).join(chosen, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            features, row, _ = line_features(*flat_bytes(piece.column("text")))
            first, count = _layout(row)
            label, ids = piece.column("quality").to_numpy(zero_copy_only=False), piece.column("doc_id").to_numpy(zero_copy_only=False)
            rows = [features[a : a + c].astype(np.float32).tobytes() for a, c in zip(first, count)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[first]], pa.int64()), pa.array(label[row[first]], pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "quality", "lines"])

    width = line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].shape[1]
    got = known.mapInArrow(read, "doc_id long, quality int, lines binary").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    parts = [np.frombuffer(b, np.float32).reshape(-1, width) for b in got.lines]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    label = got.quality.to_numpy(np.int64)
    features = np.concatenate(parts).astype(float) if parts else np.zeros((0, width))
    return Field(features, row, label[row] if len(parts) else row, float(label.mean()) if len(label) else 0.5)


def held_out(doc_id: Column, parts: int) -> Column:
    """Documents no model learns from: crc32 of the id as text leaves 1. A null id is never learned from either, but not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 1, F.lit(False))


def score_documents(docs: DataFrame, field: Field, *, keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id) of every document, and its score from 0 to 1 under the name ``score``.

    One narrow pass over whole texts. Null and empty texts, and those of white
    space only, get the share of good documents; every row, repeated or with a
    null id, gets its own score; an empty table gives none.
    """
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            scores = field.score(*flat_bytes(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(scores)], [*keep, score])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Fit on the labels of documents that are not held out, and score all documents."""
    field = fit(docs, labels.filter(~held_out(F.col("doc_id"), folds)))
    scored = score_documents(docs, field, keep=keep)
    return scored.withColumns({"held_out": held_out(F.col("doc_id"), folds), "predicted": (F.col("score") >= 0.5).cast("int")})
