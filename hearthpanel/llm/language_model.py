"""Scores of whole documents by a unigram base and a gated recurrent language model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import chunks, flat_bytes, mixed, store
from hearthpanel.llm.gru import Gru
from hearthpanel.llm.quality import held_out
from hearthpanel.llm.textbytes import LOWER, Hashes, words

#: Words that the recurrent model tells apart, the end of a document included; all others share one class.
WORDS = 1024
#: Most frequent words whose counts every task holds; those of the others are joined.
HELD = 65_536
#: Models that are trained side by side and averaged after each round: one for so many documents, and so many at most.
DOCUMENTS = 2000
WORKERS = 96
ROUNDS = 2
#: Bytes of text that a task scores at a time; the more documents move side by side, the fewer steps it takes.
PIECE = 12 << 20
#: Bytes of word ids, two for each, whose documents train side by side.
TRAIN_PIECE = 4 << 20
#: Bytes of text that are cut into words at a time.
WORDS_PIECE = 1 << 20
#: Names are looked up by their bits from this one on.
LEADING = np.uint64(46)
#: Name of the end of a document among the hashes of words.
END = np.uint64(0x0123456789ABCDEF)


def tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of every text's words in lower case (A-Z) and of its end, and where each text's begin."""
    parts = [_tokens(part.column("text")) for part in chunks([piece], limit=WORDS_PIECE)]
    sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
    return np.concatenate([name for name, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_bytes(column)
    starts, ends, row = words(data, offsets)
    name = mixed(Hashes(LOWER[data]).of(starts, ends))
    count = np.bincount(row, minlength=len(offsets) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.full(bounds[-1], END, np.uint64)
    out[np.arange(len(name)) + row] = name
    return out, bounds


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all documents; a task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(count)], ["token", "n"])

        for piece in chunks(batches, limit=PIECE):
            more, n = np.unique(tokens(piece)[0], return_counts=True)
            name, at = np.unique(np.concatenate([name, more]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n]), minlength=len(name)).astype(np.int64)
            if len(name) > 1_000_000:
                yield batch()
                name, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(name):
            yield batch()

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words: sorted names, counts, and ids of those that the model tells apart."""

    def __init__(self, name: np.ndarray, count: np.ndarray):
        """Names by falling count."""
        order = np.argsort(name)
        self.name, self.count = name[order], count[order].astype(float)
        chosen = np.append(END, name[name != END][: WORDS - 1])
        of = dict(zip(name.tolist(), count.tolist()))
        self.model_counts = np.array([of.get(x, 0) for x in chosen.tolist()], float)
        rank = np.argsort(-self.model_counts, kind="stable")
        self.model_counts, chosen = self.model_counts[rank], chosen[rank]
        self.size, self.start = len(chosen), int(np.flatnonzero(chosen == END)[0])
        ids = dict(zip(chosen.tolist(), range(len(chosen))))
        self.ids = np.array([ids.get(x, self.size) for x in self.name.tolist()], np.int64)
        self.first = None

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model ids, counts, and whether the word is held here at all."""
        if not len(self.name):
            return np.where(name == END, self.start, self.size), np.zeros(len(name)), name == END
        at = np.minimum(self._places(name), len(self.name) - 1)
        held = self.name[at] == name
        ids = np.where(held, self.ids[at], self.size)
        ids[name == END] = self.start
        return ids, np.where(held, self.count[at], 0), held | (name == END)


    def _places(self, name: np.ndarray) -> np.ndarray:
        """Where ``name`` would stand among the sorted names; begins at the first with the same leading bits, which few share."""
        if self.first is None:  # made in the task, not sent to it
            sizes = np.bincount((self.name >> LEADING).astype(np.int64), minlength=1 << 64 - int(LEADING))
            self.first = np.cumsum(sizes) - sizes
        at = self.first[(name >> LEADING).astype(np.int64)]
        known = np.append(self.name, ~np.uint64(0))
        late = np.flatnonzero(known[at] < name)
        while len(late):
            at[late] += 1
            late = late[known[at[late]] < name[late]]
        return at


def train(docs: DataFrame, vocabulary: Vocabulary, other: float, workers: int, *, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after rounds of side-by-side training on all words of every document.

    Each round reads every document whole: consecutive windows of truncated
    backpropagation, with the state carried to the document's end. Documents
    are dealt to ``workers`` models by a hash of their id; these train in
    parallel and are averaged by the number of words they saw.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            name, bounds = tokens(piece)
            ids = vocabulary.find(name)[0].astype(np.int16)  # WORDS fits
            texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids)])
            place = mixed(piece.column("doc_id").fill_null(0).to_numpy().astype(np.uint64) + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), texts], ["place", "words"])

    whole = store(docs.select("doc_id", "text").mapInArrow(numbered, "place long, words binary").repartition(workers, "place").sortWithinPartitions("place", "words"), "lm-words")
    model = Gru(vocabulary.model_counts, other)
    for k in range(rounds):
        now, rate = model.flat(), 0.01 / (1 + k)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Gru(vocabulary.model_counts, other).load(now), 0
            for piece in chunks(batches, text="words", limit=TRAIN_PIECE):
                seen += own.train([np.frombuffer(b, np.int16) for b in piece.column("words").to_pylist()], vocabulary.start, rate)[1]
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own.flat().astype(np.float32).tobytes()], pa.binary())], ["seen", "parameters"])

        found = whole.mapInArrow(fit, "seen long, parameters binary").collect()
        if not found:
            break
        weight = np.array([r.seen for r in found], float)
        model.load(np.average([np.frombuffer(r.parameters, np.float32) for r in found], axis=0, weights=weight))
    return model.flat()


def score_documents(docs: DataFrame, *, folds: int = 5, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of (doc_id, text).

    1. Tokens of all documents that are not held out are counted.
    2. The recurrent model learns from every word of them.
    3. Every whole text is scored, with the state carried from window to
       window. A word that the model does not tell apart has the probability
       of their common class times its share (n + 0.5) in it.
    4. Counts of words beyond the HELD most frequent are joined; the words held
       in every task are few by that bound and hold all hot ones.

    Words are compared by 64-bit hashes. A null or empty text has its end only.
    A null id is learned from and not held out. Rows that repeat an id are
    scored each. With no training tokens the base score is 0 for each token; an
    empty table gives no row.
    """
    rows = docs.select("doc_id", "text")
    learned = rows.filter(~held_out(F.col("doc_id"), folds))
    counts = store(count_tokens(learned), "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, distinct = total.n or 0, total.v
    top = counts.orderBy(F.desc("n"), "token").limit(HELD).toPandas()
    vocabulary = Vocabulary(top.token.to_numpy(np.int64).view(np.uint64), top.n.to_numpy())
    apart = float(vocabulary.model_counts.sum())
    known_apart = int((vocabulary.model_counts > 0).sum())
    # All words of the common class, and one that was never seen.
    other = n_all - apart + 0.5 * (distinct - known_apart) + 0.5
    ends = int(vocabulary.model_counts[vocabulary.start])  # one for each training document
    parameters = train(learned, vocabulary, n_all - apart, min(WORKERS, -(-ends // DOCUMENTS) or 1), rounds=rounds)
    base = np.log10(n_all + 0.5 * (distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(vocabulary.model_counts, n_all - apart).load(parameters)
        key = TaskContext.get().partitionId() << 40
        for piece in chunks(batches, limit=PIECE):
            name, bounds = tokens(piece)
            ids, count, held = vocabulary.find(name)
            size = np.diff(bounds)
            row = np.repeat(np.arange(len(size)), size)
            share = np.where(held, np.log10(count + 0.5), 0)
            common = ids == vocabulary.size
            sums = np.bincount(row, share, minlength=len(size))
            recurrent = model.score(ids, bounds, vocabulary.start) / np.log(10)
            recurrent += np.bincount(row[common], share[common] - np.log10(other), minlength=len(size))
            rare_row, rare = row[~held], name[~held]
            order = np.lexsort((rare, rare_row))
            rare_row, rare = rare_row[order], rare[order]
            head = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1]))) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(rare)))
            ends = pa.array(np.searchsorted(rare_row[head], np.arange(len(size) + 1)), pa.int32())
            arrays = [
                pa.array(key + np.arange(len(size))),
                piece.column("doc_id"),
                pa.array(size),
                pa.array(np.bincount(row, held & (count > 0), minlength=len(size)).astype(np.int64)),
                pa.array(sums - size * base),
                pa.array(recurrent),
                pa.ListArray.from_arrays(ends, pa.array(rare[head].view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
            ]
            key += len(size)
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n_tokens", "n_known", "base", "recurrent", "rare", "times"])

    schema = "key long, doc_id long, n_tokens long, n_known long, base double, recurrent double, rare array<long>, times array<long>"
    scored = store(rows.mapInArrow(score, schema), "lm-scores")
    asked = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    joined = asked.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = joined.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("share"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    result = scored.drop("rare", "times").join(rest, "key", "left").fillna(0, ["share", "known"])
    return result.select(
        "doc_id",
        held_out(F.col("doc_id"), folds).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("share")).alias("base_score"),
        (F.col("recurrent") + F.col("share")).alias("score"),
    )
