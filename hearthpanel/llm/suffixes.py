"""Repeated byte strings across documents by bucket-pointer refinement of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.common import chunks, flat_bytes, free_name, mixed, release, store
from hearthpanel.llm.textbytes import Hashes

#: Bytes of the initial buckets.
Q = 16
#: Neighbouring string starts that the second refinement takes together.
RUN = 8
#: Bytes of text that a task names at a time; the names take about 100 times that.
PIECE = 1 << 20
TURNS = np.random.default_rng(20240608).integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPANS = "doc_id long, text_sha256 string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"


class Suffixes(NamedTuple):
    """Sampled suffixes of a run of texts: each stands for the string starts ``low`` to ``high`` around it.

    ``bucket`` names its first Q bytes, ``context`` all bytes of the strings it
    stands for; ``first``, ``two`` and ``string`` name, at each byte offset, the
    Q bytes, 2Q bytes and string of full length that begin there.
    """

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bucket: np.ndarray
    context: np.ndarray
    first: np.ndarray
    two: np.ndarray
    string: np.ndarray

    def runs(self, which: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """String starts of some suffixes in runs of up to RUN, counted back from the suffix.

        Returns for each run the position of its suffix in ``which``, its
        first and last start, the name of the bytes that all strings of a run
        at this place share, and the name of all its bytes.
        """
        low, high = self.low[which], self.high[which]
        at = np.full(len(low), -1)
        for k in range(length - Q + 1):
            here = low + k
            new = (at < 0) & (self.first[np.minimum(here, len(self.first) - 1)] == self.bucket[which])
            at[new] = here[new]
        near, far = (at - high) // RUN, (at - low) // RUN
        step, owner = _inside(near, far)
        core = at[owner] - RUN * step
        begin, end = np.maximum(low[owner], core - RUN + 1), np.minimum(high[owner], core)
        shared = mixed(self.two[core] * TURNS[2] + self.two[core + length - RUN + 1 - 2 * Q])
        whole = mixed(self.string[begin] * TURNS[3] + self.string[end] + (end - begin).astype(np.uint64))
        return owner, begin, end, shared, whole


def sampled(data: np.ndarray, offsets: np.ndarray, length: int) -> Suffixes:
    """Sample suffixes so that equal strings of ``length`` bytes have the same one at the same place in them.

    A string is stood for by its suffix with the smallest bucket number, the
    first on a tie. Names of longer strings are built from names of shorter
    ones at later offsets, each level from the one before: 2Q from Q,
    ``length`` from 2Q, the whole context from ``length``.
    """
    if not 2 * Q + RUN <= length <= 4 * Q:
        raise ValueError(f"length must be from {2 * Q + RUN} to {4 * Q}")
    size = offsets[1:] - offsets[:-1]
    if len(data) < length or not (size >= length).any():
        return Suffixes(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 5)
    first = mixed(Hashes(data).grams(Q))
    n = len(data) - length + 1
    # Sums of well-mixed names with odd factors name the longer strings.
    two = first[: len(first) - Q] * TURNS[0] + first[Q:]
    string = two[:n] * TURNS[1] + two[length - 2 * Q : length - 2 * Q + n]
    width = length - Q + 1
    least, span = first, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    long = size >= length
    starts = np.zeros(len(data) + 1, np.int64)
    np.add.at(starts, offsets[:-1][long], 1)
    np.add.at(starts, offsets[1:][long] - length + 1, -1)
    # Starts of strings that lie in one text; those of two texts are never next to each other.
    at = np.flatnonzero(np.cumsum(starts)[:n])
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (first[at[:-1]] == least[at[:-1]])
    edge = np.flatnonzero(head)
    low, high = at[edge], at[np.append(edge[1:], len(at)) - 1]
    row = np.searchsorted(offsets, low, side="right") - 1
    context = mixed(string[low] * TURNS[4] + string[high] + (high - low).astype(np.uint64))
    return Suffixes(row, low, high, least[low], context, first, two, string)


def _sent(core: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row for each distinct pair of names: its smallest document, and the others of this piece if there are any."""
    order = np.lexsort((doc, whole, core))
    core, whole, doc = core[order], whole[order], doc[order]
    pair = np.ones(len(core), bool)
    pair[1:] = (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])
    fresh = pair.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    core, whole, doc, pair = core[fresh], whole[fresh], doc[fresh], pair[fresh]
    heads = np.flatnonzero(pair)
    others = np.diff(np.append(heads, len(core))) - 1
    ends = np.concatenate([[0], np.cumsum(others)])
    more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(doc[~pair], pa.int64()), mask=pa.array(others == 0))
    return pa.RecordBatch.from_arrays([pa.array(core[heads].view(np.int64)), pa.array(whole[heads].view(np.int64)), pa.array(doc[heads], pa.int64()), more], ["core", "whole", "doc", "more"])


SENT = "core long, whole long, doc long, more array<long>"


def _refined(sent: DataFrame) -> DataFrame:
    """doc_id, name, and whether a smaller document has all of the name's bytes (``done``) or others share only its core.

    Documents and names of which neither holds are gone. Of documents with the
    same bytes, only the smallest is looked at further.
    """
    same, bucket = Window.partitionBy("core", "whole"), Window.partitionBy("core")
    # Dealt by the core alone, the rows serve both windows without a second exchange.
    seen = sent.repartition("core").sortWithinPartitions("core", "whole")
    last = F.max(F.coalesce(F.array_max("more"), F.col("doc"))).over(bucket)
    seen = seen.withColumns({"low": F.min("doc").over(bucket), "last": last}).filter("low < last")
    seen = seen.withColumn("least", F.min("doc").over(same))
    seen = seen.withColumns({"low": F.min("least").over(bucket), "top": F.max("least").over(bucket)})
    copies = F.coalesce(F.filter("more", lambda d: d > F.col("least")), F.array().cast("array<long>"))
    done = F.concat(F.when(F.col("doc") > F.col("least"), F.array("doc")).otherwise(F.array().cast("array<long>")), copies)
    open_ = F.when((F.col("doc") == F.col("least")) & (F.col("low") < F.col("top")), F.array(F.struct(F.col("doc").alias("doc_id"), F.lit(False).alias("done"))))
    told = F.concat(F.transform(done, lambda d: F.struct(d.alias("doc_id"), F.lit(True).alias("done"))), F.coalesce(open_, F.array().cast("array<struct<doc_id:long,done:boolean>>")))
    return seen.select(F.col("whole").alias("name"), F.explode(told).alias("t")).select("t.doc_id", "name", "t.done")


def _by_document(refined: DataFrame, done: str, open_: str) -> DataFrame:
    return refined.groupBy("doc_id").agg(F.collect_list(F.when(F.col("done"), F.col("name"))).alias(done), F.collect_list(F.when(~F.col("done"), F.col("name"))).alias(open_))


def _rows(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row each belongs to; a null list is empty."""
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(n), counts)


def _listed(row: np.ndarray, name: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether a row's list holds the name."""
    values, owner = _rows(column, len(column))
    salt = mixed(np.arange(len(column), dtype=np.uint64) + np.uint64(1))
    return np.isin(name ^ salt[row], values ^ salt[owner])


def _inside(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All offsets from ``low`` to ``high``, and the position of the suffix each comes from."""
    many = high - low + 1
    owner = np.repeat(np.arange(len(low)), many)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[owner], owner


def repeated_spans(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """Bytes of every row of (doc_id, text) that a string of ``length`` bytes covers which also starts in a smaller doc_id.

    One stored row per input row: doc_id, text_sha256, n_bytes, n_removed,
    n_spans, kept_sha256 and the removed spans in bytes. Strings are judged on
    the input texts; matches never cross documents.

    1. Every string is stood for by one sampled suffix (about one in 18). The
       first ``Q`` bytes are its initial bucket. Inside a bucket, suffixes are
       refined by the names at later offsets, to all bytes of the strings they
       stand for. Where a smaller document has the same bytes, all these
       strings repeat; of equal bytes only the smallest document goes on.
    2. Where a bucket keeps several, the string starts are refined in runs:
       what all strings of a run share is the next bucket.
    3. Where that keeps several too, single strings are compared.
    4. What was found goes back to the documents by name, not by place.

    Copies of a smaller document are removed whole after a comparison of
    hashes. A frequent name arrives as one row per piece of a task. Nothing is
    capped: a name is followed however often it occurs. Names are 64-bit hashes.

    A null text is empty; texts shorter than ``length`` stay. A null doc_id is
    not smaller than any, so its row stays and takes nothing from others. Rows
    that repeat an id take nothing from each other. An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    every = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    every = store(every, "suffix-texts")
    least = every.filter("doc_id is not null").groupBy("text_sha256").agg(F.min("doc_id").alias("original"))
    every = every.join(least, "text_sha256", "left")
    copy = (F.col("doc_id") > F.col("original")) & (F.col("n_bytes") >= length)
    # Ids whose every text is a copy need no further look.
    lasting = every.filter(f"n_bytes >= {length} and doc_id = original").select("doc_id").distinct()
    placed = texts.filter("doc_id is not null")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            found = sampled(*flat_bytes(piece.column("text")), length)
            yield _sent(found.bucket, found.context, piece.column("doc_id").to_numpy()[found.row])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            found = sampled(*flat_bytes(piece.column("text")), length)
            which = np.flatnonzero(_listed(found.row, found.context, piece.column("contexts")))
            owner, _, _, core, whole = found.runs(which, length)
            yield _sent(core, whole, piece.column("doc_id").to_numpy()[found.row[which[owner]]])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            found = sampled(*flat_bytes(piece.column("text")), length)
            which = np.flatnonzero(_listed(found.row, found.context, piece.column("contexts")))
            owner, begin, end, _, whole = found.runs(which, length)
            keep = _listed(found.row[which[owner]], whole, piece.column("runs"))
            at, of = _inside(begin[keep], end[keep])
            yield _sent(found.string[at], found.string[at], piece.column("doc_id").to_numpy()[found.row[which[owner[keep][of]]]])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            data, offsets = flat_bytes(piece.column("text"))
            found = sampled(data, offsets, length)
            whole = _listed(found.row, found.context, piece.column("whole"))
            rest = np.flatnonzero(_listed(found.row, found.context, piece.column("contexts")))
            owner, begin, end, _, name = found.runs(rest, length)
            row = found.row[rest[owner]]
            run = _listed(row, name, piece.column("whole_runs"))
            at, of = _inside(begin[~run], end[~run])
            single = at[_listed(row[~run][of], found.string[at], piece.column("strings"))]
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, np.concatenate([found.low[whole], begin[run], single]), 1)
            np.add.at(change, np.concatenate([found.high[whole], end[run], single]) + length, -1)
            gone = np.cumsum(change)[:-1] > 0
            raw = data.tobytes()
            rows = []
            for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                mask = np.concatenate([[False], gone[a:b], [False]])
                edges = np.flatnonzero(mask[1:] != mask[:-1]).tolist()
                begins, ends = edges[::2], edges[1::2]
                kept = b"".join(raw[a + x : a + y] for x, y in zip([0, *ends], [*begins, b - a]))
                spans = [{"start": x, "length": y - x} for x, y in zip(begins, ends)]
                rows.append((doc, hashlib.sha256(raw[a:b]).hexdigest(), b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            names = ["doc_id", "text_sha256", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    first = _refined(placed.mapInArrow(contexts, SENT)).join(lasting, "doc_id", "left_semi")
    first = store(_by_document(first, "whole", "contexts"), "suffix-contexts")
    release(spark)
    asked = first.filter(F.size("contexts") > 0).select("doc_id", "contexts")
    second = _by_document(_refined(placed.join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "contexts").mapInArrow(runs, SENT)), "whole_runs", "runs")
    second = store(second, "suffix-runs")
    release(spark)
    asked = asked.join(second.filter(F.size("runs") > 0).select("doc_id", "runs"), "doc_id")
    third = _refined(placed.join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "contexts", "runs").mapInArrow(strings, SENT)).filter("done")
    third = store(third.groupBy("doc_id").agg(F.collect_list("name").alias("strings")), "suffix-strings")
    release(spark)
    told = first.join(second.select("doc_id", "whole_runs"), "doc_id", "left").join(third, "doc_id", "left")
    told = told.filter("size(whole) > 0 or size(whole_runs) > 0 or strings is not null")
    # The lists of names are hashed, so that texts need no sort.
    found = placed.join(told.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "whole", "contexts", "whole_runs", "strings")
    spans = found.mapInArrow(remove, SPANS).dropDuplicates(["doc_id", "text_sha256"])

    cut = every.join(spans.drop("n_bytes"), ["doc_id", "text_sha256"], "left")
    entire = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    none = F.lit([]).cast("array<struct<start:long,length:long>>")
    result = cut.select(
        "doc_id",
        "text_sha256",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
        F.when(copy, entire).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
    result = store(result, "suffix-spans")
    release(spark)
    return result


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``repeated_spans`` cut from their texts; a character that loses a byte goes whole.

    Rows keep their other columns. A text of which nothing is left becomes
    empty; a null text stays null.
    """
    sha, places = free_name(docs, "sha"), free_name(docs, "spans")
    named = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    cut = spans.filter("n_removed > 0").select("doc_id", F.col("text_sha256").alias(sha), F.col("spans").alias(places)).dropDuplicates(["doc_id", sha])
    joined = named.join(cut, ["doc_id", sha], "left")
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            out = []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column(places).to_pylist()):
                if spans:
                    raw = text.encode()
                    begins, ends = [s["start"] for s in spans], [s["start"] + s["length"] for s in spans]
                    text = "".join(raw[x:y].decode(errors="ignore") for x, y in zip([0, *ends], [*begins, len(raw)]))
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else piece.column(c) for c in names], names)

    return joined.select(*names, places).mapInArrow(run, schema)
