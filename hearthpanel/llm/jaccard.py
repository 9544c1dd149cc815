"""Exact Jaccard join of documents on word n-grams by a blocked sparse matrix product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthpanel.llm.common import chunks, flat_bytes, gathered, mixed, store
from hearthpanel.llm.components import components
from hearthpanel.llm.textbytes import LOWER, Hashes, words

#: Rows of a block: its n-grams and 1024 for each document add up to this at most, or it is one document.
BLOCK = 1 << 20
#: n-grams of the incidence matrix that are multiplied at a time.
COLUMNS = 4096


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit n-gram hashes of every row, sorted within it, and where each row's start; fewer words form one n-gram."""
    starts, ends, row = words(data, offsets)
    word = mixed(Hashes(LOWER[data]).of(starts, ends))
    count = np.bincount(row, minlength=len(offsets) - 1)
    gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        gram = mixed(gram + word[k : len(word) - n + 1 + k]) if len(gram) else gram
    whole = row[: len(gram)] == row[n - 1 :] if len(gram) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.searchsorted(row, short)
    sequence = count[short].astype(np.uint64)
    for k in range(n - 1):
        more = count[short] > k
        sequence[more] = mixed(sequence[more] + word[first[more] + k])
    gram = np.concatenate([gram[whole], mixed(sequence)])
    owner = np.concatenate([row[: len(whole)][whole], short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(len(offsets)))


def keys(gram: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each row's set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def need(size, percent: int):
    """n-grams of a set of this size that a linked partner has to share at least."""
    return -(-size * percent // 100)


def spare(size):
    """Prefixes are longer than needed by so many n-grams, so that a document may do without its most frequent ones."""
    return size // 12 + 1


def links(block: list[tuple[int, int, int, np.ndarray, np.ndarray]], tile: int, i: int, j: int, percent: int) -> list[tuple[int, int, int]]:
    """Documents of a block pair with links in it: (document, smallest document it is joined to, linked documents).

    ``block`` has (document, block, copies, n-grams, tiles) rows. The incidence
    of documents and n-grams is multiplied a range of columns at a time and
    overlaps add up; a pair is dropped when its overlap and what is left of the
    smaller set cannot reach the bound that their sizes give. A pair is counted
    in the first tile that both have, and nowhere else.
    """
    size = np.array([len(b[3]) for b in block])
    flat = np.concatenate([b[3] for b in block])
    owner = np.repeat(np.arange(len(block)), size)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    held = np.bincount(owner, minlength=len(block))
    alive = np.flatnonzero(held >= need(size, percent))
    if len(alive) < 2:
        return []
    place = np.full(len(block), -1)
    place[alive] = np.arange(len(alive))
    kept = place[owner] >= 0
    owner, column = place[owner[kept]], column[kept]
    size, left = size[alive], held[alive].astype(np.float32)
    wanted = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
    part = np.array([block[x][1] for x in alive])
    pairs = np.triu(np.ones((len(alive), len(alive)), bool), 1) if i == j else (part[:, None] == i) & (part[None, :] == j)
    pairs &= 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros(pairs.shape, np.float32)
    for start in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        incidence = np.zeros((len(alive), COLUMNS), np.float32)
        incidence[owner[a:b], column[a:b] - start] = 1
        overlap += incidence @ incidence.T
        left -= np.bincount(owner[a:b], minlength=len(alive))
        pairs &= overlap + np.minimum(left[:, None], left) >= wanted
        if not pairs.any():
            return []
    linked = pairs & (100 * overlap >= percent * (size[:, None] + size - overlap))
    linked |= linked.T
    tiles = [block[x][4] for x in alive]
    earlier = np.concatenate([t[t < tile] for t in tiles])
    own = linked
    if len(earlier):
        names, at = np.unique(earlier, return_inverse=True)
        member = np.zeros((len(alive), len(names)), np.float32)
        member[np.repeat(np.arange(len(alive)), [np.count_nonzero(t < tile) for t in tiles]), at] = 1
        own = linked & (member @ member.T == 0)
    doc = np.array([block[x][0] for x in alive])
    copies = np.array([block[x][2] for x in alive])
    root = doc.copy()
    while True:
        least = np.minimum(root, np.where(linked, root, np.iinfo(np.int64).max).min(1))
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(linked.any(1))
    return list(zip(doc[some].tolist(), root[some].tolist(), (own[some] @ copies).tolist()))


def jaccard_join(docs: DataFrame, *, n: int = 4, percent: int = 85, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id of every row of (doc_id, text).

    A row's set holds its distinct n-word shingles (words in lower case A-Z;
    with fewer words, the whole sequence). Rows link when 100 * intersection >=
    ``percent`` * union. ``component_id`` is the smallest id that links lead
    to, ``n_links`` the number of rows linked to it.

    1. Rows of equal sets become one class, so copies cost one row each.
    2. Of each class's set, the n-grams with the smallest hashes are counted
       over all classes. Their number follows from the size: two linked sets
       share at least ``spare`` of them. A class with fewer that occur
       elsewhere is out; the others leave out their most frequent ones.
    3. Classes that share an n-gram meet in the tile of the smallest id that
       has it; a large tile is cut into blocks by size, and only block pairs
       whose sizes allow a link are formed. ``links`` multiplies each of them.
    4. Components of the links found are joined back to the rows.

    Results don't depend on block sizes or frequencies. Sets are compared by
    64-bit hashes of their n-grams. A null or empty text, and one of white
    space only, has no shingles, no links and its own id. A null id takes no
    part in links and has a null component. Rows that repeat an id with other
    texts are judged each by its own. An empty table gives no row. Columns
    named in ``also`` are carried along, to tell such rows apart; they must not
    be called n, k1, k2, component or links.
    """
    texts = docs.select("doc_id", "text")
    extra = list(also)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            gram, bounds = ngrams(*flat_bytes(piece.column("text")), n)
            found = [piece.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, keys(gram, bounds)), *(piece.column(c) for c in extra)]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", "n", "k1", "k2", *extra])

    described = StructType.fromDDL("doc_id long, n long, k1 long, k2 long")
    for c in extra:
        described = described.add(docs.schema[c])
    sets = store(docs.select("doc_id", "text", *extra).mapInArrow(describe, described), "jaccard-sets")
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    classes = store(classes, "jaccard-classes")

    def own(piece: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(position, n-grams) of the rows that have the set of the class they were joined to."""
        gram, bounds = ngrams(*flat_bytes(piece.column("text")), n)
        k1, k2 = keys(gram, bounds)
        same = (k1 == piece.column("k1").to_numpy()) & (k2 == piece.column("k2").to_numpy())
        for at in np.flatnonzero(same):
            yield int(at), gram[bounds[at] : bounds[at + 1]]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            ids = piece.column("doc_id").to_numpy()
            found = [(ids[at], g[: len(g) - need(len(g), percent) + spare(len(g))]) for at, g in own(piece)]
            if not found:
                continue
            gram = np.concatenate([g for _, g in found])
            owner = np.repeat([d for d, _ in found], [len(g) for _, g in found])
            yield gathered(gram, owner, "gram")

    placed = texts.filter("doc_id is not null")
    postings = placed.join(classes, "doc_id").select("doc_id", "text", "k1", "k2").mapInArrow(prefixes, "gram long, docs array<long>")
    # One row for each n-gram and piece of a task: a frequent one arrives pre-aggregated.
    over = Window.partitionBy("gram")
    met = postings.withColumns({"df": F.sum(F.size("docs")).over(over), "tile": F.min(F.array_min("docs")).over(over)}).filter("df > 1")
    met = met.select(F.explode("docs").alias("doc_id"), F.struct("df", "gram", "tile").alias("hit"))
    hits = met.groupBy("doc_id").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    size = classes.groupBy("doc_id").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("copies").alias("copies"))
    partner = -F.floor(-F.col("least") * percent / 100)  # size of the smallest set that can link
    few = F.floor(partner / 12).cast("int")  # spare(partner) - 1
    tiles = hits.join(size, "doc_id").filter(F.size("hits") > few)
    tiles = tiles.select("doc_id", "most", F.array_sort(F.array_distinct(F.slice("hits.tile", F.lit(1), F.greatest(F.size("hits") - few, F.lit(0))))).alias("tiles"))
    members = store(tiles.select("doc_id", "most", "tiles", F.explode("tiles").alias("tile")), "jaccard-tiles")
    busy = members.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("tile")
    along = Window.partitionBy("tile").orderBy("most", "doc_id")
    weight = F.sum(F.col("most") + 1024).over(along) - F.col("most") - 1024
    blocks = members.join(busy, "tile").withColumn("block", F.floor(weight / BLOCK).cast("int"))
    blocks = store(blocks, "jaccard-blocks")
    range_ = blocks.groupBy("tile", "block").agg(F.min("most").alias("low"), F.max("most").alias("high"))
    i = range_.select("tile", F.col("block").alias("i"), F.col("high").alias("below"))
    j = range_.select("tile", F.col("block").alias("j"), F.col("low").alias("above"))
    pairs = i.join(j, "tile").filter((F.col("i") <= F.col("j")) & (100 * F.col("below") >= percent * F.col("above")))
    pairs = pairs.select("tile", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sent = blocks.join(pairs, ["tile", "block"]).select("doc_id", "tile", "i", "j", "block", "tiles")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            found = list(own(piece))
            at = pa.array([a for a, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), piece.column("copies").take(at), pa.array([g.tobytes() for _, g in found], pa.binary())], ["doc_id", "copies", "grams"])

    busy_docs = blocks.select("doc_id").distinct()
    wanted = placed.join(classes.join(busy_docs, "doc_id", "left_semi"), "doc_id").select("doc_id", "text", "k1", "k2", "copies")
    arrays = wanted.mapInArrow(sets_of, "doc_id long, copies long, grams binary")
    grouped = arrays.join(sent, "doc_id").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "doc_id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "i", "j", "doc_id", "block", "copies", "grams", "tiles"]
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        waiting: list[tuple] = []
        for (tile, a, b), group in groupby(rows, key=itemgetter(0, 1, 2)):
            distinct = {(r[3], r[6]): (r[3], r[4], r[5], np.frombuffer(r[6], np.uint64), np.array(r[7], np.int64)) for r in group}
            if len(distinct) > 1:
                waiting += links(list(distinct.values()), tile, a, b, percent)
            if len(waiting) > 50_000:
                yield as_batch(waiting)
                waiting = []
        if waiting:
            yield as_batch(waiting)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "root", "links"])

    found = store(grouped.mapInArrow(multiply, "doc_id long, root long, links long"), "jaccard-links")
    joined = components(found.filter("doc_id <> root"), "doc_id", "root")
    degree = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    named = classes.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(degree, "doc_id", "left")
    named = named.select("n", "k1", "k2", F.coalesce("component", "doc_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    result = sets.join(named, ["n", "k1", "k2"], "left")
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
        *extra,
    )
