"""Alignment of two tokenizers over the same bytes by sparse incidence matrices.

Tokens of a text and the bytes they cover form a sparse matrix for either
tokenizer, A and B. The product of A with B transposed links the tokens that
overlap and counts their common bytes. A new group begins where a row of that
product shares no column with the row before, for there both tokenizers cut;
tokens and groups form two more incidence matrices, whose product links all
tokens of a group, and the incidence with last bytes alone links tokens that end
together. Matrices hold many texts at once: their blocks do not touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.bpe import byte_letters
from hearthpanel.llm.common import chunks, flat_bytes, spread
from hearthpanel.llm.tokens import Encoder, Memory, distinct_pieces, encoder, ids_of_pieces, merged_rows, piece_starts, plain_rows

#: Products of a row block of a matrix product held at a time.
BLOCK = 1 << 21
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<struct<a:int,b:int,n:int>>"


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has ``columns`` and ``values`` from ``at[i]`` to ``at[i + 1]``."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, counts: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        """An incidence matrix with ``counts`` entries of one in its rows."""
        return cls(np.append(0, np.cumsum(counts)), columns, np.ones(len(columns), np.int64), width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def transposed(self) -> Csr:
        turn = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        return Csr(np.append(0, np.cumsum(counts)), self.rows()[turn], self.values[turn], len(self.at) - 1)


def product(left: Csr, right: Csr) -> Csr:
    """Gustavson's product: each row is the sum of the right rows that its entries name, blocks of rows at a time."""
    per_entry = np.diff(right.at)[left.columns]
    work = np.append(0, np.cumsum(per_entry))[left.at]  # products before each row
    sizes, columns, values = [], [], []
    start, rows = 0, len(left.at) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(work, work[start] + BLOCK, side="right")) - 1)
        a, b = left.at[start], left.at[stop]
        counts = per_entry[a:b]
        place = spread(right.at[left.columns[a:b]], counts)
        row = np.repeat(np.repeat(np.arange(stop - start), np.diff(left.at[start : stop + 1])), counts)
        key = row * right.width + right.columns[place]
        value = np.repeat(left.values[a:b], counts) * right.values[place]
        if (key[1:] < key[:-1]).any():
            turn = np.argsort(key, kind="stable")
            key, value = key[turn], value[turn]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key = key[head]
        sizes.append(np.bincount(key // right.width, minlength=stop - start) if len(key) else np.zeros(stop - start, np.int64))
        columns.append(key % right.width if len(key) else key)
        values.append(np.add.reduceat(value, head) if len(head) else value)
        start = stop
    if not sizes:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), right.width)
    return Csr(np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(columns), np.concatenate(values), right.width)


class PieceEncoder:
    """Ids of a sentence-piece vocabulary, with a memory of pieces, and the bytes of every id.

    Its merges join no character to a space behind it and no line end to
    anything, so plain texts are cut there; other texts go to the library whole.
    """

    def __init__(self, name: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in names):
            raise ValueError(f"{name} has pieces that reach over white space")
        table = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.sizes = np.fromiter(map(len, table), np.int64, n)
        self.at = np.append(0, np.cumsum(self.sizes))
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.memory = Memory(self._learn)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        found = [b""] * len(pieces)
        spaced = [i for i, p in enumerate(pieces) if p[0] == 0x20]
        for i, p in enumerate(pieces):
            if p[0] != 0x20:  # behind a line end, whose id and that of the space before it are left out
                found[i] = np.array(self.library.encode("\n" + p.decode())[2:], "<u4").tobytes()
        if spaced:
            mine = [pieces[i] for i in spaced]
            ids = np.array(self.library.encode(b"".join(mine)[1:].decode()), "<u4")
            ends = np.cumsum(np.fromiter(map(len, mine), np.int64, len(mine)))
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            flat, start = ids.tobytes(), 0
            for i, end in zip(spaced, cuts.tolist()):
                found[i] = flat[start:end]
                start = end
        return found

    def flat(self, spaced: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each starts; ``spaced`` has the texts behind a space, which the library adds itself."""
        data, offsets = flat_bytes(spaced)
        plain = plain_rows(data, offsets)
        starts = piece_starts(data, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        keep = plain[row]
        codes, pieces = distinct_pieces(data, starts, keep)
        ids, counts = ids_of_pieces(codes, self.memory.ids(pieces))
        rest = texts.filter(pa.array(~plain)).to_pylist() if not plain.all() else []
        return merged_rows(plain, row[keep], ids, counts, [np.array(i, "<u4") for i in self.library.encode(rest, num_threads=1)])


class Bytes(NamedTuple):
    """Bytes that the ids of a vocabulary stand for."""

    table: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tokenizer: Encoder) -> Bytes:
        """Of a byte-level vocabulary; ids of special strings, which plain texts never get, stand for nothing."""
        letters = byte_letters()
        names = tokenizer.tokenizer.get_vocab()
        table = [b""] * (max(names.values()) + 1)
        special = {t.content for t in tokenizer.tokenizer.get_added_tokens_decoder().values()}
        for name, i in names.items():
            if name not in special:
                table[i] = bytes(letters[c] for c in name)
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        return cls(np.frombuffer(b"".join(table), np.uint8), np.append(0, np.cumsum(sizes)), sizes)


def same_bytes(table, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose ids stand for exactly the row's bytes."""
    sizes = table.sizes[ids]
    ends = np.append(0, np.cumsum(sizes))
    good = ends[at[1:]] - ends[at[:-1]] == np.diff(offsets)
    per_id = np.repeat(good, np.diff(at))
    made = table.table[spread(table.at[ids[per_id]], sizes[per_id])]
    given = data if good.all() else data[np.repeat(good, np.diff(offsets))]
    if wrong := np.flatnonzero(made != given).tolist():
        owners = np.repeat(np.flatnonzero(good), np.diff(offsets)[good])
        good[np.unique(owners[wrong])] = False
    return good


class Links(NamedTuple):
    """Groups of both sides' tokens and the links between tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    links: Csr


def link(sizes_a: np.ndarray, sizes_b: np.ndarray, kind: str) -> Links:
    """Groups and links of two tokenizations of the same bytes, from the byte sizes of their tokens.

    ``kind`` is "overlap" (links weighted by common bytes), "group" (all pairs
    of a group) or "end" (pairs whose last bytes are the same).
    """
    n = int(sizes_a.sum())
    a = Csr.of(sizes_a, np.arange(n), n)
    b = Csr.of(sizes_b, np.arange(n), n)
    overlap = product(a, b.transposed())
    rows = len(sizes_a)
    first = overlap.columns[overlap.at[:-1]]
    last = overlap.columns[overlap.at[1:] - 1]
    group_a = np.cumsum(np.append(True, first[1:] != last[:-1])) - 1 if rows else np.zeros(0, np.int64)
    group_b = np.empty(len(sizes_b), np.int64)
    group_b[overlap.columns] = group_a[overlap.rows()]
    if kind == "overlap":
        return Links(group_a, group_b, overlap)
    if kind == "group":
        groups = int(group_a[-1]) + 1 if rows else 0
        return Links(group_a, group_b, product(Csr.of(np.ones(rows, np.int64), group_a, groups), Csr.of(np.ones(len(sizes_b), np.int64), group_b, groups).transposed()))
    if kind != "end":
        raise ValueError("kind must be overlap, group or end")
    ends_a = Csr.of(np.ones(rows, np.int64), a.at[1:] - 1, n)
    ends_b = Csr.of(np.ones(len(sizes_b), np.int64), b.at[1:] - 1, n)
    return Links(group_a, group_b, product(ends_a, ends_b.transposed()))


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every number below ``size``, with a free place behind, and how many each has."""
    names = [str(i).encode() for i in range(size)]
    wide = max(map(len, names)) + 1
    return np.frombuffer(b"".join(n.ljust(wide, b"\0") for n in names), np.uint8).reshape(size, wide), np.fromiter(map(len, names), np.int64, size)


class Aligner:
    def __init__(self, a: str, b: str, kind: str):
        self.a, self.b, self.kind = encoder(a), PieceEncoder(b), kind
        self.bytes_a = Bytes.of(self.a)
        self.digits, self.digit_counts = decimals(max(len(self.bytes_a.sizes), len(self.b.sizes)))

    def batch(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        rows = len(ids)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        mine = np.flatnonzero(some.to_numpy(zero_copy_only=False))
        texts = texts.filter(some)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
        data, offsets = flat_bytes(spaced)
        ids_a, at_a = self.a.flat(spaced)
        ids_b, at_b = self.b.flat(spaced, texts)
        good = same_bytes(self.bytes_a, ids_a, at_a, data, offsets) & same_bytes(self.b, ids_b, at_b, data, offsets)
        row_a = np.repeat(mine, np.diff(at_a))
        row_b = np.repeat(mine, np.diff(at_b))
        if not good.all():
            keep_a, keep_b = np.repeat(good, np.diff(at_a)), np.repeat(good, np.diff(at_b))
            ids_a, row_a, ids_b, row_b = ids_a[keep_a], row_a[keep_a], ids_b[keep_b], row_b[keep_b]
        found = link(self.bytes_a.sizes[ids_a], self.b.sizes[ids_b], self.kind)

        text, text_at = self._groups(found, ids_a, ids_b, row_a, row_b, rows)
        # Distinct id pairs of each row, with their numbers.
        at = found.links.rows()
        key = (row_a[at] << 34) | (ids_a[at].astype(np.int64) << 17) | ids_b[found.links.columns]
        key, counts = np.unique(key, return_counts=True)
        pair_at = np.append(0, np.cumsum(np.bincount(key >> 34, minlength=rows))).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array((key >> 17) & 0x1FFFF, pa.int32()), pa.array(key & 0x1FFFF, pa.int32()), pa.array(counts, pa.int32())], ["a", "b", "n"]
        )
        new_group = np.append(True, found.group_a[1:] != found.group_a[:-1]) if len(row_a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(np.bincount(row_a, minlength=rows), pa.int64()),
                pa.array(np.bincount(row_b, minlength=rows), pa.int64()),
                pa.array(np.bincount(row_a[new_group], minlength=rows), pa.int64()),
                pa.StringArray.from_buffers(rows, pa.py_buffer(text_at), pa.py_buffer(text)),
                pa.ListArray.from_arrays(pa.array(pair_at), pairs),
            ],
            ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
        )

    def _groups(self, found: Links, ids_a, ids_b, row_a, row_b, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The groups of every row as ``a1,a2|b1;a3|b2,b3``: bytes of all rows, and where each starts."""
        if not len(row_a):
            return np.zeros(0, np.uint8), np.zeros(rows + 1, np.int32)
        size_a, size_b = np.bincount(found.group_a), np.bincount(found.group_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[found.group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(size_a)[found.group_b]
        units = len(ids_a) + len(ids_b)
        token, row, mark = np.empty(units, np.int64), np.empty(units, np.int64), np.full(units, ord(","), np.uint8)
        token[place_a], token[place_b] = ids_a, ids_b
        row[place_a], row[place_b] = row_a, row_b
        both = np.cumsum(size_a + size_b)
        mark[both - size_b - 1] = ord("|")
        mark[both - 1] = ord(";")
        digits, wide = self.digits[token], self.digit_counts[token]
        digits[np.arange(units), wide] = mark
        wide = wide + np.append(row[1:] == row[:-1], False)  # no mark behind a row's last group
        text = digits[np.arange(digits.shape[1]) < wide[:, None]]
        return text, np.append(0, np.cumsum(np.bincount(row, wide, rows).astype(np.int64))).astype(np.int32)


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def align(docs: DataFrame, *, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", kind: str = "end") -> DataFrame:
    """Both tokenizers' ids of every whole text of (doc_id, text), cut into groups and linked.

    ``a`` encodes the text behind a space, ``b`` the text, to which it adds
    that space. Returns doc_id, n_a and n_b (tokens), n_groups, groups (as
    ``a1,a2|b1;a3|b2,b3``, ids in order) and links: the distinct pairs of ids
    that are linked in the text, with the number of their links (see ``link``).

    Null and empty texts, and texts whose ids of either side do not stand for
    exactly the space and the text, have no tokens: zeros, an empty string and
    an empty list. A null doc_id is kept; rows that repeat an id give a row
    each; an empty table gives none; other columns are not read. Texts stay in
    their task, about 1 MB of them or one long text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a, b, kind) not in _ALIGNERS:
            _ALIGNERS[a, b, kind] = Aligner(a, b, kind)
        for piece in chunks(batches):
            yield _ALIGNERS[a, b, kind].batch(piece.column("doc_id"), piece.column("text"))

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def with_link_counts(aligned: DataFrame, *, kind: str = "end") -> DataFrame:
    """Add n_links, n_best and count_sum to aligned rows, from the counts of id pairs over all rows; ``links`` goes.

    An id pair's count is the number of its links in the table. n_best counts a
    row's links whose pair has the highest count of all pairs with its B id,
    ties included; count_sum adds up the counts of its links. The rows are read
    twice, so pass a stored table.

    For links of the kind "end" the counts are broadcast: the two tokens' bytes
    end alike, so one is a suffix of the other, and there is at most one pair
    for each suffix of a vocabulary entry that the other vocabulary has, fewer
    than 500,000 for these two whatever the input. Other kinds have no such
    bound and are left to the optimizer.
    """
    pairs = aligned.select(F.explode("links").alias("l")).select("l.*").groupBy("a", "b").agg(F.sum("n").cast("long").alias("pair_count"))
    top = pairs.groupBy("b").agg(F.max("pair_count").alias("top_count"))
    known = pairs.join(top, "b").select("a", "b", "pair_count", (F.col("pair_count") == F.col("top_count")).alias("best"))
    if kind == "end":
        known = F.broadcast(known)
    own = [c for c in aligned.columns if c != "links"]
    rows = aligned.withColumn("row_number", F.monotonically_increasing_id())
    single = rows.select("row_number", *own, F.explode_outer("links").alias("l")).select("row_number", *own, "l.*")
    return (
        single.join(known, ["a", "b"], "left")
        .groupBy("row_number", *own)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).cast("long").alias("n_best"),
            F.coalesce(F.sum(F.col("n") * F.col("pair_count")), F.lit(0)).cast("long").alias("count_sum"),
        )
        .drop("row_number")
    )
