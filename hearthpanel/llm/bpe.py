"""Byte-level BPE without merging: longest token matches, a pair-compatibility table and backtracking; decoding by offsets.

A token sequence is what BPE gives if and only if each token is what BPE gives
for its own bytes and every two neighbours are compatible, that is, no merge
ever fires across their border. So a text is walked from left to right with the
longest token at each place, as an Aho-Corasick automaton reports them, falling
back to shorter ones and to earlier places where a neighbour does not fit. The
encoding of a prefix is unique, so a place that failed once is never entered
again, and the work is linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hearthpanel.llm.common import chunks, flat_bytes, spread
from hearthpanel.llm.tokens import Memory, distinct_pieces, ids_of_pieces, merged_rows, piece_starts, plain_rows

VOCABULARY = "byte_bpe_50k.json"
#: Pieces of the vocabulary's pattern, on texts whose characters every Unicode version treats alike.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Answers kept in the pair table of a worker, about 200 MB; a full table starts anew.
PAIRS = 1 << 20
NEVER = 1 << 60
CODED = "doc_id long, ids binary, decoded string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Coder:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        tokens = {t: bytes(letters[c] for c in t) for t in file["model"]["vocab"]}
        ids = file["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        self.library = Tokenizer.from_file(path)  # its cutting only, for texts that are not plain
        size = 1 + max([*ids.values(), *self.special.values()])

        # The offset table: bytes of token i lie at at[i] to at[i + 1].
        table = [b""] * size
        for t, i in ids.items():
            table[i] = tokens[t]
        for t, i in self.special.items():
            table[i] = t
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.fromiter(map(len, table), np.int64, size)
        self.at = np.append(0, np.cumsum(self.size))

        # A token comes into being at the rank of its merge and has one way to be made.
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = {ids[t]: -1 for t in ids if len(tokens[t]) == 1}
        for rank, (left, right) in enumerate(file["model"]["merges"]):
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.merge[pair] = rank
            if made not in self.born:
                self.born[made], self.parts[made] = rank, pair
        self.fits: dict[tuple[int, int], bool] = {}
        self.sides: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}

        # Only tokens that BPE makes of their own bytes can stand in an encoding.
        automaton = ahocorasick.Automaton()
        self.length = self.size.tolist()
        whole = {i for i in self.born if i not in self.parts}
        for i, pair in self.parts.items():  # in the order of their ranks
            if whole.issuperset(pair) and self.crossing(*pair) == [self.born[i]]:
                whole.add(i)
        usable = sorted(whole, key=self.length.__getitem__)
        by_bytes: dict[bytes, int] = {}
        self.shorter: dict[int, int] = {}  # the longest usable token that a token begins with
        for i in usable:
            token = table[i]
            self.shorter[i] = next((by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_bytes), -1)
            by_bytes[token] = i
            automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self.memory = Memory(self._learn)

    def _side(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """Symbols at one border of a token while it is merged: (symbol, rank that makes it, rank that uses it up)."""
        if (found := self.sides.get((token, right))) is None:
            found, used = [], NEVER
            while True:
                found.append((token, self.born[token], used))
                if token not in self.parts:
                    break
                used, token = self.born[token], self.parts[token][right]
            self.sides[found[0][0], right] = found
        return found

    def crossing(self, a: int, b: int) -> list[int]:
        """Ranks of the merges that could fire over the border between two tokens, the latest first.

        Ranks only rise while a text is merged, so the symbols beside the
        border at the time of a rank are known from either token alone. A
        merge over the border fires if both of its symbols are there at its
        rank. One that the left token uses up at that very rank goes first,
        being further left; one that the right token does comes too late.
        """
        ranks = []
        left, right = self._side(a, True), self._side(b, False)
        i = j = 0
        while i < len(left) and j < len(right):
            (x, x_born, x_used), (y, y_born, y_used) = left[i], right[j]
            rank = self.merge.get((x, y))
            if rank is not None and max(x_born, y_born) < rank < x_used and rank <= y_used:
                ranks.append(rank)
            if x_born >= y_born:  # step back to the time before the later of the two was made
                i += 1
            if y_born >= x_born:
                j += 1
        return ranks

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between two tokens alone. Answers are kept: this is the pair table."""
        fits = self.fits.get((a, b))
        if fits is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            fits = self.fits[a, b] = not self.crossing(a, b)
        return fits

    def piece(self, data: bytes) -> list[int]:
        """Ids of a piece that the vocabulary's pattern has cut; merges never leave it."""
        end = len(data)
        longest = [-1] * end
        for last, token in self.automaton.iter(data.decode("latin-1")):  # by their ends, so later ones are longer
            longest[last + 1 - self.length[token]] = token
        path: list[int] = []
        failed = bytearray(end + 1)
        place, token = 0, longest[0] if end else -1
        while place < end:
            after = place + self.length[token]
            if not failed[after] and (not path or self.compatible(path[-1], token)):
                path.append(token)
                place = after
                if place < end:
                    token = longest[place]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: give the place up and shorten the token before it
                failed[place] = 1
                token = path.pop()
                place -= self.length[token]
                token = self.shorter[token]
        return path

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        found = []
        for text in pieces:
            ids = [i for p in PIECE.findall(text.decode()) for i in self.piece(p.encode())]
            found.append(np.array(ids, "<u4").tobytes())
        return found

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text of any characters: special strings first, then the library's cutting, then pieces."""
        ids: list[int] = []
        parts = [text]
        if self.special:
            parts = regex.split("(" + "|".join(regex.escape(s.decode()) for s in self.special) + ")", text)
        for part in parts:
            if (i := self.special.get(part.encode())) is not None:
                ids.append(i)
            elif part:
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                    ids += self.piece(part[a:b].encode())
        return np.array(ids, "<u4")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text starts; null counts as empty."""
        data, offsets = flat_bytes(column)
        plain = plain_rows(data, offsets)
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                plain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = raw.find(special, at + 1)
        starts = piece_starts(data, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        keep = plain[row]
        codes, pieces = distinct_pieces(data, starts, keep)
        ids, counts = ids_of_pieces(codes, self.memory.ids(pieces))
        others = [self._whole(t or "") for t in column.filter(pa.array(~plain)).to_pylist()] if not plain.all() else []
        return merged_rows(plain, row[keep], ids, counts, others)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and where each starts, from ids and where each text's ids start; unknown ids are skipped."""
        known = ids < len(self.size)
        ids = np.where(known, ids, 0)
        sizes = self.size[ids] * known
        ends = np.append(0, np.cumsum(sizes))
        return self.table[spread(self.at[ids], sizes)], ends[at]


_CODERS: dict[str, Coder] = {}


def coder(name: str) -> Coder:
    """One coder for each vocabulary and Python worker."""
    if name not in _CODERS:
        _CODERS[name] = Coder(name)
    return _CODERS[name]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A text column of bytes; rows that are no UTF-8 get replacement characters, as the library's decoder gives."""
    column = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode(errors="replace") for t in column.to_pylist()], pa.string())


def code(docs: DataFrame, *, tokenizer: str = VOCABULARY) -> DataFrame:
    """Ids of every whole text of (doc_id, text), and the text that they decode to.

    Returns doc_id, ids (little-endian unsigned 32-bit integers) and decoded.
    Strings of special tokens become their ids, as in the library's defaults.
    Null and empty texts give no ids and an empty text; a null doc_id and rows
    that repeat an id give a row each; an empty table gives none; other columns
    are not read. A text is one row of one task and needs about 40 bytes of
    memory a byte; nothing is shuffled, and a lost task runs again by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            ids, at = coder(tokenizer).encode(piece.column("text"))
            packed = pa.BinaryArray.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), packed, texts_of(*coder(tokenizer).decode(ids, at))], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, CODED)
