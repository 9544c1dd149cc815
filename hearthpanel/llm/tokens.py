"""Exact ids of whole texts with a memory of pieces in front of the tokenizers library.

Both vocabularies cut a text into pieces by a pattern before they merge, and no
piece reaches over a lone space or line end. So a text of plain characters and
plain spacing is cut there, its distinct pieces are looked up, new ones are
encoded by the library once, and ids are gathered by numpy. Any other text goes
to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from hearthpanel.llm.common import flat_bytes, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core

# Bytes of plain texts: printable ASCII, line ends, and the two-byte letters from U+00C0 to U+00FF. Every Unicode
# version treats these alike and no normal form changes them.
PLAIN = np.zeros(256, bool)
PLAIN[[0x0A, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3]] = True
GAP = np.zeros(256, bool)
GAP[[0x0A, 0x20]] = True
#: Pieces remembered in each of two generations, about 100 MB a worker.
REMEMBERED = 400_000


class Memory:
    """Ids of pieces in two generations; a look-up asks ``learn`` once for all that neither holds."""

    def __init__(self, learn):
        self.learn = learn
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, pieces))
        late = [i for i, ids in enumerate(found) if ids is None]
        if not late:
            return found
        fresh = []
        for i in late:
            found[i] = self.old.get(pieces[i])
            if found[i] is None:
                fresh.append(i)
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            for i, ids in zip(some, self.learn([pieces[i] for i in some])):
                found[i] = ids
        if len(self.new) + len(late) > REMEMBERED:
            self.old, self.new = self.new, {}
        self.new.update((pieces[i], found[i]) for i in late)
        return found


def plain_rows(data: np.ndarray, offsets: np.ndarray, *, spacing: bool = True) -> np.ndarray:
    """Rows that may be cut: plain characters only and, with ``spacing``, no white space that the byte-level pattern looks ahead over."""
    odd = [np.flatnonzero(~PLAIN[data])]
    if spacing and len(data):
        gap = GAP[data]
        pair = np.flatnonzero(gap[1:] & gap[:-1])
        line = data[pair] + data[pair + 1] == 20
        third = np.minimum(pair + 2, len(data) - 1)
        odd.append(pair[~line | gap[third]])
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        odd.append(last[gap[last]])
    plain = np.ones(len(offsets) - 1, bool)
    plain[np.searchsorted(offsets, np.concatenate(odd), side="right") - 1] = False
    return plain


def piece_starts(data: np.ndarray, offsets: np.ndarray, *, words: bool = False) -> np.ndarray:
    """Where pieces start: at rows, before spaces and around line ends, or, for ``words``, at words (gaps end the piece before)."""
    gap = GAP[data]
    first = np.zeros(len(data), bool)
    if words:
        first[1:] = gap[:-1] & ~gap[1:]
    else:
        first |= gap
        first[1:] |= data[:-1] == 0x0A
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(first)


def distinct_pieces(data: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A code for each kept piece and the distinct pieces behind the codes."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    if not keep.all():
        pieces = pieces.filter(pa.array(keep))
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def ids_of_pieces(codes: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and how many each piece has."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    table = np.frombuffer(b"".join(ids), "<u4")
    counts = sizes[codes]
    return table[spread((np.cumsum(sizes) - sizes)[codes], counts)], counts


def merged_rows(plain: np.ndarray, row: np.ndarray, ids: np.ndarray, counts: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in order, and where each row starts: pieces of plain rows by their ``row``, and the ``others`` whole."""
    sizes = np.bincount(row, counts, len(plain)).astype(np.int64)
    if others:
        sizes[~plain] = [len(o) for o in others]
        mine = np.repeat(plain, sizes)
        both = np.empty(len(mine), "<u4")
        both[mine] = ids
        both[~mine] = np.concatenate(others)
        ids = both
    return ids, np.append(0, np.cumsum(sizes))


class Encoder:
    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.words = name.startswith("word_")
        self.memory = Memory(self._learn)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that an id of a plain text stands for
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token) - 4 * token.endswith("</w>")

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Encode many pieces as one text and share its ids out by the bytes that each id stands for."""
        if self.words:
            pieces = [p.strip(b" \n") for p in pieces]
            spaced = [i for i, p in enumerate(pieces) if p]
        else:
            spaced = [i for i, p in enumerate(pieces) if p[0] == 0x20]
        found = [b""] * len(pieces)
        if not self.words and len(spaced) < len(pieces):
            other = [i for i, p in enumerate(pieces) if p[0] != 0x20]
            for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False)):
                found[i] = np.array(e.ids, "<u4").tobytes()
        if spaced:
            mine = [pieces[i] for i in spaced]
            whole = self.tokenizer.encode_batch_fast([(b" " if self.words else b"").join(mine).decode()], add_special_tokens=False)
            ids = np.array(whole[0].ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, mine), np.int64, len(mine)))
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            flat, start = ids.tobytes(), 0
            for i, end in zip(spaced, cuts.tolist()):
                found[i] = flat[start:end]
                start = end
        return found

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text starts; null counts as empty."""
        data, offsets = flat_bytes(column)
        plain = plain_rows(data, offsets, spacing=not self.words)
        starts = piece_starts(data, offsets, words=self.words)
        row = np.searchsorted(offsets, starts, side="right") - 1
        keep = plain[row]
        codes, pieces = distinct_pieces(data, starts, keep)
        ids, counts = ids_of_pieces(codes, self.memory.ids(pieces))
        rest = column.filter(pa.array(~plain)).to_pylist() if not plain.all() else []
        others = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        return merged_rows(plain, row[keep], ids, counts, others)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of every text of a column as little-endian unsigned 32-bit integers; null counts as empty."""
        ids, at = self.flat(column)
        data, at = ids.tobytes(), (at * 4).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
