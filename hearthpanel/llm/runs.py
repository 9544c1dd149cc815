"""Periodic runs of words in documents by an enhanced suffix array and the branching-tandem test.

A run of period p ends in a square, two equal halves of p words, that cannot be
moved one word to the right. The suffixes at its two halves share exactly p
words, so they part at an LCP interval of depth p. Intervals are visited by
their borders in the LCP array; suffixes on the smaller side of a border ask by
the inverse suffix array whether the suffix ``depth`` words before or after
them lies on the other side. Each hit is such a square; rotating it to the left
gives the run, and squares of several periods merge into one run by its place.

The arrays are built for many documents at once: words of different documents
are different symbols and every document has an end of its own, so no interval
ever crosses documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearthpanel.llm.common import chunks, flat_bytes, spread
from hearthpanel.llm.textbytes import words

#: Least words, and least length in periods, of a run.
LEAST = 24
POWER = 3
#: Bytes of text whose words are sorted at a time.
PIECE = 1 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixArray(NamedTuple):
    """Suffixes in order, each one's place, shared words with the one before, and ranks by their first 1, 2, 4, ... words."""

    order: np.ndarray
    place: np.ndarray
    lcp: np.ndarray
    levels: list[np.ndarray]


def suffix_array(symbols: np.ndarray) -> SuffixArray:
    """Enhanced suffix array by prefix doubling; only suffixes that are not alone yet are sorted again.

    Every sequence in ``symbols`` must end with a symbol of its own.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    heads = np.ones(n, bool)
    heads[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels = [rank]
    width = 1
    alone = heads & np.append(heads[1:], True)
    open_at = np.flatnonzero(~alone)  # places in ``order`` whose suffix shares its rank
    while len(open_at):
        rank = levels[-1]
        suffix = order[open_at]
        group, later = rank[suffix], rank[suffix + width]  # an end symbol is unique, so the suffix reaches that far
        key = group.astype(np.int64) * n + later
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        order[open_at] = suffix[turn]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        # A rank is the first place of its group; places of a group stay together.
        fresh = rank.copy()
        fresh[order[open_at]] = open_at[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        levels.append(fresh)
        open_at = open_at[~(first & np.append(first[1:], True))]
        width *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)

    lcp = np.zeros(n, np.int32)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1], order[pairs]
    shared = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        shared += (levels[level][a + shared] == levels[level][b + shared]).astype(np.int64) << level
    lcp[pairs] = shared
    return SuffixArray(order, place, lcp, levels)


def smaller_before(values: np.ndarray, *, equal: bool) -> np.ndarray:
    """For each entry the last one before it that is smaller (or equal, with ``equal``), or -1.

    Entries jump over what others have passed; the few chains that stay long are walked one by one.
    """
    n = len(values)
    found = np.arange(-1, n - 1)
    stays = (lambda v, at: v[at] > values[todo]) if equal else (lambda v, at: v[at] >= values[todo])
    todo = np.arange(n)
    for _ in range(64):
        at = found[todo]
        live = at >= 0
        todo, at = todo[live], at[live]
        todo = todo[stays(values, at)]
        if not len(todo):
            return found
        found[todo] = found[found[todo]]
    v, f = values.tolist(), found.tolist()
    for i in todo.tolist():
        at, mine = f[i], v[i]
        while at >= 0 and (v[at] > mine or (not equal and v[at] == mine)):
            at = f[at]
        f[i] = at
    return np.array(f)


def squares(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that cannot move to the right, from the smaller sides of all LCP borders."""
    border = np.flatnonzero(array.lcp > 0)
    # Borders of different documents or first words have a zero between them, so stretches of borders are cut there.
    if not len(border):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.append(True, border[1:] != border[:-1] + 1)
    at = np.arange(len(border)) + np.cumsum(gap)  # one zero before each stretch
    values = np.zeros(at[-1] + 2, np.int32)
    values[at] = array.lcp[border]
    low = smaller_before(values, equal=False)[at]
    high = (len(values) - 1 - smaller_before(values[::-1], equal=True)[::-1])[at]
    # Suffixes before the border from ``left`` on, and after it up to ``right``.
    left = border - (at - low)
    right = border + (high - at) - 1
    depth = array.lcp[border].astype(np.int64)
    before = border - left <= right - border + 1
    first = np.where(before, left, border)
    count = np.where(before, border - left, right - border + 1)
    other_first = np.where(before, border, left)
    other_last = np.where(before, right, border - 1)
    starts, periods = [], []
    for some in np.array_split(np.arange(len(border)), max(1, int(count.sum()) >> 21)):
        which = np.repeat(some, count[some])
        suffix = array.order[spread(first[some], count[some])].astype(np.int64)
        for step in (1, -1):
            mate = suffix + step * depth[which]
            inside = (mate >= 0) & (mate < len(array.place))
            seat = array.place[np.where(inside, mate, 0)]
            hit = inside & (seat >= other_first[which]) & (seat <= other_last[which])
            starts.append(np.minimum(suffix[hit], mate[hit]))
            periods.append(depth[which[hit]])
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(symbols: np.ndarray, *, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of at least ``least`` symbols and ``power`` periods, in order of starts."""
    array = suffix_array(symbols)
    start, period = squares(array)
    end = start + 2 * period
    # Rotate to the left: the symbols before the two halves stay equal over the longest of the known widths.
    for level in range(len(array.levels) - 1, -1, -1):
        ranks, width = array.levels[level], 1 << level
        back = start - width
        same = (back >= 0) & (ranks[np.maximum(back, 0)] == ranks[np.maximum(back, 0) + period])
        start = np.where(same, back, start)
    length = end - start
    keep = (length >= least) & (length >= power * period)
    start, length, period = start[keep], length[keep], period[keep]
    # Squares of a multiple of the period end the same run: the smallest period stays.
    turn = np.lexsort((period, length, start))
    start, length, period = start[turn], length[turn], period[turn]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[fresh], length[fresh], period[fresh]


def collapse(docs: DataFrame, *, least: int = LEAST, power: int = POWER, repeat_share: int | None = None) -> DataFrame:
    """Runs of words of every whole text of (doc_id, text), and the text without their repeats.

    Returns doc_id, n_words, runs (start word, length and smallest period, in
    order of start and period) and collapsed: the words that no run holds
    after its first period, joined by one space.

    ``repeat_share``, for trials, first plants repeats: where the crc32 of the
    id is divisible by it, the words from one place on become copies of a few.

    Null and empty texts have no words, no runs and an empty text; a null
    doc_id is kept and plants nothing; rows that repeat an id are judged each;
    an empty table gives no row; other columns are not read. A text stays in
    one task and takes about 100 bytes a word, 4 more for each doubling of its
    longest repeat; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, limit=PIECE):
            yield _collapsed(piece.column("doc_id"), piece.column("text"), least, power, repeat_share)

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def planted(n: int, key: int) -> tuple[int, int]:
    """From which word on, and by how many words, a text of ``n`` words repeats."""
    g = key // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _collapsed(ids: pa.Array, texts: pa.Array, least: int, power: int, repeat_share: int | None) -> pa.RecordBatch:
    data, offsets = flat_bytes(texts)
    rows = len(ids)
    begin, end, row = words(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 3
    size = end - begin
    count = np.bincount(row, minlength=rows)
    base = np.append(0, np.cumsum(count))
    flat = np.ascontiguousarray(data[spread(begin, size)])
    bounds = np.append(0, np.cumsum(size)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
    code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    source = np.arange(len(code))  # the word that stands at each place
    if repeat_share:
        for r, i in enumerate(ids.to_pylist()):
            key = zlib.crc32(str(i).encode()) if i is not None else 1
            if key % repeat_share == 0 and count[r]:
                a, p = planted(int(count[r]), key)
                tail = np.arange(count[r] - a)
                source[base[r] + a : base[r + 1]] = base[r] + a + tail % p
    # One symbol for each word of each document, and one for each document's end.
    kinds = int(code.max(initial=0)) + 2
    place = np.arange(len(code)) + row
    symbols = np.empty(len(code) + rows, np.int64)
    symbols[place] = row * kinds + code[source]
    symbols[base[1:] + np.arange(rows)] = np.arange(rows) * kinds + kinds - 1
    start, length, period = find_runs(symbols, least=least, power=power)
    owner = np.searchsorted(base[1:] + np.arange(rows), start, side="right")  # runs never hold an end
    first = start - owner

    marks = np.zeros(len(code) + 1, np.int64)
    np.add.at(marks, first + period, 1)
    np.add.at(marks, first + length, -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    # Every kept word with a space behind it, but for the last of a row.
    taken = source[kept]
    wide = size[taken] + 1
    per_row = np.bincount(row[kept], minlength=rows)
    lasts = np.cumsum(per_row)[per_row > 0] - 1
    stops = np.cumsum(wide)
    out = np.full(int(wide.sum()), 0x20, np.uint8)
    out[spread(stops - wide, size[taken])] = flat[spread(bounds[taken], size[taken])]
    solid = np.ones(len(out), bool)
    solid[stops[lasts] - 1] = False
    out = out[solid]
    per_byte = np.bincount(row[kept], wide, rows).astype(np.int64) - (per_row > 0)
    text_at = np.append(0, np.cumsum(per_byte)).astype(np.int32)

    turn = np.lexsort((period, first, owner))
    run_at = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    structs = pa.StructArray.from_arrays(
        [pa.array((first - base[owner])[turn], pa.int64()), pa.array(length[turn], pa.int64()), pa.array(period[turn], pa.int64())],
        ["start", "length", "period"],
    )
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(count, pa.int64()),
            pa.ListArray.from_arrays(pa.array(run_at), structs),
            pa.StringArray.from_buffers(rows, pa.py_buffer(text_at), pa.py_buffer(np.ascontiguousarray(out))),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )
