"""Token counts of sections, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import chunks, flat_bytes
from hearthpanel.llm.tokens import encoder

RULES = ("first", "most", "split")
COUNTS = "tokens double, crossing long"


def byte_lengths(name: str) -> np.ndarray:
    """Bytes that each id of a byte-level vocabulary stands for."""
    tokenizer = encoder(name).tokenizer
    return np.array([len(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())], np.int64)


def spans(ids: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of every token: the characters whose bytes it holds, in full or in part."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    character = np.cumsum((data & 0xC0) != 0x80)  # 1-based number of the character a byte belongs to
    return character[starts] - 1, character[ends - 1]


def allocate(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them reach over its edge.

    Sections [first, last) are sorted and disjoint. A token that crosses a
    boundary goes to the section of its first covered character (``first``), to
    the one that covers most of it, the earlier on a tie (``most``), or to all
    in proportion (``split``).
    """
    n = len(first)
    full = last > first
    where = np.flatnonzero(full)
    a, b = first[full], last[full]
    left = np.searchsorted(b, start, side="right")  # first section that ends behind the token's start
    right = np.searchsorted(a, end, side="left")  # first section that starts at the token's end or later
    many = np.maximum(right - left, 0)
    token = np.repeat(np.arange(len(start)), many)
    if not len(token):
        return np.zeros(n), np.zeros(n, np.int64)
    section = np.repeat(left, many) + np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
    shared = np.minimum(end[token], b[section]) - np.maximum(start[token], a[section])
    width = end[token] - start[token]
    crosses = shared < width
    if rule == "split":
        share = shared / np.bincount(token, shared, minlength=len(start))[token]
    else:
        order = np.lexsort((section, -shared if rule == "most" else section, token))
        head = order[np.append(True, token[order][1:] != token[order][:-1])]
        share = np.zeros(len(token))
        share[head] = 1
    counts, over = np.zeros(n), np.zeros(n, np.int64)
    counts[where] = np.bincount(section, share, minlength=len(a))
    over[where] = np.bincount(section, (share > 0) & crosses, minlength=len(a)).astype(np.int64)
    return counts, over


def attribute(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", rule: str = "first", keep: list[str] | None = None) -> DataFrame:
    """One row for each section of each row of (doc_id, text, sections): its name, tokens, and tokens over its edge.

    ``sections`` is an array of (name, first, last) in characters. Each whole
    text is encoded once and its tokens are joined to the sections by position,
    inside the task that holds the text, so nothing is shuffled. Sections that
    overlap or leave the text raise an error. A null text counts as empty, a
    null array as one without sections; an empty section gets a row with 0.
    Repeated rows and null ids are counted each; an empty table gives no row.
    ``doc_tokens`` is the count of the whole text, ``at`` the section's place.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("at", "integer").add("section", "string").add("tokens", "double").add("crossing", "long").add("doc_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = byte_lengths(tokenizer)
        for piece in chunks(batches):
            data, offsets = flat_bytes(piece.column("text"))
            rows: list[tuple] = []
            for i, (ids, sections) in enumerate(zip(encoder(tokenizer).encode(piece.column("text")), piece.column("sections").to_pylist())):
                ids = np.frombuffer(ids, "<u4")
                text = data[offsets[i] : offsets[i + 1]]
                first = np.array([s["first"] for s in sections or ()], np.int64)
                last = np.array([s["last"] for s in sections or ()], np.int64)
                if (first < 0).any() or (last < first).any() or (first[1:] < last[:-1]).any() or (last > np.count_nonzero((text & 0xC0) != 0x80)).any():
                    raise ValueError(f"sections of document {piece.column(keep[0])[i]} overlap or leave the text")
                counts, over = allocate(*spans(ids, lengths, text), first, last, rule)
                rows += [(i, at, s["name"], c, o, len(ids)) for at, (s, c, o) in enumerate(zip(sections or (), counts, over))]
            if rows:
                at = pa.array([r[0] for r in rows])
                types = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(at) for c in keep), *(pa.array(c, t) for c, t in zip(list(zip(*rows))[1:], types))], [*keep, *schema.names[len(keep) :]])

    return docs.select(*dict.fromkeys([*keep, "text", "sections"])).mapInArrow(run, schema)


def record_sections(source: Column, lang: Column, text: Column) -> tuple[Column, Column]:
    """A training record of its fields one after another, and their places: source, lang, first line, other lines."""
    values = [F.concat_ws("", F.lit("source: "), F.coalesce(source, F.lit(""))), F.concat_ws("", F.lit("\nlang: "), F.coalesce(lang, F.lit("")))]
    body = F.coalesce(text, F.lit(""))
    cut = F.locate("\n", body)
    head = F.when(cut > 0, F.substring(body, F.lit(1), cut - 1)).otherwise(body)
    values += [F.concat(F.lit("\n"), head), F.substring(body, F.char_length(head) + 1, F.char_length(body))]
    sections, first = [], F.lit(0)
    for name, value in zip(("source", "lang", "head", "body"), values):
        last = first + F.char_length(value)
        sections.append(F.struct(F.lit(name).alias("name"), first.cast("long").alias("first"), last.cast("long").alias("last")))
        first = last
    return F.concat(*values), F.array(*sections)
