"""Pieces of record batches."""

import pyarrow as pa

from hearthpanel.llm.common import chunks, flat_bytes


def test_pieces_of_pieces_hold_every_row_once():
    texts = ["a" * n if n % 7 else None for n in range(60)] + ["é" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(61)), pa.array(texts)], ["id", "text"])
    seen, said = [], []
    for piece in chunks([batch], limit=200):
        for part in chunks([piece], limit=50):
            data, offsets = flat_bytes(part.column("text"))
            seen += part.column("id").to_pylist()
            said += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert seen == list(range(61)) and said == [t or "" for t in texts]
