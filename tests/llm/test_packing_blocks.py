"""Texts are encoded a bounded number of bytes at a time, whatever the size of the batch."""

import pyarrow as pa

from millrace.llm import packing
from millrace.llm.queries import TOKENIZER


def test_a_batch_is_encoded_in_blocks(monkeypatch):
    texts = [("some words and é " * (i % 40))[:-1] if i % 9 else None for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(["a", None] * 200), pa.array(texts)], ["doc_id", "source", "text"])

    def rows(block):
        monkeypatch.setattr(packing, "_BLOCK", block)
        out = list(packing._pieced(TOKENIZER, 32, 2)(iter([batch.slice(3), batch.slice(0, 3)])))
        return max(b.num_rows for b in out), [r for b in out for r in b.to_pylist()]

    most, whole = rows(1 << 20)
    few, parts = rows(2000)
    assert parts == whole and [r["doc_id"] for r in whole] == [*range(3, 400), 0, 1, 2]
    assert most == 397 and few < 60
