"""Packing encodes texts in runs that are small beside an executor's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from helix.llm import words as W
from helix.llm.pack import token_pieces
from helix.llm.queries import tokenizer_path
from helix.llm.tokens import encoder


def test_runs_of_texts_take_less_memory(monkeypatch, spark):
    """The arrays of hashes over a run are many times its bytes: runs of 1 MB, where 4 MB took the pipeline's packing over its executor's memory."""
    limits = []
    over = W.chunks
    monkeypatch.setattr(W, "chunks", lambda column, limit=1 << 18: limits.append(limit) or over(column, limit))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.setdefault("run", f), raising=False)
    token_pieces(docs, tokenizer_path(), 1024, 2, "doc_id", "text")
    monkeypatch.setattr("helix.llm.pack.TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)})())}))
    words = np.random.default_rng(1).integers(0, 2000, (100, 8000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([" ".join(f"w{x}" for x in row) for row in words])], ["doc_id", "text"])
    encoder(tokenizer_path()).encode(np.frombuffer(b"a", np.uint8), np.array([0, 1]))
    tracemalloc.start()
    pieces = sum(b.num_rows for b in seen["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert limits == [1 << 20] and pieces > 100
    assert peak < 150 << 20, peak


def test_a_worker_drops_the_tokenizer_when_it_packs_no_more():
    """The pipeline's other stages were stopped over an executor's memory after packing, as each worker still held a tokenizer and its pieces."""
    held = encoder(tokenizer_path())
    assert list(W.releasing(lambda batches: batches, keeps=True)(iter([1]))) == [1] and encoder(tokenizer_path()) is held
    assert list(W.releasing(lambda batches: batches)(iter([1]))) == [1] and not W.KEPT
