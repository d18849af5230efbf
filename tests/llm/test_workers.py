"""A worker process that goes from one operator's tasks to another's holds nothing of the first."""

import gc
import weakref

import pyarrow as pa

from rulequarry.llm import near_texts, packing, suffix, toxicity


def test_caches_go_with_the_next_operator():
    batch = pa.RecordBatch.from_pydict({"number": [1], "text": [" ".join(f"word{i}" for i in range(2_000))]})
    assert list(near_texts._print_texts([batch])) and len(near_texts._words) == 2_000
    kept = weakref.ref(packing.coder(packing.VOCABULARY, True))
    kept().encode(batch.column("text").to_pylist())
    model = toxicity.fit(["one two", "three"], [1, 0])
    model.score(["four five"])
    words = weakref.ref(model)
    del model
    rows = pa.RecordBatch.from_pydict({"doc": [1], "row": [1], "text": ["a short text " * 30]})
    assert list(suffix._find_units(200, 64, b"")([rows]))
    gone = [kept() is None, words() is None, not near_texts._words, not packing._coders]
    assert list(near_texts._print_texts([batch])) and len(near_texts._words) == 2_000 and not suffix._powers
    gc.collect()
    assert all(gone), gone
