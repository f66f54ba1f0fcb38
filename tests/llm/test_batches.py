"""Tasks of the radix sort give out their records in batches of bounded size, however many rows Arrow hands them at once."""

import numpy as np
import pyarrow as pa

from loopwright.llm import suffixes


class Handed:
    """Stands for a table: gives the function that its batches would go through."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_batches_of_windows_are_bounded_and_whole():
    draw = np.random.default_rng(4)
    texts = ["".join(map(chr, draw.integers(97, 123, n))) for n in [4000] * 500 + [0, 250, 199, 300_000]]
    wanted = [[{"start": 0, "n": len(t) - 199, "word": k, "alone": True}] if len(t) >= 200 else [] for k, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("word", pa.int64()), ("alone", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts), pa.array(wanted, kind)], names=["doc_id", "h", "text", "wanted"])
    run = suffixes._last_digits(Handed(), 200)
    out = list(run(iter([batch.slice(3), batch.slice(0, 3)])))
    assert max(b.num_rows for b in out) <= suffixes.SLICE
    got = {(d, s): w for b in out for d, s, w in zip(*(b.column(k).to_pylist() for k in (0, 2, 4)))}
    whole = {(k, s) for k, t in enumerate(texts) for s in range(len(t) - 199)}
    assert set(got) == whole and sum(b.num_rows for b in out) == len(whole)
    alone = next(run(iter([batch.slice(len(texts) - 1)])))
    assert {(d, s): w for d, s, w in zip(*(alone.column(k).to_pylist() for k in (0, 2, 4)))}.items() <= got.items()
