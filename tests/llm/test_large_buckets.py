"""Pairs of a large bucket that the parities rule out get no row."""

import numpy as np
import pyarrow as pa
from motionlake.llm import shingle_join as s


def test_a_common_shingle_makes_no_rows_for_unlike_texts():
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(300)]
    words[7] = [*words[250][:58], "other", "end"]
    words[8] = words[251][:57]
    texts = ["a b c d e " + " ".join(w) for w in words]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["node", "text"])
    none = np.zeros(0, np.int64)
    (made,) = s._prefixes(iter([rows]), none, none, True)
    order = pa.array(np.lexsort((made.column("node").to_numpy(), made.column("n").to_numpy())))
    node, n, marks = (made.column(c).take(order) for c in ("node", "n", "marks"))
    count = len(texts)
    bucket = pa.RecordBatch.from_arrays([pa.array(np.zeros(count, np.int64)), node, n, pa.array(np.zeros(count, np.int32)), pa.nulls(count, pa.int64()), marks], names=["h", "node", "n", "pos", "root", "marks"])
    for parts in ([bucket], [bucket.slice(0, 100), bucket.slice(100)]):
        got = [(a, b) for out in s._bucket_pairs(iter(parts), "rest") for a, b in zip(*(c.to_pylist() for c in out.columns))]
        sets = [s.shingles(t) for t in texts]
        similar = {(a, b) for a in range(count) for b in range(a + 1, count) if s.similar(sets[a], sets[b])}
        assert similar == {(7, 250), (8, 251)} <= set(got) and len(got) < count
