"""Pairs of long texts: parities as wide as they are, and candidates under the first common shingle alone."""

import random

import numpy as np
import pyarrow as pa
from motionlake.llm import shingle_join as s

from tests.llm.test_pipeline import brute


def rows_of(texts):
    none = np.zeros(0, np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["node", "text"])
    (made,) = s._prefixes(iter([batch]), none, none)
    return made


def test_long_texts_that_share_a_shingle_make_no_rows(monkeypatch):
    words = [[f"w{k}x{i}" for i in range(2000 + 40 * (k % 3))] for k in range(40)]
    words[7] = [*words[31][:1990], "other", "end"]
    texts = ["a b c d e " + " ".join(w) for w in words]
    made = rows_of(texts)
    order = pa.array(np.lexsort((made.column("node").to_numpy(), made.column("n").to_numpy())))
    node, n, marks = (made.column(c).take(order) for c in ("node", "n", "marks"))
    count = len(texts)
    bucket = pa.RecordBatch.from_arrays([pa.array(np.zeros(count, np.int64)), node, n, pa.array(np.zeros(count, np.int32)), pa.nulls(count, pa.int64()), marks], names=["h", "node", "n", "pos", "root", "marks"])
    for parts in ([bucket], [bucket.slice(0, 15), bucket.slice(15)]):
        for rows in (s.ROWS, 4):
            monkeypatch.setattr(s, "ROWS", rows)
            assert [(a, b) for out in s._bucket_pairs(iter(parts), "rest") for a, b in zip(*(c.to_pylist() for c in out.columns))] == [(7, 31)]


def test_parities_of_unlike_widths_are_folded():
    rng = np.random.default_rng(5)
    hashes = [np.unique(rng.integers(0, 1 << 62, n)) for n in (100, 600, 1200, 5000, 20_000)]
    parity = lambda h, bits: np.bincount(h & (bits - 1), minlength=bits) & 1
    bits = [512, 1024, 2048, 8192, 8192]
    packed = [np.packbits(parity(h, b).astype(np.uint8), bitorder="little").view("<u8") for h, b in zip(hashes, bits, strict=True)]
    longs = np.array([len(x) for x in packed])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(5)))
    want = [int((parity(hashes[a], min(bits[a], bits[b])) != parity(hashes[b], min(bits[a], bits[b]))).sum()) for a, b in zip(i, j, strict=True)]
    assert s._apart(np.concatenate(packed), np.cumsum(longs) - longs, longs, i, j).tolist() == want


def test_pairs_meet_under_their_first_common_shingle():
    rng = random.Random(3)
    base = [f"w{k}" for k in range(900)]
    copy = list(base)
    for k in range(4):
        copy[rng.randrange(900)] = f"x{k}"
    made = rows_of([" ".join(base), " ".join(copy)])
    places = [{h: p for p, h in enumerate(x)} for x in made.column("hs").to_pylist()]
    n = made.column("n").to_numpy().astype(np.int64)
    common = [(places[0][h], places[1][h]) for h in places[0].keys() & places[1].keys()]
    ok = [bool(s._possible(n, np.array(p), np.array([0]), np.array([1]))[0]) for p in common]
    # the first is looked at, those in the later half of the prefix aren't
    assert ok[common.index(min(common))] and 0 < sum(ok) < 0.7 * len(ok)


def test_long_near_copies_are_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for size in (508, 516, 530, 1020, 1030, 1090, 2060):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        for cut, changes in ((0, 0), (0, 8), (12, 3), (size // 10, 0), (size // 5, 4), (0, 25), (0, 40)):
            text = base[: size - cut]
            for _ in range(changes):
                text[rng.randrange(len(text))] = f"u{rng.randrange(10**6)}"
            rows.append(" ".join(["the same five words begin", *text]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for small in (16, 3):
        monkeypatch.setattr(s, "SMALL", small)
        assert sorted(r.doc_id for r in s.deduplicate(docs).collect()) == brute(rows)
