"""Smallest ids of components of SimHash fingerprints: rows without an id, and the rows of a component's root."""

from motionlake.llm import simhash


def test_a_null_id_is_not_the_smallest(spark):
    rows = [(7, ""), (None, " \n"), (3, None), (None, "alone of its kind, without an id"), (-(1 << 63), "the least of all ids"), (9, "the least of all ids")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(7, 3), (None, 3), (3, 3), (None, None), (-(1 << 63), -(1 << 63)), (9, -(1 << 63))], key=str)


def test_the_root_of_linked_fingerprints_counts(spark):
    # 1 and 3 are linked; the least fingerprint, the root, has the smallest id, or the largest
    for ids in ((4, 5, 6), (6, 5, 4)):
        prints = spark.createDataFrame(list(zip(ids, (1, 3, 1023 << 20 | 7), strict=True)), "doc_id long, fp long")
        got = {r["_fp"]: r.component_id for r in simhash.classes(prints).collect()}
        assert got == {1: min(ids[:2]), 3: min(ids[:2])}
