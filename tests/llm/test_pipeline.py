"""The pipeline's stages, one after another, against brute force."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from motionlake.llm import shingle_join, token_output

from tests.llm.test_operators import WORD, hits, re, rule_counts, targets


def brute(rows):
    """Ids kept: the smallest of each set that pairs of Jaccard similarity 0.8 or more connect."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = {}
    for i, (d, _) in enumerate(rows):
        kept[find(i)] = min(kept.get(find(i), d), d)
    return sorted(kept.values())


def near_copies():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 160))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    line = [rng.choice(words) for _ in range(12)]
    texts += [line + [rng.choice(words) for _ in range(60)] for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate([*(" ".join(t) for t in texts), None, "", " \t", "A b", "a  B", "a b c"]))


def test_near_duplicates_reach_a_similarity_of_four_fifths(spark, monkeypatch):
    rows = near_copies()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for common in (50_000, 0):
        monkeypatch.setattr(shingle_join, "COMMON", common)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_near_duplicates_keep_one_row(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "a b c d e f"), (None, "g h i j k l"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == Counter(rows[1:4])
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


def corpus():
    """Good, short, repetitive, copied, contaminated and odd rows."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.randrange(50, 120)), f"s{k % 3}" if k % 7 else None) for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 4)]
    rows += [(300 + k, rows[k][1].replace(" ", "  ", 3) + " more", "s1") for k in range(1, 40, 4)]
    rows += [(400 + k, text(5), "s0") for k in range(10)] + [(500 + k, "a b c d " * 30, "s2") for k in range(3)]
    rows += [(600 + k, f"{text(40)} The Answer is in this Passage of ten words that leaks, {text(30)}", "s1") for k in range(8)]
    rows += [(700, None, "s0"), (701, "", None), (702, " \t\n", "s1"), (None, text(70), "s0"), (None, text(60), None), (5, rows[5][1], rows[5][2]), (9, text(80), "s2"), (704, text(3000), "s2")]
    return rows


BENCH = [(1, "the answer is in this passage of ten words that leaks"), (2, None), (3, "zq " * 3)]


def test_run_is_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS _rate", "text AS row", "1 AS hits", "2 AS mix").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def plain(df):
        return Counter((r.doc_id, r.text, r.source) for r in df.collect())

    # quality rules: no host fails as a whole here
    n = {r: rule_counts(r[1]) for r in rows}
    want = Counter(r for r in rows if n[r][0] >= 50 and 100 * n[r][4] <= 50 * n[r][0])
    docs = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert plain(docs) == want
    # near-duplicates: by place, so that rows that share an id are told apart
    listed = sorted(want.elements(), key=lambda r: (r[0] is not None, r[0] or 0))
    kept = [listed[k] for k in brute([(k, r[1]) for k, r in enumerate(listed)])]
    docs = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert plain(docs) == Counter(kept)
    clean = [r for r, h in zip(kept, hits([(k, r[1]) for k, r in enumerate(kept)], BENCH), strict=True) if not h[5]]
    docs = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert plain(docs) == Counter(clean) and len(clean) < len(kept)
    docs = corpus_pipeline.mix(spark, docs, str(tmp_path))
    mixed = plain(docs)
    size = lambda t: len(re.findall(WORD, t or ""))
    by, taken = {}, {}
    for r in clean:
        by[r[2]] = by.get(r[2], 0) + size(r[1])
    for r, k in mixed.items():
        assert r in clean and k <= 2
        taken[r[2]] = taken.get(r[2], 0) + k * size(r[1])
    assert all(abs(taken[s] - t) <= 60 for s, t in targets(by).items())
    words = token_output.Words(token_output.tokenizer_path())
    out = sorted(corpus_pipeline.token_ids(spark, docs, str(tmp_path)).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, t, _) in zip(out, sorted(mixed.elements(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert (r.doc_id, r.start) == (d, at)
        at += r.n_tokens
        if d is not None and d != 9:
            ids = np.array([*words.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, out))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
