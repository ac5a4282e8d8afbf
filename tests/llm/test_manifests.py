"""Fingerprints, the Merkle manifest and the prefix trie against brute-force versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash
from motionlake.llm import fingerprints, merkle, ordering, prefix_trie
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, id long, pos long, fp long, `a.b` string"
TURNS = "conv_id long, turn long, role string, text string, depth long, id long, x long, `a.b` string"


def documents(spark, rows):
    """rows of (doc_id, text, lang), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, g, "s", None if t is None else len(t), 1, 2, 3, 4, "z") for d, t, g in rows], DOCS)


def odd_documents(rng):
    texts = [None, "", " \t\n", "a", "SHOUTED words of Some length here", "SHOUTED words of Some length here", LONG, "ÀÉ ß 漢字 " * 40, "of the and to " * 60]
    texts += [" ".join(rng.choice(["Alpha", "beta", "Gamma", "delta", "eps"]) for _ in range(rng.randrange(60))) for _ in range(90)]
    rows = [(i, t, rng.choice(["en", "de", None, "", "fr"])) for i, t in enumerate(texts)]
    return [*rows, (None, "no id at all, but SOME words", "en"), (7, "another text with the same id", "xx")]


# 11


def fingerprint(text):
    words = re.findall(WORD, text)
    votes, n = [0] * 64, max(1, len(words) - 4) if words else 0
    for i in range(n):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def likeness(a, b):
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 64))


def brute_fingerprints(rows):
    """Of (doc_id, text): by text and doc_id, what the query returns."""
    code = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    docs = sorted([(d, t or "") for d, t in rows], key=lambda x: (x[0] is None, -(x[0] or 0), code(x[1])))
    prints = [fingerprint(t) for _, t in docs]
    out = []
    for i, (d, t) in enumerate(docs):
        after = (i + 1) % len(docs)
        half = len(t) // 2
        edited = t[: len(t) - half] + docs[after][1][:half]
        near = None if d is None or d % 100 else sum((prints[i] ^ f).bit_count() <= 3 for f in prints) - 1
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{fingerprint(edited):016x}", round(likeness(prints[i], fingerprint(edited)), 9), round(likeness(prints[i], prints[after]), 9), near))
    return sorted(map(str, out))


def got_fingerprints(df):
    return sorted(str((*r[:5], round(r[5], 9), round(r[6], 9), r[7])) for r in df.collect())


def test_fingerprints(spark):
    rows = odd_documents(random.Random(5))
    got = fingerprints.document_fingerprints(documents(spark, rows).repartition(3))
    assert got_fingerprints(got) == brute_fingerprints([(d, t) for d, t, _ in rows])


def test_fingerprints_of_the_table(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = got_fingerprints(fingerprints.query(spark, sf_dir))
    assert got == brute_fingerprints(rows)


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.document_fingerprints(documents(spark, []).where("false")).count() == 0
    alone = [(3, "one document that follows itself", "en")]
    assert got_fingerprints(fingerprints.document_fingerprints(documents(spark, alone))) == brute_fingerprints([(3, alone[0][1])])
    # repeated rows are each other's next
    same = [(100, "the same text twice and a bit more", "en")] * 3
    rows = fingerprints.document_fingerprints(documents(spark, same)).collect()
    assert [(r.near_next, r.n_near) for r in rows] == [(1.0, 2)] * 3


@pytest.mark.parametrize(("radius", "blocks"), [(0, 2), (3, 6), (3, 4), (5, 8)])
def test_near_finds_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for x in base for _ in range(40)})
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    asked = fps[::7]
    got = fingerprints.near(df, spark.createDataFrame([(signed(x),) for x in asked], "fp long"), radius, blocks).collect()
    want = {(signed(q), signed(x)) for q in asked for x in fps if (q ^ x).bit_count() <= radius}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_likeness_tells_edited_from_next(spark, sf_dir):
    rows = fingerprints.query(spark, sf_dir).where("n_chars > 200").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


# order


def test_numbered_splits_large_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "k", (i * 7919) % 1000) for i in range(1000)], "k string, v long").repartition(7)
    got = ordering.numbered(rows, ["k"], [F.col("v")], "numbers").collect()
    for k in (None, "k"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.v)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert {r.total for r in mine} == {len(mine)}


# 12


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Of (doc_id, text, lang), source `s`: the query's rows."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g: sha(*map(show, (d, "s", g, None if t is None else len(t), t)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            s = i // 8 * 8
            out.append((level[s:i], level[i + 1 : s + 8]))
            i //= 8
        return out

    langs = sorted({g for _, _, g in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        leaves = sorted(((d, leaf(d, t, g), t) for d, t, lang in rows if lang == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = leaves, tree([x[1] for x in leaves])
    top = tree([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        leaves, levels = trees[g]
        for i, (d, own, t) in enumerate(leaves):
            steps = path(levels, i) + path(top, k)
            low = t.translate({c: c + 32 for c in range(65, 91)}) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
            # tampering leaves n_chars as it was
            h = sha(show(d), show("s"), show(g), show(None if t is None else len(t)), show(low))
            for a, b in steps:
                h = sha(*a, h, *b)
            out.append((d, own, levels[-1][0], top[-1][0], sha(*(x for a, b in steps for x in (*a, *b))), h, h == top[-1][0]))
    return sorted(map(str, out))


def test_manifest(spark):
    rows = odd_documents(random.Random(6)) + [(1000 + i, f"Row {i}", "en") for i in range(700)] + [(5000, "again", "en")] * 2
    got = sorted(str(tuple(r)) for r in merkle.manifest(documents(spark, rows).repartition(3)).collect())
    assert got == brute_manifest(rows)
    assert any(x.endswith("False)") for x in got)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(documents(spark, []).where("false")).count() == 0
    for rows in ([(3, "Alone", "en")], [(3, "Alone", "en"), (6, "Two", None)], [(i, f"T{i}", f"l{i}") for i in range(20)]):
        assert sorted(str(tuple(r)) for r in merkle.manifest(documents(spark, rows)).collect()) == brute_manifest(rows)


def test_versions_share_untouched_nodes():
    leaves = [sha(str(i)) for i in range(100)]
    levels = merkle.levels_of(leaves, 100, 9)
    assert [len(x) for x in levels] == [100, 13, 2, 1]
    for i in (0, 7, 8, 63, 96, 99):
        path = merkle.shared_path(levels, i)
        assert merkle.version_root(leaves[i], path) == levels[-1][0]
        changed = merkle.levels_of([*leaves[:i], sha("x"), *leaves[i + 1 :]], 100, 9)
        assert merkle.version_root(sha("x"), path) == changed[-1][0]
        assert sum(a != b for x, y in zip(levels, changed, strict=True) for a, b in zip(x, y, strict=True)) == 4


# 13


def brute_trie(rows):
    """Of (conv_id, turn, role, text): the query's rows."""
    code = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, code(role or "", text or "")), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    members, ends, children = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
            if d:
                children.setdefault(whole[: d - 1], set()).add(whole[:d])
        ends.setdefault(whole, []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children.get(node, ())), sum(x not in children for x in below), saved, hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(map(str, out))


def odd_turns(rng):
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "hi", None, "a longer text", "é漢"])) for c in [*range(12), *range(100, 108), 205, -7, -150] for t in range(rng.randrange(1, 9))]
    rows += [(3, None, "user", "no number"), (3, 0, "user", "tied"), (3, 0, "user", "tied"), (None, 0, "user", "nobody's"), (301, 0, "user", "turnless if cut")]
    return rows + [(300 + i, t, "user", "the same") for i in (4, 5, 6, 7) for t in range(40)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], TURNS)


def trie(df, **how):
    return sorted(str(tuple(r)) for r in prefix_trie.prefix_trie(df, **how).collect())


def test_prefix_trie(spark, monkeypatch):
    rows = odd_turns(random.Random(7))
    df = conversations(spark, rows).repartition(3)
    want = brute_trie(rows)
    assert trie(df) == want
    # components split by joins, long conversations scanned in chunks
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    assert trie(df, block=9) == want


def test_prefix_trie_of_nothing(spark):
    assert trie(conversations(spark, []).where("false")) == []


def test_decomposition_of_random_trees():
    rng = random.Random(8)
    for shape in range(30):
        n = rng.randrange(1, 200)
        parents = [-1] + [rng.randrange(max(0, v - 1 - shape), v) for v in range(1, n)]
        weights = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        want = [list(w) for w in weights]
        for v in range(n - 1, 0, -1):
            want[parents[v]] = [a + b for a, b in zip(want[parents[v]], want[v], strict=True)]
        assert prefix_trie.decomposed(parents, weights) == want
