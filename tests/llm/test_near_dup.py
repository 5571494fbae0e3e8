"""Near duplicates against all pairs compared on whole sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quillspark.llm import near_dup, queries

SF = "/root/testdata/sf0.01"


def brute(rows, words, percent):
    """rows: (id, text) with distinct ids -> {id: (n_shingles, component)}"""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    of, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            of[x].append(i)
    for ids in of.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(spark, rows, words=4, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dup.near_duplicates(docs, words, percent).collect()
    want = brute(rows, words, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_whole_table(spark):
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 4, 80)
    got = queries.op7_near_dup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_chains_small_sets_and_large_groups(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    base = [r.choice(vocab) for _ in range(60)]
    for _ in range(40):  # a chain: each differs a little from the last one
        rows.append((i := i + 1, " ".join(base)))
        base[r.randrange(60)] = r.choice(vocab)
    core = [r.choice(vocab) for _ in range(200)]
    for _ in range(150):  # a large group around one core, which some members leave far
        own = list(core)
        for _ in range(r.choice([1, 2, 4, 6, 9])):
            own[r.randrange(200)] = r.choice(vocab)
        rows.append((i := i + 1, " ".join(own)))
    for n in range(1, 9):  # small sets
        rows += [((i := i + 1), " ".join(vocab[:n])), ((i := i + 1), " ".join(vocab[:n]).upper() + "\n"), ((i := i + 1), " ".join(vocab[1 : n + 1]))]
    rows += [((i := i + 1), "same text again and again") for _ in range(30)]
    r.shuffle(rows)
    check(spark, rows)


def test_pairs_that_share_large_buckets_only(spark):
    """10,000 texts at a similarity of at most 0.77 with each other, and copies at 0.87 of eight of them that share no small bucket with them."""
    text = lambda a, b, c: " ".join([*[f"k{i}" for i in range(10)], f"a{a}", *[f"k{i}" for i in range(11, 30)], f"b{b}", *[f"k{i}" for i in range(31, 50)], f"c{c}", *[f"k{i}" for i in range(51, 62)]])
    rows = [(100 * a + b, text(a, b, (a + b) % 100)) for a in range(100) for b in range(100)]
    near = [(94, 14), (19, 49), (26, 67), (45, 28), (89, 79), (0, 12), (85, 55), (96, 79)]
    copies = [(20_000 + k, text(a, b, f"z{a}-{b}")) for k, (a, b) in enumerate(near)]
    sets = lambda t: near_dup.shingle_set(t.encode(), 4)
    keys = [near_dup.band_keys(near_dup.signature(sets(t))) for _, t in rows + copies]
    held = Counter(int(k) for own in keys for k in own)
    for k, (a, b) in enumerate(near):
        shared = set(map(int, keys[10_000 + k])) & set(map(int, keys[100 * a + b]))
        assert shared and min(held[x] for x in shared) > near_dup.PAIRWISE
        assert len(np.intersect1d(sets(copies[k][1]), sets(rows[100 * a + b][1]))) == 55
    got = near_dup.near_duplicates(spark.createDataFrame(rows + copies, "doc_id long, text string").repartition(4), 4).collect()
    want = {i: i for i, _ in rows} | {20_000 + k: 100 * a + b for k, (a, b) in enumerate(near)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 20, 200, 5000):
        got = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n + n // 4 + 1, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(x[: n + 1]), np.sort(x[n // 8 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got.append(np.mean(near_dup.signature(a) == near_dup.signature(b)) - true)
        assert abs(np.mean(got)) < 0.08, (n, np.mean(got))


def test_edges(spark):
    rows = [(1, ""), (2, None), (3, " \n"), (4, "a b c d e"), (None, "a b c d e"), (9, "A b C d e"), (9, "other words are in this one"), (5, "other words are in this one"), (9, "other words are in this one"), (7, "x y " * 60_000)]
    docs = spark.createDataFrame([(i, t, 0, "s", "k") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string, set_key string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 4).collect())
    assert got == sorted([("1", 0, 1, True), ("2", 0, 2, True), ("3", 0, 3, True), ("4", 2, 4, True), ("None", 2, None, True), ("9", 2, 4, False), ("9", 3, 4, False), ("9", 3, 4, False), ("5", 3, 4, False), ("7", 2, 7, True)])
    assert near_dup.near_duplicates(docs.limit(0), 4).collect() == []
