"""Benchmark hits against a scan for every window."""

import hashlib
import random
import re

from quillspark.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, size=8):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_whole_table(spark):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").select("doc_id" if n == "documents" else "item_id", "text").collect()]
    want = [(i, n, m, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), len(x) >= 2) for i, n, m, x in brute(read("documents"), read("benchmark"))]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op10_decontaminate(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 0


def test_made_cases(spark, monkeypatch):
    r = random.Random(6)
    vocab = ["the", "The", "a", "of", "É", "é", "x1", "ΟΔΟΣ", "οδος", "İ", "K", "k", "z-z", "q_q", "漢字", "😀"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i % 25, text(r.choice([0, 1, 3, 7, 8, 9, 20]))) for i in range(40)] + [(None, text(9)), (60, None), (61, "...")]
    docs = [(i, text(r.randint(0, 60)) + (r.choice(items)[1] or "") + text(r.randint(0, 5))) for i in range(120)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, docs[5][1]), (6, None), (7, ""), (8, "the " * 30_000)]
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, pos int, key string").repartition(4)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, win int")
    for block in (4 << 20, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in decontaminate.benchmark_hits(frame, bench, size=4 if block == 300 else 8).collect()), key=str)
        assert got == brute(docs, items, 4 if block == 300 else 8)
        if block == 300:
            break
    none = decontaminate.benchmark_hits(frame, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(x.n_hit or x["items"] for x in none)
    assert decontaminate.benchmark_hits(frame.limit(0), bench).collect() == []


def test_no_python_in_the_plan(spark):
    plan = queries.op10_decontaminate(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_contained(docs, items, share=0.8, k=5):
    runs = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in docs:
        w = words(t)
        for j, u in items:
            x = words(u)
            s = runs(x)
            if j is None or not s or len(w) < k:
                continue
            best = max(len(s & runs(w[a : a + len(x)])) for a in range(max(1, len(w) - len(x) + 1)))
            if best >= share * len(s) - 1e-9:
                out.add((i, j, round(best / len(s), 9)))
    return out


def test_containment_in_windows_of_an_items_size(spark, monkeypatch):
    """Items copied with words changed, cut, moved to the ends of texts and repeated, against all windows."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    items = [(f"i{n}", " ".join(r.choice(vocab) for _ in range(r.randint(1, 40)))) for n in range(25)] + [(None, "v1 v2 v3 v4 v5 v6"), ("i3", "x"), ("empty", None)]
    docs = [(n, " ".join(r.choice(vocab) for _ in range(r.randint(0, 120)))) for n in range(30)]
    for n in range(30, 130):
        w = words(r.choice(items[:25])[1])
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        w = w[: r.choice([len(w), max(1, len(w) - 2)])]
        docs.append((n, " ".join([*r.choices(vocab, k=r.choice([0, 0, 3, 60])), *w, *r.choices(vocab, k=r.choice([0, 0, 5]))]).title()))
    docs += [(200, None), (None, items[4][1]), (30, docs[30][1])]
    make = lambda rows, ids: spark.createDataFrame([(*x, "s", 1) for x in rows], f"{ids}, text string, item string, n int").repartition(3)
    d, i = make(docs, "doc_id long"), make(items, "item_id string")
    for share, size in ((0.8, 4 << 20), (0.5, 20_000)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = {(x.doc_id, x.item, round(x.containment, 9)) for x in decontaminate.contained_items(d, i, share).collect()}
        want = brute_contained(docs, items, share)
        assert got == want and len(want) > 20
    assert decontaminate.contained_items(d.limit(0), i).collect() == [] and decontaminate.contained_items(d, i.limit(0)).collect() == []
