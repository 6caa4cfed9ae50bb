"""Operators 11 to 13 against brute force and their defined edge cases."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.llm import decontamination as dc
from lurelens.llm import spelling as sp
from lurelens.llm import vector_codes as vc
from lurelens.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


# ---- op11: positional index

def brute_contamination(docs, items, size=10):
    def words(t):
        return TERMS.findall((t or "").translate(LOWER))

    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[a:a + size])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a:a + n])) in wins:
                    hit |= set(range(a, a + n))
                    found |= wins[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def passages(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Ünï", "the", "THE", "漢字", "a1"]
    some = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", ",", "--"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 5, 9, 10, 11, 25, 60]))) for i in range(25)]
    items += [(3, some(30)), (100, items[4][1]), (None, some(12)), (101, None), (102, "..."), (103, "hot " * 40), (104, "hot")]
    docs = [(i, some(rng.choice([0, 3, 40, 200]))) for i in range(60)]
    for i in range(60, 90):                       # items, whole and in part, between other words; hot words
        t = rng.choice(items)[1] or ""
        docs.append((i, some(5) + " " + rng.choice([t.upper(), t[10:], t + " x " + t]) + " " + some(4)))
    docs += [(200, "hot " * 3000), (201, None), (202, " \n"), (None, some(20)), (60, docs[60][1]), (60, "other"), (203, some(20000))]
    return docs, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [10, 3])
def test_contamination_equals_brute_force(spark, size):
    docs, items = passages()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, Term string").repartition(7)
    i = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, phrase string, win string")
    assert rows_of(dc.contamination(d, i, size)) == sorted(brute_contamination(docs, items, size), key=repr)


def test_contamination_of_empty_tables_and_clashing_columns(spark):
    docs, items = passages()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(d.limit(0), i).collect() == []
    assert rows_of(dc.contamination(d, i.limit(0))) == sorted(brute_contamination(docs, []), key=repr)
    clash = d.selectExpr("*", "'x' as win", "'y' as _id", "1 as _h", "2 as pos", "3 as hits", "4 as n_words")
    assert rows_of(dc.contamination(clash, i)) == rows_of(dc.contamination(d, i))


def test_proximity_matches_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 20, 80])))) for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4])))) for i in range(30)]
    want = {}
    wins = {" ".join(t.split()[a:a + 3]) for _, t in items for a in range(max(1, len(t.split()) - 2))}
    for i, t in docs:
        w = t.split()
        for x in wins:
            least = [b - a + 1 for a in range(len(w)) for b in range(a, min(len(w), a + len(x.split()) + 3)) if set(x.split()) <= set(w[a:b + 1])]
            if least:
                want[i, x] = min(least)
    got = dc.near_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=3, size=3)
    assert {(r["doc_id"], r["win"]): r["near"] for r in got.collect()} == want


def test_decontamination_runs_no_python_on_executors(spark, sf001):
    plan = QUERIES["op11_decontamination"](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---- op12: spelling

def brute_variants(docs, min_length=5, min_count=3):
    count = Counter()
    for i, t in docs:
        for r in LETTERS.findall(t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            count[r if h % 97 else r[:h % len(r)] + r[h % len(r) + 1:]] += 1
    n = {w: c for w, c in count.items() if len(w) >= min_length and c >= min_count}
    near = {w: {x for x in n if x != w and one_edit(w, x)} for w in n}
    form = {w: b for w in n if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def misspelled(seed=3):
    rng = random.Random(seed)
    ws = ["".join(rng.choice("aabcé") for _ in range(rng.choice([4, 5, 6, 7, 8, 9]))) for _ in range(500)]
    docs = [(i if i else None, " ".join(rng.choice(ws[:int(2 + len(ws) * rng.random() ** 2)]) for _ in range(60))) for i in range(150)]
    docs += [(700 + i, " ".join(["aaaaaaaaaaaaaaaaaaaa" + c, "aaaaaaaaaaaaaaaaaaaa", "AAAAAAAAAAAAAAAAAAAAa"] * 3)) for i, c in enumerate("abcdef")]
    return docs + [(7, None), (8, ""), (9, "Aab" * 20000 + " x")] * 3


def test_variants_equal_brute_force(spark):
    docs = misspelled()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int").repartition(5)
    assert rows_of(sp.variants(d)) == sorted(brute_variants(docs), key=repr)
    assert sp.variants(d.limit(0)).collect() == []


@pytest.mark.parametrize("cells", [1 << 20, 200, 12])
def test_near_words_whatever_the_size_of_a_state(spark, cells):
    """One prefix holds all words: states are dealt out again until small enough."""
    rng = random.Random(9)
    words = {"common" + "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 4, 5]))) for _ in range(300)}
    words |= {"x" + w for w in list(words)[:40]} | {w + "y" for w in list(words)[:40]} | {"ab", "ba", "a", "b"}
    vocab = [(w, 3 + zlib.crc32(w.encode()) % 50) for w in sorted(words)]
    n = dict(vocab)
    want = set()
    for w in words:
        if near := [x for x in words if one_edit(w, x) and x != w]:
            b = min(near, key=lambda x: (-n[x], x))
            want.add((w, len(near), n[b], b))
    got = sp.near_words(spark.createDataFrame(vocab, "word string, n long").repartition(3), 1, cells)
    assert {tuple(r) for r in got.collect()} == want


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w0"), ("y", "w36")]
    got = dict(tuple(r) for r in sp.roots(spark.createDataFrame(links, "word string, form string")).collect())
    assert got == {w: "w37" for w, _ in links}


# ---- op13: cover-tree codes

def brute_codes(rows):
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = max(16, -(-max(len(v) for *_, v in kept) // 16) * 16)
    x = np.zeros((len(kept), dims), np.int64)
    for j, (*_, v) in enumerate(kept):
        x[j, :len(v)] = [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]
    wide = dims // 16
    books = [x[:64, p * wide:(p + 1) * wide].copy() for p in range(16)]
    for last in (False, False, True):
        codes, error = [], np.zeros(len(kept), np.int64)
        for p, book in enumerate(books):
            part = x[:, p * wide:(p + 1) * wide]
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            codes.append(d.argmin(1))
            error += d.min(1)
            if not last:
                for e in set(codes[-1].tolist()):
                    book[e] = part[codes[-1] == e].sum(0) // (codes[-1] == e).sum()
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    by = Counter()
    for (_, lab, _), e in zip(kept, error.tolist(), strict=True):
        by[lab] += e
    return [(i, "".join(f"{c[j]:02x}" for c in codes), int(error[j]), by[lab], sha) for j, (i, lab, _) in enumerate(kept)]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dims=32, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i * 2, [float(np.float32(c)) for c in centres[i % 12] + rng.normal(size=dims) * rng.choice([0.01, 0.3])], int(i % 3) if i % 11 else None)
            for i in range(n)]
    return rows + [(rows[0][0] + 1, rows[0][1], 1)] * (n // 3)          # a hot vector


@pytest.mark.parametrize("n", [600, 70, 9, 1])
def test_codes_equal_brute_force(spark, n):
    rows = vectors(n) + [(5001, None, 1), (5002, [0.5] * 31 + [None], 1), (5003, [float("nan")] * 32, 2), (5004, [float("inf")] * 32, None),
                         (5005, [0.25] * 20, None), (5006, [], 7), (5007, [-3000.0] * 32, 7), (None, [0.125] * 32, 0)]
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], VECTORS + ", code string, trees int").repartition(4)
    assert rows_of(vc.compress(d)) == sorted(brute_codes(rows), key=repr)


def test_codes_of_nothing(spark):
    d = spark.createDataFrame([(1, None, 1), (2, [None], 2)], VECTORS)
    assert vc.compress(d).collect() == [] == vc.compress(d.limit(0)).collect()
    assert vc.compress(d).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_cover_tree_settles_subtrees_exactly():
    """Ranges and single points together give every point's nearest entry, ties
    to the lower index, and most points without a comparison of their own."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 4, (500, 4)) + c for c in rng.integers(-400, 400, (20, 4))] + [np.zeros((3000, 4), np.int64)])
    book = np.concatenate([x[rng.integers(0, len(x), 40)], x[:8], x[:8]])
    tree = vc.CoverTree.build(x)
    assert sorted(tree.order) == list(range(len(x)))
    y = x[tree.order]
    ran, entry, places, single = tree.assign(y, book)
    got = np.full(len(x), -1)
    for (a, b), e in zip(ran, entry, strict=True):
        got[a:b] = e
    got[places] = single
    assert (got == ((y[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
    assert len(places) < len(x) / 2
    for a, b, r in zip(tree.lo, tree.hi, tree.radius, strict=True):
        assert ((y[a:b] - y[a]) ** 2).sum(1).max() <= r * r * (1 + 1e-9)


def test_blocks_cut_anywhere(spark, monkeypatch):
    rows = vectors(300)
    monkeypatch.setattr(vc, "BLOCK", 32 * 33)
    d = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert rows_of(vc.compress(d)) == sorted(brute_codes(rows), key=repr)
    assert d.select(F.count("*")).first()[0] == 400
