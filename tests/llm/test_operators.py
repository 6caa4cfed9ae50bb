"""Operators of lurelens.llm against brute force and their defined edge cases."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lurelens.llm import (chunk_dedup, embedding_dedup, fingerprints, mixing, near_dedup, packing, suffix_dedup,
                          token_counts, toxicity, url_filter)
from lurelens.llm.components import connected_components
from lurelens.llm.textcore import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, PIVOT string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi om pi rho sig tau ups Phi chi".split()) + rng.choice(["", "", "s", "ing", "."])
                    for _ in range(n))


def corpus():
    """Prose with exact and near copies, shared passages, odd rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 3, 4, 5, 8, 40, 120, 400])) for _ in range(60)]
    base = prose(rng, 300)
    for edits in (0, 0, 1, 2, 3, 5, 8, 12):          # copies and near copies of one text
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = "EDIT"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    for _ in range(6):                               # one passage in many texts
        texts.append(prose(rng, 90) + "\n" + passage + " " + prose(rng, 70))
    texts += [None, "", "  \n\t ", "Ünïcode “quoted” 漢字 😀 <|endoftext|> it's 'll", prose(rng, 30000)]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def smallest(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- mixing

def test_mix_targets_and_limits(docs):
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == len(ROWS)
    size = {i: len(words(t)) for i, t, *_ in ROWS}
    by = defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(r.size for r in by[s]) for s in names}
    # the contract's own rounds: share, stop at the cap, share the rest again
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(total.values()), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / w > 2 * total[s]}
        if not over:
            for s in open_:
                target[s] += left * weight[s] / w
            break
        for s in over:
            left -= 2 * total[s] - target[s]
            target[s] = 2.0 * total[s]
        open_ -= over
    for s in names:
        assert by[s][0].source_size == total[s]
        assert by[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 3 * mixing.BLOCK_WORDS + 1


def test_mix_reruns_agree_and_texts_follow(docs):
    a = {(r.doc_id, r.taken) for r in mixing.mix_documents(docs).collect()}
    assert a == {(r.doc_id, r.taken) for r in mixing.mix_documents(docs.repartition(2)).collect()}
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({d: t for d, t in a if t})


def test_mix_repeated_rows_and_empty(spark, empty):
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "en", "s", 5, "", "")] * 3 + [(None, "d e", "en", None, 3, "", "")], DOCS)
    rows = mixing.mix_documents(twice).collect()
    assert len(rows) == 4 and all(r.taken <= 2 * r.size for r in rows)


# ---------------------------------------------------------------- suffix arrays and chunks

def repeated_words(rows, n=50):
    seen = defaultdict(set)
    w = {i: words(t) for i, t, *_ in rows}
    for i, ws in w.items():
        for k in range(len(ws) - n + 1):
            seen[tuple(ws[k:k + n])].add(i)
    return {i: {x for k in range(len(ws) - n + 1) if len(seen[tuple(ws[k:k + n])]) > 1 for x in range(k, k + n)} for i, ws in w.items()}


def test_suffix_spans_equal_brute_force(docs):
    want = {(i, x) for i, s in repeated_words(ROWS).items() for x in s}
    got = set()
    for r in suffix_dedup.repeated_passages(docs).collect():
        assert r.n_words >= 50 and r.other_doc != r.doc_id
        got |= {(r.doc_id, x) for x in range(r.start_word, r.start_word + r.n_words)}
    assert got == want


def test_suffix_copies_far_apart_in_the_order(spark):
    """Two copies of fifty words with sixty texts between them that share only the words after the place."""
    rng = np.random.default_rng(5)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    while True:
        passage = filler(50)
        h, _, _, woff = word_hashes(np.frombuffer(" ".join(passage).encode(), np.uint8), np.array([0, len(" ".join(passage))]))
        place = int(suffix_dedup.kept_places(h, woff)[0])
        if 22 <= place <= 28:
            break
    texts = [filler(40) + passage + filler(40) for _ in range(2)]
    texts += [filler(60) + passage[place:] + filler(40) for _ in range(60)]
    rows = [(i, " ".join(t), None, None, None, None, None) for i, t in enumerate(texts)]
    want = {(i, x) for i, s in repeated_words(rows).items() for x in s}
    assert want == {(i, x) for i in (0, 1) for x in range(40, 90)}
    got = {(r.doc_id, x) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
           for x in range(r.start_word, r.start_word + r.n_words)}
    assert got == want


def test_suffix_copy_far_from_a_matched_pair(spark):
    """Two exact copies match each other; a third text shares their fifty words with sixty texts between."""
    rng = np.random.default_rng(6)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for _ in range(3):
        while True:
            passage = filler(50)
            h, _, _, woff = word_hashes(np.frombuffer(" ".join(passage).encode(), np.uint8), np.array([0, len(" ".join(passage))]))
            place = int(suffix_dedup.kept_places(h, woff)[0])
            if 22 <= place <= 28:
                break
        texts += [filler(40) + passage + filler(40)] + [filler(40) + passage + filler(40)] * 2
        texts += [filler(60) + passage[place:] + filler(40) for _ in range(60)]
    rows = [(i, " ".join(t), None, None, None, None, None) for i, t in enumerate(texts)]
    want = {(i, x) for i, s in repeated_words(rows).items() for x in s}
    got = {(r.doc_id, x) for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
           for x in range(r.start_word, r.start_word + r.n_words)}
    assert got == want


def test_suffix_edges(spark, empty):
    assert suffix_dedup.repeated_passages(empty).count() == 0
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line * 2, None, None, None, None, None), (1, line * 2, None, None, None, None, None), (None, line, None, None, None, None, None)]
    assert suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).count() == 0


def test_chunk_spans_find_passages_and_leave_clean_text(docs):
    need = {i for i, s in repeated_words(ROWS).items() if s}
    shared = {i for i, s in repeated_words(ROWS, 15).items() if s}
    got = {r.doc_id for r in chunk_dedup.repeated_spans(docs).collect()}
    assert need <= got <= shared


def test_chunk_cuts_resist_insertions():
    rng = random.Random(1)
    a = prose(rng, 2000).encode()
    b = a[:500] + b"an insertion " + a[500:]
    runs = lambda x: set(chunk_dedup.runs_of(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[3].tolist())
    x, y = runs(a), runs(b)
    assert len(x & y) >= len(x) - 2 * chunk_dedup.RUN - 2


def test_fifty_word_passages_hold_a_span():
    rng, miss = random.Random(2), 0
    for _ in range(200):
        p = prose(rng, 51)
        found = []
        for _ in range(2):
            t = (prose(rng, 40) + " " + p + " " + prose(rng, 40)).encode()
            d, a, b, g = chunk_dedup.runs_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            found.append(dict(zip(g.tolist(), zip(a.tolist(), b.tolist(), strict=True), strict=True)))
        both = [found[0][g] for g in set(found[0]) & set(found[1])]
        miss += not both or max(b for _, b in both) - min(a for a, _ in both) < 100
    assert miss <= 2


def test_chunk_spans_find_repeated_words(spark):
    """A word or a sign said over and over, shared by two documents."""
    rng = random.Random(11)
    rows, cores = [], []
    for core in ("Ating. " * 51, "dolor sit, " * 51, "-" * 400, "no " * 120, "abcdefghijklmno " * 51):
        cores += [core] * 2
        rows += [(len(rows) + k, prose(rng, 40) + "\n" + core + "\n" + prose(rng, 40), None, None, None, 0, None) for k in (0, 1)]
    raw = ("x" * 50 + "Ating. " * 2000).encode()
    assert np.diff(chunk_dedup.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))).max() <= 64
    df = spark.createDataFrame([(i, t, *[None] * 5) for i, t, *_ in rows], DOCS)
    got = {r.doc_id: r for r in chunk_dedup.repeated_spans(df).collect()}
    assert sorted(got) == list(range(len(rows)))
    for i, core in enumerate(cores):
        lo = rows[i][1].encode().index(core.encode())
        assert lo <= got[i].start_byte + 1 and got[i].n_bytes >= len(core) - 96 and got[i].is_first == (i % 2 == 0)
    left = {r.doc_id: r.text for r in chunk_dedup.drop_repeats(df).collect()}
    for i in range(0, len(rows), 2):
        assert left[i] == rows[i][1] and len(left[i + 1]) <= len(rows[i + 1][1]) - len(cores[i]) + 96


def test_drop_repeats_keeps_first_and_columns(docs):
    out = chunk_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(ROWS)
    need = repeated_words(ROWS)
    for i, t, *_ in ROWS:
        if not need[i]:
            assert rows[i].text == t or rows[i].n_chars == len(rows[i].text)
        if rows[i].text is not None:
            assert rows[i].n_chars == len(rows[i].text)
    assert sum(map(len, repeated_words([(i, r.text) for i, r in rows.items()]).values())) < 0.1 * sum(map(len, need.values()))


def test_chunk_empty(empty):
    assert chunk_dedup.repeated_spans(empty).count() == 0 and chunk_dedup.drop_repeats(empty).count() == 0


# ---------------------------------------------------------------- fingerprints

def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(((i, t or "") for i, t, *_ in ROWS), reverse=True)
    assert len(rows) == len(order)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[:len(t) - n] + nxt[:n]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = fingerprints.fingerprints_of([t, e])
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fingerprints.as_hex(np.array([a, b])))
        assert r.near_edited == pytest.approx((a == b).mean()) and 0 <= r.near_next <= 1
        if len(words(t)) > 300:
            s, u = ({tuple(w[x:x + 5]) for x in range(len(w) - 4)} for w in (words(t), words(e)))
            assert abs(r.near_edited - len(s & u) / len(s | u)) < 0.25
    assert len({r.fingerprint for r in rows.values()}) == len({tuple(words(t)) for _, t, *_ in ROWS} )


def test_fingerprint_edges(spark, empty):
    assert fingerprints.fingerprint_edits(empty).count() == 0
    rows = [(5, "a b", None, None, None, None, None), (5, "a b", None, None, None, None, None), (None, None, None, None, None, None, None)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 3 and sum(r.doc_id == 5 for r in got) == 2
    one = fingerprints.fingerprint_edits(spark.createDataFrame(rows[:1], DOCS)).collect()
    assert one[0].near_next == 1.0


def test_near_pairs_are_verified(docs):
    shingles = {i: {tuple(w[x:x + 5]) for x in range(len(w) - 4)} for i, t, *_ in ROWS if len(w := words(t)) >= 5}
    got = fingerprints.near_pairs(docs).collect()
    assert got
    for r in got:
        a, b = shingles[r.u], shingles[r.v]
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b)) and r.jaccard >= 0.8


def test_near_pairs_are_complete(spark, monkeypatch):
    """All pairs of similarity 0.9 or more; the smallest id of a family is like few of the others."""
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    rng, rows = random.Random(12), []
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(200)]
        far = base[:110] + [f"o{rng.randrange(10**9)}" for _ in range(90)]      # shares bands, is like none
        rows.append((len(rows), " ".join(far), *[None] * 5))
        for k in range(9):
            w = list(base)
            for _ in range(k % 3):
                w[rng.randrange(200)] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w), *[None] * 5))
    sets = {i: frozenset(tuple(w[x:x + 5]) for x in range(len(w) - 4)) for i, t, *_ in rows if (w := t.split())}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    reps = sorted(first.values())
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b) for a in reps for b in reps if a < b and jac(a, b) >= 0.9}
    got = [(r.u, r.v) for r in fingerprints.near_pairs(spark.createDataFrame(rows, DOCS).repartition(4), similarity=0.9).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


# ---------------------------------------------------------------- urls

def test_host_path_rules_and_words():
    j = url_filter.Judge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT, 2)
    verdict = lambda u: j.judge(u, url_filter.SOFT)[:4]
    assert verdict(None) == ("", "", None, "allow") and verdict("no scheme free bets")[3] == "block"
    assert verdict("http://WWW.Example.COM/en/1?x#y") == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert verdict("http://example.com/en/1")[2:] == ("example.com/en/", "block")
    assert verdict("http://a.net/fr/2")[2:] == ("net/fr/", "block")
    assert verdict("http://xcom/")[2] is None and verdict("http://x.com")[2] is None
    assert verdict("http://casino.org/")[3] == "block" and verdict("http://casinos1.org/")[3] == "allow"
    assert verdict("http://free-stuff.org/")[3] == "allow" and verdict("http://free-bets.org/free")[3] == "block"


def test_url_weights_and_ties():
    j = url_filter.Judge(url_filter.RULES, url_filter.STRICT, url_filter.SOFT, url_filter.SOFT_LIMIT)
    verdict = lambda u: j.judge(u, url_filter.SOFT)[3]
    assert max(url_filter.SOFT.values()) < url_filter.SOFT_LIMIT and not set(url_filter.SOFT) & set(url_filter.STRICT)
    assert verdict("http://a.org/poker/poker") == "allow" and verdict("http://a.org/free/poker") == "block"
    assert verdict("http://news.org/live/free/click") == "allow" and verdict("http://a.org/hot/live/free/click") == "block"
    assert verdict("http://a.org/freepoker") == "allow" and verdict("http://a.org/" + "x" * 1_000_000 + "/FREE-Poker") == "block"
    tied = url_filter.Judge((("b.com", "/x", "allow"), ("a.b.com", "/", "block"), ("a.b.com", "/", "allow")), (), {}, 2)
    assert tied.judge("http://a.b.com/x", {})[2:4] == ("a.b.com/", "block")


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y")], "page_id long, url string, host string")
    assert [r.verdict for r in url_filter.filter_urls(pages).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- near duplicates

def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[x:x + 5]) for x in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = list(sets)
    edges = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, smallest(edges, ids)


def test_near_duplicates_equal_brute_force(docs):
    sets, comp = brute_near(ROWS)
    got = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), c, c == i) for i, c in comp.items()}
    kept = near_dedup.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values())) and kept.columns == docs.columns


def test_large_group_of_unlike_copies(spark, monkeypatch):
    """A family whose members are mostly not linked: block comparison decides."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(near_dedup, "PIVOT_BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None, None, None))
    _, comp = brute_near(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_near_edges(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(4, "a b c d e f", None, None, None, None, None)] * 2 + [(None, "a b c d e f", None, None, None, None, None), (9, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 4, False), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert near_dedup.drop_near_duplicates(df).count() == 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = smallest([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


# ---------------------------------------------------------------- toxicity

def test_matcher_is_levenshtein():
    m = toxicity.Matcher([("moron", 3.0, 1, False), ("disgusting", 3.0, 2, False), ("scum", 3.0, 0, False), ("lowei", 4.0, 0, True)])
    for w in ("moron", "moroon", "mron", "morron", "mroon", "maron", "disgustnig", "disgsting", "disgustingg", "dsgusting", "scum", "loweischaft"):
        assert m.match(w), w
    for w in ("oron", "mon", "boron", "marnn", "scam", "disguts", "lowex", "", "x" * 100_000):
        assert m.match(w) is None, w


def test_context_separates_quotation():
    m = toxicity.Matcher(toxicity.lexicon([("idiot", 3.0, False)]))
    abuse, quoted = toxicity.evidence("you are an idiot", m)[0], toxicity.evidence('he wrote "idiot" there', m)[0]
    assert toxicity.score_of(abuse) > 0.5 > toxicity.score_of(quoted)
    assert toxicity.score_of(toxicity.evidence(None, m)[0]) < 0.5 and toxicity.evidence("1d1ot", m)[1] == 1


def test_toxicity_learns_and_holds_out(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = prose(rng, 60) + (f" grumfel{rng.choice('abc')} " + prose(rng, 10) if toxic else "")
        rows.append((i, t, None, None, None, None, None))
        labels.append((i, int(toxic), 1))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame([*rows, (None, None, *[None] * 5), (1, rows[1][1], *[None] * 5)], DOCS)
    got = toxicity.toxicity(docs, lab).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(docs, lab.limit(0)).count() == 402


def test_learned_words_may_be_misspelled(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, 60) + (" grumfelder " if i % 4 == 0 else " grünkohl " if i % 4 == 1 else " ") + f"{rng.randrange(16**12):012x}", *[None] * 5)
            for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)], "doc_id long, toxic int, quality int")
    terms, ordinary = toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    m = toxicity.Matcher(terms, ordinary)
    assert dict((t, e) for t, _, e, _ in terms)["grumfelder"] == 2
    for w in ("grumfelder", "grmufelder", "grunfelder", "grumfeldr", "grmfeldder"):
        assert m.match(w), w
    assert not m.match("grünkohl") and not any(m.match(w) for w in words(rows[1][1]))


# ---------------------------------------------------------------- packing and token counts

def test_packing_round_trip(docs):
    tok = Tokenizer.from_file(WORD_BPE)
    parts = defaultdict(list)
    for r in packing.doc_pieces(docs, WORD_BPE, max_len=256, extra=True).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 256
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        parts[r.doc_id].append(r)
    for i, t, *_ in ROWS:
        ids = []
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == len(ids)
            ids += r.ids
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2] and all(r.doc_tokens == len(ids) for r in parts[i])


def test_sequences_are_whole(docs, empty):
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 for r in rows)
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    assert packing.pack_documents(empty, WORD_BPE).count() == 0
    again = packing.pack_documents(docs.union(docs), WORD_BPE).collect()
    assert len(again) == 2 * len(rows) and len({r.sequence_id for r in again}) == len(again)


def test_token_counts_equal_library(docs, empty):
    tok = Tokenizer.from_file(BYTE_BPE)
    want = {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t, *_ in ROWS}
    got = token_counts.token_counts(docs, BYTE_BPE).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {i: len((t or "").encode()) for i, t, *_ in ROWS}
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


def test_token_counts_on_odd_strings(monkeypatch):
    tok, lex = Tokenizer.from_file(BYTE_BPE), token_counts.Lexicon(BYTE_BPE)
    rng = random.Random(6)
    bits = [" ", "  ", "\n", "\t", "'s", "'", "'re", "'l", "'ll", "'ve", "'v", "a", "dog", "é", "1", "23", "!", "<|endoftext|>", " ", "　", "中", "\x1c", "d", "r", "e"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None]
    want = [len(e) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_counts.batch_counts(texts, lex).tolist() == want
    monkeypatch.setattr(token_counts, "PART", 64)
    assert token_counts.batch_counts(texts, lex).tolist() == want


# ---------------------------------------------------------------- embeddings

def brute_links(rows, threshold=0.93):
    good = [(i, lab, np.array(v, np.float64)) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    good = list({g[0]: g for g in good}.values())
    edges = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k]
             if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= threshold]
    return edges


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.12 * (i % 3)], int(i % 2)) for i in range(600)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None),
             (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    assert len(got) == len(rows)
    edges = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    degree = Counter(x for e in edges for x in e)
    found = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    assert all(found[i] <= degree[i] for i in found) and sum(found.values()) >= 0.97 * sum(degree.values()) and sum(found.values()) % 2 == 0
    comp = smallest(edges, [r[0] for r in rows if r[0] is not None])
    same = sum(comp[r.vec_id] == r.component_id for r in got if r.vec_id is not None)
    assert same >= 0.97 * len(found)
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id in (900, 901, 902, 903, 904):
            assert r.n_links == 0 and r.component_id == r.vec_id
        if r.vec_id in (905, 906):
            assert r.n_links == 1 and r.component_id == 905


def test_embedding_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).count() == 0
    assert F is not None


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(3)
    for n1, n2 in ((16, 16), (5, 9), (1, 4)):
        one, two = rng.integers(0, 20, n1) * 0.5, rng.random(n2)
        both = (one[:, None] + two[None, :]).ravel()
        cells = embedding_dedup.traversal(one, two, n1 * n2)
        assert sorted(cells) == list(range(n1 * n2)) and (np.diff(both[cells]) >= 0).all()
        assert embedding_dedup.traversal(one, two, 3) == cells[:3] or n1 * n2 < 3
        for at, cell in enumerate(cells):
            assert embedding_dedup.visit_rank(one, two, cell) >= at + 1


def test_embedding_copies_and_sparse_links(spark):
    """A third of all rows are one vector; links between the others are rare."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(900, 32))
    pairs = [(a, b) for a, b in zip(range(0, 120, 2), range(1, 120, 2), strict=True)]
    for a, b in pairs:
        u = base[a] / np.linalg.norm(base[a])
        w = rng.normal(size=32)
        w -= (w @ u) * u
        base[b] = 0.94 * u + np.sqrt(1 - 0.94 ** 2) * w / np.linalg.norm(w)
    rows = [(i + 1000, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(base)]
    rows += [(i, rows[500][1], 1) for i in range(450)] + [(5000, rows[500][1], 2)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    assert all(got[i].n_links == 450 and got[i].component_id == 0 for i in [*range(450), 1500]) and got[5000].n_links == 0
    found = sum(got[1000 + a].n_links + got[1000 + b].n_links for a, b in pairs)
    assert found >= 0.9 * 2 * len(pairs) and all(got[1000 + b].component_id == 1000 + a for a, b in pairs if got[1000 + b].n_links)
