"""One id under several texts, and extra columns whose names clash."""
import random

import pytest

from lurelens.llm import chunk_dedup, mixing, near_dedup, suffix_dedup, toxicity

CLASH = ["predicted", "score", "n_hits", "scored_text", "__id", "__size", "__kept", "kept", "start", "id", "key", "mix_key", "mix_size",
         "cut_id", "cut_spans", "digest", "other", "group"]


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))


def clashing(df):
    return df.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASH])


@pytest.fixture(scope="module")
def shared(spark):
    """Ids 1 (three texts, one twice), 2 and 3; the second text of id 1 is near
    document 2, the third shares a long passage with document 3."""
    rng = random.Random(3)
    a, b, c, passage = prose(rng, 200), prose(rng, 200), prose(rng, 90), prose(rng, 80)
    words = b.split()
    words[100] = "other"
    rows = [(1, a), (1, b), (1, a), (2, " ".join(words)), (3, prose(rng, 30) + " " + passage + " " + prose(rng, 400)), (1, c + " " + passage), (4, "short"), (1, "short")]
    return rows, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_near_duplicates_link_each_text_of_an_id(shared):
    rows, docs = shared
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted([(1, 196, 1, True)] * 3 + [(1, 166, 1, True), (2, 196, 1, False), (3, 506, 3, True), (4, 1, 1, False), (1, 1, 1, True)])
    left = near_dedup.drop_near_duplicates(clashing(docs))
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted({t for t in rows if t[0] in (1, 3)})
    assert left.columns == clashing(docs).columns


def test_one_text_of_a_group_stays(spark):
    """Near texts under one id are one group too."""
    rng = random.Random(8)
    base = prose(rng, 300).split()
    rows = [(7, " ".join(base)), (7, " ".join(base[:100] + ["x"] + base[101:])), (9, " ".join(base[:-1] + ["y"])), (7, " ".join(base)), (None, " ".join(base))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in near_dedup.drop_near_duplicates(d).collect()]
    assert len([r for r in left if r[0] == 7]) == 1 and len([r for r in left if r[0] == 9]) == 0 and left.count(rows[-1]) == 1


def test_passages_of_each_text_of_an_id(shared):
    rows, docs = shared
    got = {(r["doc_id"], r["start_word"], r["n_words"]): r["other_doc"] for r in suffix_dedup.repeated_passages(clashing(docs)).collect()}
    assert got.pop((3, 30, 80)) == 1 and got.pop((1, 90, 80)) == 3
    # what b shares with its near copy: the words around the changed one
    assert set(got) == {(1, 0, 100), (1, 101, 99), (2, 0, 100), (2, 101, 99)}


def test_spans_of_each_text_of_an_id(shared):
    rows, docs = shared
    spans = chunk_dedup.repeated_spans(clashing(docs)).collect()
    by_doc = {d: sum(r["n_bytes"] for r in spans if r["doc_id"] == d) for d in (1, 2, 3, 4)}
    assert by_doc[2] > 0.8 * len(rows[3][1]) and by_doc[4] == 0 and 400 < by_doc[3] < 700
    cut = chunk_dedup.drop_repeats(clashing(docs))
    texts = {(r["doc_id"], r["n_chars"]) for r in cut.collect()}
    assert cut.columns == clashing(docs).columns and cut.count() == len(rows)
    assert all((1, len(t)) in texts for i, t in rows if i == 1)                    # first places stay whole
    assert min(n for d, n in texts if d == 2) < 0.2 * len(rows[3][1]) and min(n for d, n in texts if d == 3) < len(rows[4][1]) - 400


def test_stages_with_clashing_columns(spark, shared):
    _, docs = shared
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for out in (toxicity.keep_clean(clashing(docs), labels), mixing.mixed_texts(clashing(docs))):
        assert out.columns == clashing(docs).columns and out.count() >= 6


def test_small_sources_reach_their_targets_on_long_schedules(spark):
    """480 sources of one to five blocks beside two that fill two million slots."""
    rows = [(i, f"s{i:03d}", 64 * (1 + i % 5)) for i in range(480)] + [(1000, "t0", 40_000_000), (1001, "t1", 50_000_000)]
    t = mixing.with_shares(mixing.source_targets(spark.createDataFrame(rows, "doc_id long, source string, size long")))
    n = t.first()["total_blocks"]
    assert n > 2_000_000
    got = mixing.filled(mixing.slots(t, n), t).groupBy("sidx").count().join(t, "sidx").collect()
    assert len(got) == 482 and all(r["count"] == r["blocks"] for r in got)


def test_misspellings_equal_edit_distance(spark):
    """The automata accept what a plain edit distance (with swaps) accepts."""
    rng = random.Random(6)
    terms = ["worthless", "idiot", "pathetics", "trash", "abominations"]

    def near(a, b):                       # insertions, deletions, replacements, swaps of neighbours
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    lexicon = [(t, 3.0, toxicity.allowed_edits(len(t)), False) for t in terms]
    matcher = toxicity.Matcher(lexicon)
    words = set(terms)
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.choice([1, 1, 2])):
                k = rng.randrange(1, len(w))
                op = rng.randrange(4)
                if op == 0:
                    w[k] = rng.choice("aeiost")
                elif op == 1:
                    del w[k]
                elif op == 2:
                    w.insert(k, rng.choice("aeiost"))
                elif k + 1 < len(w):
                    w[k], w[k + 1] = w[k + 1], w[k]
            words.add("".join(w))
    for w in words:
        if len(w) < 5:
            continue
        want = any(t[0] == w[0] and near(w, t) <= (toxicity.allowed_edits(len(t))) for t in terms)
        assert (matcher.match(w) is not None) == want, w
