"""The corpus pipeline, stage by stage, and the queries that have SQL."""
import random

import duckdb
import pytest

import corpus_pipeline as cp
from lurelens.llm import mixing
from lurelens.llm.common import materialize
from lurelens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, sf001), f"test-{name}")
        out.append(docs)
    return out


def test_stage_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5
    assert "sequence_id" in stages[-1].columns


def test_stages_narrow_then_mix(stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[5] == ids[4] <= ids[3]
    assert len(ids[1]) > 0.9 * len(ids[0]) and stages[2].count() == len(ids[2])


def test_run_equals_the_stages(spark, sf001, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, sf001).select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_near_stage_equals_brute_force(spark):
    """One document of each group of similarity 0.8 or more stays."""
    rng = random.Random(8)
    rows, sets = [], {}
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(204)]
        for edits in (0, 1, 3, 4, 5, 6, 7):        # 5 shingles an edit; links of 0.80 to 0.85 at 4
            w = list(base)
            for i in rng.sample(range(5, 195, 10), edits):
                w[i] = f"e{rng.randrange(10**9)}"
            sets[len(rows)] = {tuple(w[x:x + 5]) for x in range(len(w) - 4)}
            rows.append((len(rows), " ".join(w)))
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_mixing_stage_reaches_every_target(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([20, 90, 300, 2000])), f"s{i % 40:02}" if i % 7 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target, plain, got = {}, {}, {}
    for r in mixing.mix_documents(docs).collect():
        target[r.source], plain[r.source] = int(r.target), plain.get(r.source, 0) + r.taken
    assert plain == target
    for r in cp.mix_sources(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == target


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf001, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf001)
    assert sorted(df.columns) == sorted(rel.columns)
    norm = lambda rows, cols: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for _, x in sorted(zip(cols, r, strict=True)))) for r in rows)
    assert norm(map(tuple, df.collect()), df.columns) == norm(rel.fetchall(), rel.columns)


def test_substring_stage_cuts_the_later_copy_only(spark):
    """Of each planted passage the first copy stays whole; of the later ones most
    goes, and nothing but the passage (widened to whole words) goes."""
    rng = random.Random(12)
    own = lambda d, n: [f"d{d}w{rng.randrange(10**7)}" for _ in range(n)]
    rows, passages = [], []
    for i in range(40):
        p = own("p", 80) if i < 20 else passages[i - 20]
        if i < 20:
            passages.append(p)
        rows.append((i, (own(i, 60), p, own(i, 50))))
    texts = [(i, " ".join(a + p + z)) for i, (a, p, z) in rows] + [(100 + i, " ".join(own(100 + i, 200))) for i in range(10)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in cp.drop_repeated_passages(spark, docs, "").collect()}
    assert all(got[i] == t for i, t in texts if i < 20 or i >= 100)
    left = 0
    for i, (a, p, z) in rows[20:]:
        words = got[i].split()
        assert [w for w in words if w not in p] == a + z
        left += len(words) - len(a) - len(z)
    assert left < 0.2 * 20 * 80


def test_toxicity_stage_equals_scoring_row_by_row(spark):
    """The stage keeps the rows that plain Python scoring with the learned lexicon keeps."""
    from lurelens.llm import toxicity
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(rng.choice("river stone cloud maple harbor candle window garden".split()) for _ in range(30))
        rows.append((i, text + (" you grobnik " if bad else " ") + f"{rng.randrange(16**14):014x}", "en"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, None, "en"), (500, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    terms, ordinary = toxicity.fit(docs, labels)
    matcher = toxicity.Matcher(terms, ordinary)
    want = sorted(i for i, t, _ in [*rows, (500, "", "en")] if toxicity.score_of(toxicity.evidence(t, matcher)[0]) < 0.5)
    kept = toxicity.keep_clean(docs, labels)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want == sorted([i for i in range(300) if i % 3] + [500])
    assert kept.filter("doc_id is null").count() == 1
