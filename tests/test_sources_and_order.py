"""Encodings per file, file order, order by ranges, cut-offs, separation, and a
history that survives a killed batch."""
import random

import pytest
from pyspark.sql import functions as F

from lurelens.operators import evaluate as ev
from lurelens.operators import leakage as lk
from lurelens.operators import ordering as od
from lurelens.operators import prep as pp
from lurelens.operators import splits as sp
from lurelens.session import scratch_path
from lurelens.sources import io
from lurelens.streaming import streams as st


# ---- S1, S4, L2: files

def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,subject,body,label\n1,"Grüße","line\ntwo é",phishing\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,subject,body,label\n2,Grüße,señor,ham\n".encode("latin1"))
    (tmp_path / "c.csv").write_bytes(b"id,subject,body,label\n3,plain,ascii,spam\n")
    got = {r["file"].rsplit("/")[-1]: r["encoding"] for r in io.file_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "utf-8", "b.csv": "iso-8859-1", "c.csv": "utf-8"}
    rows = io.load_email_dataset(spark, str(tmp_path), keep=[F.col("id").cast("int")]).collect()
    assert {r["id"]: (r["subject"], r["body"], r["label"]) for r in rows} == {
        1: ("Grüße", "Grüße line\ntwo é", 1), 2: ("Grüße", "Grüße señor", 0), 3: ("plain", "plain ascii", 1)}
    wrong = io.load_email_dataset(spark, str(tmp_path / "b.csv"), encoding="utf-8").first()["subject"]
    assert wrong != "Grüße"


def test_odd_file_names(spark, tmp_path):
    (tmp_path / "a b+c%41 ü.csv").write_bytes("id,subject,body,label\n1,Grüße,x,spam\n".encode("latin1"))
    (tmp_path / "z.csv").write_bytes("id,subject,body,label\n2,Grüße,x,spam\n".encode())
    got = io.load_email_dataset(spark, str(tmp_path), keep=["id"]).collect()
    assert sorted((r["id"], r["subject"]) for r in got) == [("1", "Grüße"), ("2", "Grüße")]
    assert [r["id"] for r in io.peek_schema(spark, str(tmp_path))[0].collect()] == ["1", "2"]


def test_labels_are_numbered_in_file_order_whatever_the_splits(spark, tmp_path):
    rng = random.Random(2)
    names = [f"label{i:02d}" for i in range(30)]
    seen = []
    for f in range(3):
        rows = [rng.choice(names[:10 * (f + 1)]) for _ in range(400)]
        seen += rows
        (tmp_path / f"{f}.csv").write_text("url_len,type\n" + "".join(f"{i},{x}\n" for i, x in enumerate(rows)))
    want = {x: i for i, x in enumerate(dict.fromkeys(seen))}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df, _ = io.load_url_feature_dataset(spark, str(tmp_path), binary=False, drop_leaks=False, schema="url_len int, type string")
            assert (df.rdd.getNumPartitions() > 10) == (size == "1k")
            assert {r["type"]: r["label_numeric"] for r in df.distinct().collect()} == want
            first, cols = io.peek_schema(spark, str(tmp_path))
            assert [r["type"] for r in first.collect()] == seen[:5] and cols == ["url_len", "type"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_peek_goes_on_to_later_files(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text(f"a\n{i}\n")
    assert [r["a"] for r in io.peek_schema(spark, str(tmp_path), 3)[0].collect()] == ["0", "1", "2"]
    assert len(io.peek_schema(spark, str(tmp_path), 9)[0].collect()) == 4


@pytest.mark.parametrize("blank", ["\t", " ", "　", "\x1f", "\x85", " "])
def test_white_space_is_stripped_as_by_python(spark, blank):
    text = f"{blank} http://a.b/{blank}c {blank}"
    assert spark.createDataFrame([(text,)], "t string").select(io.strip(F.col("t"))).first()[0] == text.strip()


# ---- order by ranges

def test_places_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1.0, 1.0, 1.0, rng.random()]), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, n int").repartition(7)
    got = od.before(od.by_ranges(df, ["s", "n"], "t", 6), "n", "b").collect()
    want, total = [], 0
    for s, n in sorted(rows):
        want.append((s, n, total))
        total += n
    assert sorted((r["s"], r["n"], r["b"]) for r in got) == want
    placed = od.place(od.by_ranges(df, ["s", "n"], "t", 6), "i").collect()
    assert [(r["s"], r["n"]) for r in sorted(placed, key=lambda r: r["i"])] == sorted(rows)
    assert od.place(od.by_ranges(df.limit(0), ["s"], "t"), "i").count() == 0


def test_auc_of_scores_that_lie_close_together(spark):
    rng = random.Random(5)
    rows = [((0.5 + rng.random() * 1e-6) if i % 100 else rng.random(), int(rng.random() < 0.4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert ev.exact_auc(df).first()["auc"] == pytest.approx(want, abs=1e-6)
    ranges = od.by_ranges(df.select(F.col("score").alias("s")).distinct(), ["s"], "t", 8).groupBy(od.RANGE).count().collect()
    assert max(r["count"] for r in ranges) < 3000 / 4


@pytest.mark.parametrize("spread", [1 << 32, 1000, 1])
def test_kth_key_with_all_hashes_in_one_bucket(spark, spread):
    rng = random.Random(7)
    rows = [(i % 3, rng.randrange(spread), f"k{i}") for i in range(900)]
    keys = spark.createDataFrame(rows, "c int, h long, key string")
    got = {r["c"]: (r["__h_cut"], r["__t_cut"]) for r in sp.lowest_k_cutoff(keys, "h", "key", lambda n: F.round(n * 0.2), ["c"]).collect()}
    assert got == {c: sorted((h, k) for x, h, k in rows if x == c)[59] for c in range(3)}
    one = sp.lowest_k_cutoff(keys, "h", "key", lambda n: F.ceil(n * 0.2)).first()
    assert (one["__h_cut"], one["__t_cut"]) == sorted((h, k) for _, h, k in rows)[179]


# ---- T1

def test_separating_columns_equal_the_exact_report(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((y, float(y), rng.random() + 2 * y, rng.random(), rng.randrange(5), 2 * rng.randrange(300) + y, None if y else 1.0, float("nan"), 7,
                     2 * i + y if i > 1 else 5000))
    df = spark.createDataFrame(rows, "label int, flag double, apart double, noise double, few int, parity int, onesided double, nans double, const int, late int")
    want = [r["feature"] for r in lk.separation_report(df).collect() if r["separates"]]
    assert sorted(lk.separating_columns(df)) == sorted(want) == ["apart", "flag", "noise", "parity"]


# ---- W3: history

def test_a_batch_killed_before_its_commit_is_read_neither_half_nor_twice(spark, monkeypatch):
    src, path, ckpt = (scratch_path(spark, x) for x in ("t-src", "t-history", "t-ckpt"))
    spark.createDataFrame([(i, f"http://h/{i % 5}") for i in range(40)], "id long, url string").write.parquet(src)
    stream = lambda: st.file_stream(spark, src, "id long, url string")
    real = st.commit_attempt

    def killed(*_):
        raise RuntimeError("killed between write and commit")

    monkeypatch.setattr(st, "commit_attempt", killed)
    with pytest.raises(Exception, match="killed"):
        st.append_history(stream(), path, ckpt).awaitTermination()
    assert st.commits(spark, path).count() == 0 and st.history(spark, path).count() == 0
    monkeypatch.setattr(st, "commit_attempt", real)
    st.append_history(stream(), path, ckpt).awaitTermination()
    assert st.history(spark, path).count() == 40 and st.commits(spark, path).first()["n_rows"] == 40

    def dies_after(*a):
        real(*a)
        raise RuntimeError("killed after commit")

    spark.createDataFrame([(100, "http://h/1"), (100, "http://h/2")], "id long, url string").write.mode("append").parquet(src)
    monkeypatch.setattr(st, "commit_attempt", dies_after)
    with pytest.raises(Exception, match="killed"):
        st.append_history(stream(), path, ckpt).awaitTermination()
    monkeypatch.setattr(st, "commit_attempt", real)
    st.append_history(stream(), path, ckpt).awaitTermination()       # the batch runs again and finds its commit
    rows = st.history(spark, path)
    assert rows.count() == 42 and rows.filter("id = 100").count() == 2 and st.commits(spark, path).count() == 2
    assert st.damaged_batches(spark, path).count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    from lurelens import session
    before = session._SCRATCH.pop(spark.sparkContext.applicationId, [])
    kept = session.materialize(spark.range(5), "t-clear")
    path = session._SCRATCH[spark.sparkContext.applicationId][0]
    assert kept.count() == 5 and session.clear_scratch(spark) == 1 == 1 + session.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
    session._SCRATCH[spark.sparkContext.applicationId] = before
