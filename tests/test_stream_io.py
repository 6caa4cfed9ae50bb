"""Batch equals stream; file sources and sinks round trip."""
from pyspark.sql import functions as F

from lurelens.operators import scoring as sc
from lurelens.session import scratch_path
from lurelens.sources import io
from lurelens.sources.corpora import read_table, url_corpus, url_corpus_from_pages
from lurelens.streaming import streams as st


def test_url_stream_equals_batch(spark, sf001):
    schema = read_table(spark, sf001, "pages").schema
    stream = st.file_stream(spark, sf001, schema, glob="pages.parquet").select("page_id", "url")
    out = st.run_to_table(spark, url_corpus_from_pages(stream), "t-w1", st.score_url_stream)
    batch = sc.score_urls(url_corpus(spark, sf001))
    cols = ["page_id", "risk_score", "risk_level", "risk_factors"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from lurelens.plans import q_stream as qs
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), "id").alias("url"))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("Title\nsee http://h.example/"), "id").alias("text"))
    for n in (1, 3):
        sf = str(tmp_path / f"of-{n}")
        pages.repartition(n).write.parquet(f"{sf}/pages.parquet")
        docs.repartition(n).write.parquet(f"{sf}/documents.parquet")
        assert qs.q_s12(spark, sf).first()[0] == 60
        assert sorted(r[0] for r in qs.q_w1(spark, sf).select("page_id").collect()) == list(range(60))
        assert sorted(r[0] for r in qs.q_w2(spark, sf).select("email_id").collect()) == list(range(60))
        assert sorted(r[0] for r in qs.q_w3(spark, sf).select("page_id").collect()) == list(range(60))


def test_history_is_idempotent_per_batch(spark, sf001):
    schema = read_table(spark, sf001, "pages").schema
    stream = st.file_stream(spark, sf001, schema, glob="pages.parquet").select("page_id", "url")
    path, ckpt = scratch_path(spark, "t-hist"), scratch_path(spark, "t-hist-ckpt")
    st.append_history(st.score_url_stream(stream), path, ckpt).awaitTermination()
    n1 = st.history_count(spark, path).collect()[0][0]
    # restarting with the same checkpoint processes nothing new
    st.append_history(st.score_url_stream(stream), path, ckpt).awaitTermination()
    assert st.history_count(spark, path).collect()[0][0] == n1 == read_table(spark, sf001, "pages").count()


def test_csv_roundtrip_keeps_quotes_newlines_blanks(spark):
    rows = [(1, ' lead "quoted"', 'line1\nline2, comma ', "phishing"), (2, "", "x", "0")]
    df = spark.createDataFrame(rows, "email_id long, subject string, body string, label string")
    path = scratch_path(spark, "t-csv")
    io.write_csv(df, path)
    back = {r["email_id"]: r for r in io.load_email_dataset(spark, path, keep=[F.col("email_id").cast("long")]).collect()}
    assert back[1]["subject"] == ' lead "quoted"' and back[1]["body"] == ' lead "quoted" line1\nline2, comma '
    assert back[1]["label"] == 1 and back[2]["label"] == 0


def test_url_lines_manifest_metrics(spark):
    p = scratch_path(spark, "t-lines")
    spark.createDataFrame([("  http://a.com  ",), ("",), ("   ",), ("b.org",)], "value string").write.text(p)
    assert sorted(r["url"] for r in io.read_url_lines(spark, p).collect()) == ["b.org", "http://a.com"]
    m = scratch_path(spark, "t-manifest")
    io.write_manifest(spark, m)
    from lurelens.functions.manifest import ALL_FEATURES
    assert io.read_manifest(spark, m) == list(ALL_FEATURES)
    mp = scratch_path(spark, "t-metrics")
    io.write_json(spark.createDataFrame([("xgboost_url", 0.5, None, 0.4, 0.45)],
                                        "model string, accuracy double, precision double, recall double, f1 double"), mp)
    from lurelens.operators.evaluate import metrics_with_defaults
    got = {r["model"]: r for r in metrics_with_defaults(spark, io.read_metrics(spark, mp), keep_all_defaults=True).collect()}
    assert got["xgboost_url"]["accuracy"] == 0.5 and got["xgboost_url"]["precision"] == 0.9838
    assert got["xgboost_email"]["f1"] == 0.8849
