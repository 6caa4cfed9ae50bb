"""Fitted models: guards before a fit, blended scores re-derived from the
probabilities the query itself returns."""
import pytest
from pyspark.sql import functions as F

from lurelens.operators import evaluate as ev
from lurelens.operators import fitted as ft
from lurelens.operators import models as md
from lurelens.operators import scoring as sc
from lurelens.operators import text_model as tm
from lurelens.plans import q_models as qm
from lurelens.sources.corpora import email_corpus, url_corpus

SF = "/root/testdata/sf0.001"


def test_guards(spark):
    with pytest.raises(ValueError):
        md.tabular_pipeline([], md.boosted_trees())
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "label double, a double")
    with pytest.raises(ValueError):
        md.fit(md.tabular_pipeline(["a"], md.boosted_trees()), one)
    with pytest.raises(ValueError):
        md.fit(md.tabular_pipeline(["a"], md.boosted_trees()), one.limit(0))


@pytest.fixture(scope="module")
def small_models(spark):
    train, test = qm._sides(qm.url_training_table(spark, SF))
    tree = md.fit(md.tabular_pipeline(qm.URL_FEATURES, md.boosted_trees(3, 3)), train)
    wood = md.fit(md.tabular_pipeline(qm.URL_FEATURES, md.random_forest(5, 4, weight_col=None)), train)
    text = tm.fit(train.select("label", "text"), buckets=1 << 12, max_iter=5)
    return ft.Models(tree, wood, text), test


def test_url_models_find_the_planted_signal(spark, small_models):
    models, test = small_models
    scored = md.with_probability(models.boosted, test).select(F.col("p").alias("score"), "label")
    assert ev.exact_auc(scored).collect()[0]["auc"] > 0.5


def test_url_blend(spark, small_models):
    models, _ = small_models
    urls = url_corpus(spark, SF)
    plain = {r.page_id: r for r in sc.score_urls(urls).collect()}
    rows = ft.score_urls(urls, models, reference_year=2024).collect()
    assert len(rows) == len(plain) == urls.count()
    seen = 0
    for r in rows:
        base = plain[r.page_id].risk_score
        if base >= 1 or plain[r.page_id].error is not None:
            continue
        vote = 0.4 * r.p_boosted + 0.3 * r.p_forest
        assert r.p_ensemble == pytest.approx(vote)
        s = max(base, vote * 1.1) if vote >= 0.5 else min(base, 0.2)
        s = max(s, r.p_text * 0.9) if r.p_text >= 0.5 else s * 0.85
        assert r.risk_score == pytest.approx(min(s, 1.0), abs=1e-6)
        seen += 1
    assert seen > 0
    only = ft.score_urls(urls, ft.Models(), reference_year=2024).collect()
    assert {r.page_id: r.risk_score for r in only} == {k: v.risk_score for k, v in plain.items()}


def test_mail_blend_without_text_model(spark):
    mails = email_corpus(spark, SF)
    train, _ = qm._sides(qm.training_table(spark, SF))
    models = ft.Models(boosted=md.fit(md.tabular_pipeline(qm.ALL_FEATURES, md.boosted_trees(3, 3)), train))
    plain = {r.email_id: r for r in sc.score_emails(mails).collect()}
    rows = ft.score_emails(mails, models, 2024).collect()
    assert len(rows) == len(plain)
    seen = 0
    for r in rows:
        o = plain[r.email_id]
        if o.is_legitimate or o.error is not None or o.risk_score >= 1:
            continue
        assert r.p_text is None and r.p_ensemble == r.p_boosted
        s = max(o.risk_score, r.p_boosted * 1.1) if r.p_boosted >= 0.5 else o.risk_score * 0.4
        assert r.risk_score == pytest.approx(min(s, 1.0), abs=1e-6)
        seen += 1
    assert seen > 0
