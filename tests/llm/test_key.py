"""The secret of the pseudonyms is never the published one on a cluster."""

from types import SimpleNamespace

import pytest

from corpusloom.llm import pii


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k, default)), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host"])
def test_clusters_need_a_key(master):
    for unset in ({}, {pii.KEY_SETTING: ""}):
        with pytest.raises(ValueError, match="must name the secret"):
            pii.key_of(session(master, **unset))
    assert pii.key_of(session(master, **{pii.KEY_SETTING: "own"})) == "own"


def test_local_masters_may_leave_it(spark):
    assert pii.key_of(session("local[4]")) == pii.key_of(spark) == pii.TEST_KEY
    assert pii.key_of(session("local[4]", **{pii.KEY_SETTING: "own"})) == "own"


def test_clusters_without_a_key_draw_one():
    """The pipeline and op1 run on a cluster that names no key; equal in one application, never the published one."""
    def on(application, **conf):
        own = session("spark://host:7077", **conf)
        own.sparkContext.applicationId = application
        return own

    with pytest.warns(UserWarning, match="isn't set"):
        a, again, b = (pii.key_or_drawn(on(x)) for x in ("app-a", "app-a", "app-b"))
    assert a == again != b and pii.TEST_KEY not in (a, b) and len(a) == 64
    assert pii.key_or_drawn(on("app-a", **{pii.KEY_SETTING: "own"})) == "own"


def test_pipeline_runs_where_no_key_is_named(spark, monkeypatch):
    import corpus_pipeline

    def unset(spark):
        raise ValueError("no key")

    monkeypatch.setattr(pii, "key_of", unset)
    docs = spark.createDataFrame([(1, "write to jane.roe@mail.org"), (2, "nothing")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="isn't set"):
        out = {r.doc_id: r.text for r in corpus_pipeline.pseudonyms(spark, docs, "").collect()}
    assert "jane.roe" not in out[1] and out[1].endswith("@mail.org") and out[2] == "nothing"
