"""The adapter against finite differences, and its training, repetition, storage and errors on hand-made texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import adapter, model
from corpusloom.sources import sinks

FEATURES, HIDDEN, LENGTH = 256, 6, 12


@pytest.fixture(scope="module")
def rows(spark):
    """Texts of two kinds, told apart by some of their words; one in four is for validation."""
    rng = random.Random(2)
    marks = {0: ["calm", "plain", "mild"], 1: ["harsh", "sharp", "grim"]}
    out = []
    for i in range(160):
        y = i % 2
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 10))] + rng.sample(marks[y], 2)
        rng.shuffle(words)
        out.append((i, " ".join(words), y, i % 8 >= 6))
    out += [(200, None, 0, False), (201, "", 1, True), (202, out[0][1], 0, False)]
    return spark.createDataFrame(out, "id int, text string, label int, held boolean").cache()


@pytest.fixture(scope="module")
def base(rows):
    return adapter.fit_base(rows, "text", FEATURES, HIDDEN, LENGTH)


def estimator(base, **more):
    return adapter.AdapterClassifier(base=base, **{"validationIndicatorCol": "held", "maxIter": 4, "batchSize": 40, "stepSize": 0.2, "rank": 3, "alpha": 6.0, **more})


@pytest.fixture(scope="module")
def fitted(rows, base):
    return estimator(base).fit(rows)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    base = adapter.Base(rng.random(20) + 0.1, rng.standard_normal((20, 4)), 5)
    tensors = adapter.Tensors(20, 4, 2, 3.0)
    flat = rng.standard_normal(tensors.size)
    ids = np.array([[1, 2, 2, -1, -1], [0, 19, 3, 4, 5], [-1] * 5])
    labels = np.array([1, 0, 1])

    def loss(x):
        return -np.log(adapter.softmax(tensors.logits(base, x, ids))[np.arange(3), labels]).sum()

    got = tensors.gradient(base, flat, ids, labels, 0.0, np.random.default_rng(1))
    for i in range(tensors.size):
        step = np.zeros(tensors.size)
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_base_has_the_leading_directions(rows, base):
    """The span of the directions is that of the scatter's eigenvectors, as far as these stand apart."""
    assert base.matrix.shape == (FEATURES, HIDDEN) and base.size == FEATURES * HIDDEN
    q = base.matrix / np.sqrt(FEATURES / HIDDEN)
    assert np.allclose(q.T @ q, np.eye(HIDDEN))
    ids = np.array([r[0] for r in rows.select(adapter.token_ids(F.col("text"), FEATURES, LENGTH)).collect()])
    at, weights = adapter._weights(ids, base.idf)
    x = np.zeros((len(ids), FEATURES))
    adapter_rows = np.repeat(np.arange(len(ids))[:, None], LENGTH, axis=1)
    np.add.at(x, (adapter_rows, at), weights)
    best = np.linalg.svd(x, full_matrices=False)[1]
    assert (np.linalg.norm(x @ q) ** 2) > 0.75 * (best[:HIDDEN] ** 2).sum()


def test_training_beats_the_base(rows, fitted):
    """Loss and accuracy on rows that weren't trained on, epoch by epoch; only the adapter's weights are trained."""
    h = fitted.history
    assert [x["epoch"] for x in h] == [0, 1, 2, 3, 4] and {x["rows"] for x in h} == {rows.where("held").count()}
    assert h[-1]["loss"] < 0.5 * h[0]["loss"] and h[-1]["accuracy"] > 0.95 and h[-1]["f1_macro"] > 0.95
    assert fitted.trained_size == 3 * (FEATURES + HIDDEN) + 2 * HIDDEN + 2
    frame = fitted.history_frame(rows.sparkSession)
    assert frame.columns == ["epoch", "rows", "loss", "accuracy", "f1_macro", "recall"] and frame.count() == 5


def test_update_starts_at_the_base(base, fitted):
    """B is 0 at the start, so that the update is; after training it isn't, and its rank is what was asked for."""
    tensors = fitted.tensors(base)
    first, last = tensors.split(tensors.start(42)), tensors.split(fitted.flat)
    assert not first["B"].any() and np.linalg.matrix_rank(last["A"] @ last["B"]) == 3


def test_equal_seeds_repeat(rows, base, fitted):
    again = estimator(base).fit(rows.repartition(7))
    assert (again.flat == fitted.flat).all() and again.history == fitted.history
    other = estimator(base, seed=7, maxIter=1).fit(rows)
    assert (other.flat != fitted.flat).any()
    assert adapter.fit_base(rows.repartition(5), "text", FEATURES, HIDDEN, LENGTH).fingerprint == base.fingerprint


def test_shares_add_up(rows, base, fitted, monkeypatch):
    """Batches dealt to several tasks give the gradients of one, up to dropout, which is drawn by share."""
    monkeypatch.setattr(adapter, "SHARE_ROWS", 7)
    many = estimator(base, dropout=0.0).fit(rows)
    monkeypatch.setattr(adapter, "SHARE_ROWS", 1 << 14)
    one = estimator(base, dropout=0.0).fit(rows)
    assert np.allclose(many.flat, one.flat, atol=1e-4)


def test_runs_of_batches(rows, base, fitted, monkeypatch):
    """Batches that fit a share are trained in runs of one job each, with the weights of a job for each batch."""
    jobs = rows.sparkSession.sparkContext.statusTracker()

    def fit(group, size):
        rows.sparkSession.sparkContext.setJobGroup(group, group)
        out = estimator(base, batchSize=size, dropout=0.0, maxIter=2).fit(rows)
        rows.sparkSession.sparkContext.setJobGroup("other", "other")
        return out, len(jobs.getJobIdsForGroup(group))

    together, few = fit("runs", 8)
    monkeypatch.setattr(adapter, "SHARE_ROWS", 8)  # a run is one batch
    apart, many = fit("steps", 8)
    assert (together.flat == apart.flat).all() and together.history == apart.history
    assert few < 20 and many >= few + 2 * 12  # some 16 batches an epoch


def test_stored_apart(spark, rows, base, fitted, tmp_path):
    base.save(spark, str(tmp_path / "base"))
    fitted.write().save(str(tmp_path / "adapter"))
    again = adapter.AdapterModel.load(str(tmp_path / "adapter"))
    assert again.uid == fitted.uid and again.history == fitted.history and again.getOrDefault("rank") == 3 and again.getSeed() == 42
    with pytest.raises(ValueError, match="needs its base"):
        again.transform(rows)
    with pytest.raises(ValueError, match="another base"):
        again.attach(adapter.Base(base.idf, base.matrix + 1e-9, LENGTH))
    again.attach(adapter.Base.load(spark, str(tmp_path / "base")))
    want = fitted.transform(rows).select("id", "predicted", "probability").orderBy("id").collect()
    assert again.transform(rows).select("id", "predicted", "probability").orderBy("id").collect() == want
    with pytest.raises(Exception, match="exist"):
        fitted.write().save(str(tmp_path / "adapter"))
    fitted.write().overwrite().save(str(tmp_path / "adapter"))


def test_rows_that_are_odd(spark, rows, base, fitted):
    got = {r.id: r for r in fitted.transform(spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "calm " * 5000, 9)], "id int, text string, share int")).collect()}
    assert got[1].probability == got[2].probability and got[3].predicted == 0 and got[3].share == 9
    assert fitted.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows to train on"):
        estimator(base).fit(rows.where("held"))
    with pytest.raises(ValueError, match="2 rows without a known label"):
        estimator(base).fit(rows.withColumn("label", F.when(F.col("id") == 1, 5).when(F.col("id") != 2, F.col("label"))))
    with pytest.raises(ValueError, match="needs a base"):
        adapter.AdapterClassifier().fit(rows)
    before = len(sinks._NAMED)
    plain = estimator(base, validationIndicatorCol=None, maxIter=1).fit(rows)
    assert plain.history == [] and len(sinks._NAMED) == before  # its batches are removed


@pytest.mark.parametrize("size", [1, 8, 1000])
def test_pipeline_in_batches(rows, size):
    own = model.train(rows.withColumn("label", F.col("label").cast("double")), "text", "label", features=64)
    a = {r.id: r for r in model.predict(own, rows, "text").collect()}
    b = {r.id: r for r in model.predict_in_batches(own, rows, "text", size).collect()}
    assert set(a) == set(b)
    for i, r in a.items():
        assert b[i].predicted == r.predicted and b[i].probability == pytest.approx(r.probability, abs=1e-12) and b[i].text == r.text
