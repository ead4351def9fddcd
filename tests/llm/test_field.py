"""The field's likelihood at any size of its weights, its two kinds of labels, and its training on the registered query's rows."""

import itertools
import random
import warnings

import numpy as np
import pytest

from corpusloom.llm import crf


def enumerated(e, moves):
    """log Z, marginals and P(all 0) of a short chain, in logs."""
    paths = list(itertools.product((0, 1), repeat=len(e)))
    logs = np.array([sum(e[t] for t in range(len(e)) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:])) for y in paths])
    top = logs.max()
    log_z = top + np.log(np.exp(logs - top).sum())
    return log_z, np.exp(logs - log_z) @ np.array(paths, dtype=np.float64).reshape(len(paths), len(e)), np.exp(logs[0] - log_z)


@pytest.mark.parametrize("size", [1, 45, 75, 150, 600])
def test_emissions_of_any_size(size):
    rng = np.random.default_rng(size)
    moves = rng.normal(size=(2, 2)) * min(size, 30)
    each = [rng.normal(size=n) * size for n in (1, 3, 0, 6, 2)]
    ends = np.cumsum([len(e) for e in each])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        p, log_z, at, pairs = crf.chains(np.concatenate(each), ends, moves)
    assert np.allclose(pairs.sum(axis=(0, 1)), 1) and len(at) == sum(max(len(e) - 1, 0) for e in each)
    for e, z, q in zip(each, log_z, np.split(p, ends[:-1])):
        if len(e):
            want_z, want_p, _ = enumerated(e, moves)
            assert z == pytest.approx(want_z, rel=1e-9, abs=1e-9) and np.allclose(q, want_p, atol=1e-9)
        else:
            assert z == 0


def test_likelihood_is_never_above_one():
    """Three-word texts, no penalty: the objective is at least 0 whatever the weights."""
    texts = [["scum", "x", "y"]] * 100
    field = crf.Field(crf.Model({"wscum"}), texts, np.array([1.0, 0, 0] * 100))
    for w in (1, 45, 75, 150, 1000):
        x = np.zeros(3 + 5)
        x[1], x[3] = 2 * w, -w  # the word itself, the bias
        value, _ = field(x)
        assert value - crf.PENALTY * float(x @ x) / 2 >= -1e-6


def of_texts(rng, n=120):
    """Toxic where one word follows another; each of the two stands in clean texts as well."""
    texts, toxic = [], []
    for i in range(n):
        words = [f"w{rng.randrange(30)}" for _ in range(8)]
        at = rng.randrange(1, 7)
        if i % 2:
            words[at - 1 : at + 1] = ["you", "scum"]
        elif i % 4:
            words[0], words[7] = "scum", "you"
        else:
            words[rng.randrange(8)] = rng.choice(["you", "scum"])
        texts.append(words)
        toxic.append(bool(i % 2))
    return texts, np.array(toxic)


def test_gradient_with_text_labels():
    texts, toxic = of_texts(random.Random(1), 30)
    texts, toxic = [*texts, ["scum"], ["x"]], np.append(toxic, [True, False])
    truth = np.array([float(y and w == "scum") for t, y in zip(texts, toxic) for w in t])
    field = crf.Field(crf.Model({"wyou", "wscum"}), texts, truth, toxic)
    x = field.start() + np.random.default_rng(2).normal(size=len(field.start())) * 0.4
    _, grad = field(x)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert (field(x + step)[0] - field(x - step)[0]) / 2e-5 == pytest.approx(grad[i], rel=1e-4, abs=1e-4)


def test_context_decides():
    """Neighbours' weights tell toxic texts from clean ones with the same words; without them, or without moves, tags differ."""
    texts, toxic = of_texts(random.Random(3))
    field = crf.Field(crf.Model({"wyou", "wscum"}), texts, np.array([float(y and w == "scum") for t, y in zip(texts, toxic) for w in t]), toxic)
    best = crf.minimise(field, field.start(), crf.FLAT * len(field.truth))
    assert np.linalg.norm(field(best)[1]) <= crf.FLAT * len(field.truth)
    tags = lambda: np.concatenate(crf.Coder(field.model, 1 << 62).marginals(texts)) >= 0.5
    assert (tags() == (field.truth > 0.5)).all()
    kept = field.model.weights.copy()
    field.model.weights = kept * np.array([[0], [1], [0]])
    assert (tags() != (field.truth > 0.5)).any()
    # Runs of states that only the moves can tell: a token without evidence between two that have some.
    runs = [["scum", "gap", "scum", "end", "far"]] * 30 + [["far", "gap", "far", "end", "far"]] * 30
    truth = np.array([1, 1, 1, 0, 0] * 30 + [0] * 150, dtype=np.float64)
    field = crf.Field(crf.Model({"wscum"}), runs, truth)
    crf_x = crf.minimise(field, field.start(), crf.FLAT * len(truth))
    field.load(crf_x)
    field.model.weights = field.model.weights * np.array([[0], [1], [0]])
    with_moves = np.concatenate(crf.Coder(field.model, 1 << 62).marginals(runs)) >= 0.5
    field.model.moves = np.zeros((2, 2))
    assert (with_moves != (np.concatenate(crf.Coder(field.model, 1 << 62).marginals(runs)) >= 0.5)).any()


def test_training_that_does_not_converge_is_an_error(monkeypatch):
    monkeypatch.setattr(crf, "MOST_STEPS", 2)
    monkeypatch.setattr(crf.minimise, "__defaults__", (2, 8))
    rng = random.Random(4)
    rows = [" ".join(f"w{rng.randrange(200)}" for _ in range(30)) + (" scum idiot" if i % 3 == 0 else "") for i in range(300)]
    with pytest.raises(RuntimeError, match="didn't converge"):
        crf.train(rows, [int(i % 3 == 0) for i in range(300)])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_rows(spark, sf):
    """The query's own training ends flat, without a warning, and its held-out rows are told apart."""
    path = f"/root/testdata/{sf}"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        got = crf.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "spans").collect()
    found = sum(r.predicted and r.toxic for r in got)
    flagged, toxic = sum(r.predicted for r in got), sum(r.toxic for r in got)
    assert all(r.spans for r in got if r.predicted)
    if sf == "sf0.1":
        assert found >= 0.9 * toxic and found >= 0.9 * flagged
