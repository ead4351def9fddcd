"""From a corpus with splits to an adapter in a store, its registry, its epochs, and its difference from the baseline."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.store import Store
from corpusloom.plans import flows


def test_flow(spark, tmp_path):
    words = [("lunar que sangra", "urgente"), ("mancha irregular negra", "urgente"), ("lunar parejo", "no_urgente"), ("peca clara", "no_urgente")]
    rows = [(f"{w} desde hace {i} días", y, ["train", "train", "train", "val", "test"][i % 5]) for i in range(20) for w, y in words]
    corpus = spark.createDataFrame(rows, "texto string, etiqueta_urgencia string, split string")
    store = Store(spark, str(tmp_path / "models"))
    epochs = flows.fine_tune(corpus, store, "urgency", str(tmp_path / "registry"), maxIter=3, batchSize=24, stepSize=0.05, rank=4, alpha=8.0)
    got = epochs.orderBy("epoch").collect()
    assert [r.epoch for r in got] == [0, 1, 2, 3] and {r.rows for r in got} == {16} and got[-1].loss < got[0].loss
    kept = spark.read.json(str(tmp_path / "registry")).first().asDict()
    assert (kept["rank"], kept["epochs"], kept["batch_size"], kept["seed"], kept["n_train"], kept["n_val"], kept["n_test"]) == (4, 3, 24, 42, 48, 16, 16)
    assert kept["base"] == "urgency-base" and kept["trained_weights"] == 4 * (4096 + 32) + 66 and kept["base_digest"] == store.get("urgency-base").fingerprint
    report = {r.metric: r for r in flows.evaluate_adapter(corpus, store, "urgency").collect()}
    assert set(report) == {"accuracy", "f1_macro", "recall"} and report["accuracy"].baseline == 0.5 and report["accuracy"].delta > 0.3
    with pytest.raises(ValueError, match="no test rows"):
        flows.evaluate_adapter(corpus.where("split <> 'test'"), store, "urgency")
    with pytest.raises(ValueError, match="rows without a known label"):
        flows.fine_tune(corpus.withColumn("etiqueta_urgencia", F.lit("otro")), store, "x", str(tmp_path / "r2"))
