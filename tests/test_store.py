"""Models by id."""

import numpy as np
import pytest

from corpusloom.operators import adapter, model, store


def test_store(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    base = adapter.Base(np.arange(8.0), np.ones((8, 2)) / 3, 4)
    kept.put("me/base", base)
    assert kept.get("me/base").fingerprint == base.fingerprint
    own = adapter.AdapterModel(np.arange(2.0 * (8 + 2) + 6) / 7, base.fingerprint, [])._with(adapter.AdapterClassifier(base=base, rank=2, textCol="t"), base)
    with pytest.raises(ValueError, match="with the id"):
        kept.put("me/adapter", own)
    kept.put("other", adapter.Base(np.arange(8.0), np.ones((8, 2)), 4))
    with pytest.raises(ValueError, match="with the id"):
        kept.put("me/adapter", own, "other")
    kept.put("me/adapter", own, "me/base")
    again = kept.get("me/adapter")
    rows = spark.createDataFrame([("a b c",), (None,)], "t string")
    assert again.transform(rows).collect() == own.transform(rows).collect()
    kept.put("v1", ["[UNK]", "ñ", "##o"])
    assert kept.get("v1") == ["[UNK]", "ñ", "##o"]
    fitted = model.train(spark.createDataFrame([("good", 0.0), ("bad", 1.0)] * 3, "t string, y double"), "t", "y", features=16)
    kept.put("lr", fitted)
    assert model.predict(kept.get("lr"), rows, "t").collect() == model.predict(fitted, rows, "t").collect()
    with pytest.raises(ValueError, match="there is a model"):
        kept.put("v1", ["x"])
    for bad in ("../x", "a/b/c", "", "a b"):
        with pytest.raises(ValueError, match="not an id"):
            kept.get(bad)
    with pytest.raises(KeyError, match="no model nothing"):
        kept.get("nothing")
