"""What Python workers hold at once is a stretch of an Arrow batch, however many rows the batch has."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import matching, workers
from corpusloom.operators import curate, model, tokens


def test_parts_are_bounded():
    texts = ["a" * (i % 700) for i in range(3000)] + [None, "", "x" * 5000, "y"]
    for column in (pa.array(texts, pa.string()), pa.array([[t, t] if t else t and [] for t in texts], pa.list_(pa.string()))):
        for array in (column, column.slice(7, 2990)):
            got = list(workers.parts(array, rows=100, size=4096))
            assert pa.concat_arrays(got) == array
            assert all(len(x) <= 100 and (len(x) == 1 or workers._bytes(x) <= 4096) for x in got)
    assert list(workers.parts(pa.array([], pa.string()))) == []


def test_library_encodes_a_few_texts_at_once(spark, monkeypatch):
    """Batches of encodings are bounded by the bytes of their texts."""
    tk = pytest.importorskip("tokenizers")
    seen = []

    class Own:
        def encode_batch(self, texts, add_special_tokens):
            seen.append(sum(map(len, texts)))
            return [type("E", (), {"tokens": t.split()}) for t in texts]

        no_truncation = no_padding = lambda self: None

    monkeypatch.setattr(tk, "Tokenizer", type("Maker", (), {"from_str": staticmethod(lambda s: Own())}))
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: f)
    texts = ["ab cd " * 1000] * 100 + [None, ""]
    got = tokens.tokenizer_of("")(pa.array(texts))
    assert max(seen) <= tokens.ENCODED_BYTES and len(got) == 102 and got[0].as_py()[:2] == ["ab", "cd"] and got[100].as_py() == []


def test_equal_terms_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "a Term7 b"), (2, "none"), (3, None)], "id int, text string")
    terms = [f"term{i}" for i in range(matching.CHAIN + 5)]
    out = curate.keyword_candidates(docs, "text", terms, [t.upper() for t in terms])
    assert [tuple(r) for r in out.collect()] == [(1, "a Term7 b", "urgente")]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_sparse_features_are_sent(spark):
    """No vector is written out in full on its way to Python."""
    rows = spark.createDataFrame([("good fine", 0.0), ("bad", 1.0), ("", 0.0), (None, 1.0)] * 3, "t string, y double")
    fitted = model.train(rows, "t", "y", features=1 << 12)
    out = model.predict_in_batches(fitted, rows, "t", 5)
    assert "unwrap_udt" in out._jdf.queryExecution().analyzed().toString() and "vector_to_array" not in out._jdf.queryExecution().analyzed().toString()
    a, b = ({r.t: (r.predicted, round(r.probability, 10)) for r in x.collect()} for x in (model.predict(fitted, rows, "t"), out))
    assert a == b


def test_words_are_cut_up_by_stretches(monkeypatch):
    """Pieces of a batch are those of its stretches put together, also behind an offset and with NULL lists."""
    from corpusloom.operators import wordpiece

    caught, seen = [], []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: caught.append(f))

    def few(lists):
        for x in workers.parts(lists, rows=3):
            seen.append(len(x))
            yield x

    monkeypatch.setattr(wordpiece, "parts", few)
    wordpiece.tokenizer(["[UNK]", "a", "##b", "c"])
    lists = pa.array([["ab", "c"], [], ["x"], ["c"], ["ab"], ["abb", "x"], [], ["a"]], pa.list_(pa.string()))
    want = [["a", "##b", "c"], [], ["[UNK]"], ["c"], ["a", "##b"], ["a", "##b", "##b", "[UNK]"], [], ["a"]]
    assert caught[0](lists).to_pylist() == want and caught[0](lists.slice(2)).to_pylist() == want[2:] and max(seen) == 3
