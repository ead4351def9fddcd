import pytest

from corpusloom.plans import catalog
from tests.compare import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_reload_changes_nothing(spark, sf_dir):
    row = QUERIES["ml_reload_equivalence"](spark, sf_dir).first()
    assert row.n > 0 and row.n_different == 0


@pytest.mark.parametrize("texts", [
    ["a b,", "", None, " \n\t", "\u00a0\u2003", ",", "d!"],
    ["a\u00a0b,", "c\u3000d e!", "x\x0by.", "\u0085z z\u2028", "\u1680m\u2009n\u202f(o)\u205fp\u2029", "q\x1cr\u200bs."],
    ["a\u2e5db", "c\u061d\u061e", "d\u2e5e\U00012ff1\U00012ff3", "\U00011b05", "e\u1b7d$f"],
    ["", None, "\u3000"], [],
])
def test_tokenizer_compare_odd_texts(spark, tmp_path, texts):
    """Texts without words have no ratio, and white space and punctuation are Unicode's, in the query and in its SQL."""
    import duckdb

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["tokenizer_compare"](spark, str(tmp_path))
    same(df, con, SQL["tokenizer_compare"])
    got, cut = {r.tokenizer: (r.mean_ratio, r.n) for r in df.collect()}, [t.split() for t in texts if t and t.split()]
    assert got == {} if not texts else got["words"] == (1.0 if cut else None, len(texts))


def test_entry_without_training_data(monkeypatch):
    """Whatever part of the training-data queries can't be imported, the others are there."""
    import sys

    import __spark_entry__ as entry

    for missing in ("corpus_pipeline", "corpusloom.llm", "public_tokenizers"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("corpusloom.llm")]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, missing, None)
            assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL), missing
