"""The registered queries against their SQL, and the pipeline against plain versions."""

import pytest

import corpus_pipeline
from corpusloom.llm import queries
from tests.compare import same
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_all_are_there():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_pipeline(spark, tmp_path):
    """Each stage keeps what the plain versions keep, over rows with every kind of trouble."""
    rows = brute.documents()
    base = rows[5][1].split()
    items = [(1, " ".join(base[10:30])), (2, rows[16][1])]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1), (15, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [r for r in rows if not brute.measures(r[1])[-1]]  # two labels certify nothing
    classes = brute.near_duplicates(good)
    first = {c: i for i, (k, _, c) in reversed(list(enumerate(classes))) if k == c}
    single = [good[i] for i in sorted(first.values())]
    clean = [r for r, c in zip(single, brute.contamination([r[:2] for r in single], items)) if not c[-1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in clean) and len(clean) > 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in brute.SCHEMA.split(", ")]


def test_pipeline_rows(spark, tmp_path):
    """The digests of what is left are those of the plain pseudonyms' ids, and n_chars is true on the way."""
    import base64
    import hashlib
    import random

    import public_tokenizers
    import tiktoken

    rng = random.Random(12)
    values = ["4111111111111111", "jo.doe@mail.example.com", "1984-02-29", "788 555 0874", "password=" + "ab" * 20, "3/4/1984", "nothing"]
    rows = [(i, f"{brute.sentence(rng, 20)} {values[i % 7]} {brute.sentence(rng, 20)} é", "en", "s", 3, "v", i) for i in range(30)] + [(30, None, None, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars int, n_values string, _k long"
    docs = spark.createDataFrame(rows, kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[8][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, *_ in rows:
        if text is not None and i != 8:
            new = brute.pseudonymise(text, "corpusloom")[0]
            ids = own.encode_ordinary(new)
            want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(new.encode())))
    assert brute.ordered(corpus_pipeline.run(spark, str(tmp_path)).collect()) == brute.ordered(want)
    out = corpus_pipeline.pseudonyms(spark, docs, "")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0
