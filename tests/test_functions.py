"""Column builders, sources and sinks on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import maps, vectors
from corpusloom.functions import text as tx
from corpusloom.operators import curate, metrics, model, split, synth, tokens
from corpusloom.plans import flows
from corpusloom.sources import readers, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def matrix(spark, *cells):
    return spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")


@pytest.mark.parametrize("text,selected,label", [
    ("Lesión PIGMENTADA", True, "revisar_manual"), ("queratosis actinica", True, "revisar_manual"), ("hemangiomas", True, "revisar_manual"),
    ("x" * 1600 + "melanoma", True, "urgente"), ("piel sana", False, "revisar_manual"), ("", False, "revisar_manual"),
])
def test_keywords(spark, text, selected, label):
    assert one(spark, text, lambda c: tx.contains_any(c, config.DOMAIN_TERMS)) is selected
    assert one(spark, text, lambda c: curate.suggested_label(c, config.URGENT_TERMS)) == label


def test_text_builders(spark):
    assert one(spark, "\n a\nb \n", lambda c: tx.clean_truncate(c, 1500)) == "a b"
    assert one(spark, "  a b  c", tx.word_count) == 3
    assert one(spark, "", tx.word_count) == 0
    assert one(spark, " C44.311 ", tx.normalize_code) == "c44311"
    assert one(spark, "a/b/c.txt", tx.stem) == "c"
    assert one(spark, 0, lambda c: tx.ratio(F.lit(3), c), "int") is None
    assert one(spark, 0.1234, tx.signed, "double") == "+0.1234"
    assert one(spark, "a,b", tx.pretokens) == ["a", ",", "b"]
    assert one(spark, ["a"], lambda c: tokens.pad(c, 3), "array<string>") == ["a", "[PAD]", "[PAD]"]


def test_compare_in_any_order(spark):
    """The mean is that of the ratios' exact sum, to 2^-52 or its last places, and equal bit for bit whatever the rows' order and partitions."""
    import math
    import random
    from fractions import Fraction

    drawn = random.Random(5)
    for ratios in ([0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.0, 3e6 + 1 / 3, *(drawn.randrange(1, 40000) / drawn.randrange(1, 20000) for _ in range(3000))]):
        exact, means = float(sum(map(Fraction, ratios)) / len(ratios)), set()
        for rows, size in ((ratios, 1), (ratios[::-1], 1), (sorted(ratios), 3)):
            df = spark.createDataFrame([("a", x) for x in [*rows, None]], "tokenizer string, tokens_per_word double").coalesce(size)
            row = tokens.compare(df).first()
            assert row.n == len(ratios) + 1
            means.add(row.mean_ratio)
        assert len(means) == 1 and abs(means.pop() - exact) <= max(2 * math.ulp(exact), 2.0 ** -52)


def test_vectors(spark):
    assert one(spark, [1.0, 3.0, 3.0], vectors.argmax, "array<float>") == 1
    p = one(spark, [1000.0, 1000.0], vectors.softmax, "array<float>")
    assert p == [0.5, 0.5]


def test_maps(spark):
    assert one(spark, "otro", lambda c: maps.lookup(c, config.LABEL_IDS)) is None
    assert one(spark, "mel", lambda c: maps.lookup_strict(c, config.CATEGORY_LABELS)) == "urgente"
    with pytest.raises(Exception, match="no such key"):
        one(spark, "otro", lambda c: maps.lookup_strict(c, config.CATEGORY_LABELS))


def test_prefixes(spark):
    rows = spark.createDataFrame([(" C44.311 ",), ("i10",), (None,), ("l57.0",)], "codigo string")
    got = {(r.category, r.label) for r in curate.prefix_join(rows, "codigo", config.CODE_PREFIXES).collect()}
    assert got == {("bcc", "urgente"), ("akiec", "urgente")}


@pytest.mark.parametrize("cells,accuracy,f1,recall", [
    ((15, 0, 11, 0), 0.5769, 0.3659, 0.0), ((13, 2, 6, 5), 0.6923, 0.6601, 0.4545), ((8, 7, 5, 6), 0.5385, 0.5357, 0.5455), ((0, 0, 0, 0), 0, 0, 0), ((3, 0, 0, 0), 1, 1, 0),
])
def test_metrics(spark, cells, accuracy, f1, recall):
    r = metrics.metrics(matrix(spark, *cells)).first()
    assert (round(r.accuracy, 4), round(r.f1_macro, 4), round(r.recall, 4)) == (accuracy, f1, recall)


def test_goals_and_majority(spark):
    assert metrics.goals(spark.createDataFrame([(0.85, 0.75)], "recall double, f1_macro double")).first() == (True, False)
    assert metrics.majority_class(spark.createDataFrame([(0,), (1,), (None,)], "y int"), "y").first().majority == 0
    with pytest.raises(ValueError, match="1 rows"):
        metrics.require_labels(spark.createDataFrame([(0,), (None,)], "y int"), "y")


@pytest.mark.parametrize("n,sizes", [(18, (12, 2, 4)), (19, (13, 2, 4)), (20, (14, 3, 3)), (22, (15, 3, 4)), (90, (62, 13, 15))])
def test_split_sizes(spark, n, sizes):
    rows = spark.range(n).withColumn("s", F.lit("a"))
    got = split.stratified_split(rows, "s", "id")
    count = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert (count["train"], count["val"], count["test"]) == sizes
    again = split.stratified_split(rows.repartition(7), "s", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_generate(spark):
    made = synth.generate(spark, {"mel": ["{u} hace {t}"], "nv": ["{u}, {u}"]}, {"u": ["a", "b"], "t": ["1", "2"]}, per_category=3).collect()
    assert len(made) == 5 and not any("{" in r.text for r in made) and {r.label for r in made if r.category == "mel"} == {"urgente"}


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'he said "x"'), ("line\nbreak", " edge "), ("ü", "z")]
    sinks.write_csv(spark.createDataFrame(rows, "a string, b string"), str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c"), "a string, b string").collect())) == sorted(rows)


def test_documents_and_codes(spark, tmp_path):
    for name in ("train", "dev"):
        (tmp_path / name / "deep").mkdir(parents=True)
    (tmp_path / "train/deep/s1.txt").write_bytes(b"  carcinoma\r\nbasocelular melanoma\xff ")
    (tmp_path / "dev/s2.txt").write_text("nada")
    (tmp_path / "dev/_codes.tsv").write_text("s2\tD22.1\ns9\tC43\n")
    (tmp_path / "codes.tsv").write_text("s1\tC44.42\ns1\tl57.0\ns1\ti10\n")
    got = flows.filter_by_code(spark, {"train": str(tmp_path / "codes.tsv")}, {"train": str(tmp_path / "train")}, "cita").collect()
    assert sorted((r.categoria_ham10000, r.texto) for r in got) == [("akiec", "carcinoma basocelular melanoma"), ("bcc", "carcinoma basocelular melanoma")]
    found = flows.filter_by_keyword(spark, str(tmp_path), "cita").collect()
    assert [(r.archivo_origen, r.etiqueta_urgencia_sugerida) for r in found] == [("s1.txt", "urgente")]
    assert readers.list_files(spark, str(tmp_path / "train"), ".txt").count() == 1


def test_json_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "té")], "n int, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j"), "n int, s string").first() == (1, "té")
    assert '"s" : "té"' in sinks.to_pretty_json(df)
    blocks = curate.review_blocks(spark.createDataFrame([("b", "x", "2"), ("a", "y", "1")], "f string, l string, t string"), "f", "l", "t")
    sinks.write_report(blocks, str(tmp_path / "r"), "f")
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text.index("CASO 1 de 2 — archivo: a") < text.index("CASO 2 de 2 — archivo: b")


def test_train_evaluate_save(spark, tmp_path):
    real = spark.createDataFrame([("lunar que sangra", "mel", "urgente")], "texto string, categoria_ham10000 string, etiqueta_urgencia string")
    templates = {"mel": ["lunar {u} sangra {t}"], "nv": ["lunar {u} parejo {t}"]}
    corpus = flows.build_corpus(spark, real, templates, {"u": list("abcdef"), "t": list("ghij")})
    fitted, report = flows.train_and_evaluate(corpus)
    assert {r.metric for r in report.collect()} == {"accuracy", "f1_macro", "recall"}
    model.save(fitted, str(tmp_path / "m"))
    label, p = model.predict_one(spark, model.load(str(tmp_path / "m")), "texto", "lunar que sangra")
    assert label in config.LABEL_IDS and 0 <= p <= 1 and model.parameter_count(fitted) == 4097


def test_split_of_nulls_and_repeats(spark):
    """NULL strata and keys, repeated rows, an empty table, and strata of one row: sizes by stratum are those of the rule."""
    rows = [(i % 40, [None, "a", "b"][i % 3]) for i in range(300)] + [(None, "a"), (None, None), (1, "only")]
    df = spark.createDataFrame(rows, "id int, s string")
    got = split.stratified_split(df, "s", "id")
    assert got.columns == ["id", "s", "split"] and got.count() == len(rows)
    for s in {r[1] for r in rows}:
        n = sum(r[1] == s for r in rows)
        of = [r.split for r in got.where(F.col("s").eqNullSafe(F.lit(s))).collect()]
        assert (of.count("train"), of.count("val"), len(of)) == (int(n * 0.7), int(n * 0.15), n)
    assert split.stratified_split(df.limit(0), "s", "id").count() == 0


def test_presentation(spark):
    assert one(spark, 1.6049, tx.fixed, "double") == "1.60"
    assert one(spark, 0.57692307, tx.rounded, "double") == 0.5769
    assert one(spark, "melanoma", lambda c: tx.padded(c, 15)) == "melanoma       " and one(spark, "x" * 20, lambda c: tx.padded(c, 15)) == "x" * 20


def test_guards_and_registry(spark, tmp_path):
    from corpusloom.operators import model

    rows = spark.createDataFrame([("good day", 0.0), ("bad night", 1.0)] * 4, "text string, label double")
    with pytest.raises(ValueError, match="no rows to train on"):
        model.train(rows.limit(0), "text", "label")
    fitted = model.train(rows, "text", "label")
    label, p = model.predict_probabilities(spark, fitted, "text", "bad night")
    assert label == "urgente" and set(p) == set(config.LABEL_IDS) and sum(p.values()) == pytest.approx(1) and p["urgente"] > 0.5
    model.write_registry(spark, fitted, str(tmp_path / "r"), train_rows=8)
    kept = spark.read.json(str(tmp_path / "r")).first().asDict()
    assert kept["train_rows"] == 8 and kept["max_iter"] == config.HYPERPARAMETERS["max_iter"] and kept["parameters"] == 4097 and kept["seed"] == 42


def test_batches_are_padded_to_their_longest(spark):
    rows = [(i, ["t"] * (i % 5)) for i in range(10)] + [(10, None)]
    got = tokens.pad_batches(spark.createDataFrame(rows, "i int, t array<string>").coalesce(1), "t", 4).orderBy("i").collect()
    assert [r.real for r in got] == [len(t or []) for _, t in rows]
    for at in (0, 4, 8):
        part = got[at : at + 4]
        assert {len(r.t) for r in part} == {max(r.real for r in part)}
        assert all(r.t == ["t"] * r.real + ["[PAD]"] * (len(r.t) - r.real) for r in part)


def test_tokenizer_of_a_file(spark, tmp_path):
    tk = pytest.importorskip("tokenizers")
    own = tk.Tokenizer(tk.models.WordPiece({"[UNK]": 0, "mela": 1, "##noma": 2, "nevus": 3}, unk_token="[UNK]"))
    own.pre_tokenizer = tk.pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    f = tokens.load_tokenizer(str(tmp_path / "t.json"))
    df = spark.createDataFrame([("melanoma nevus",), ("x",), (None,)], "text string")
    assert [r[0] for r in df.select(f(F.col("text"))).collect()] == [["mela", "##noma", "nevus"], ["[UNK]"], []]
    assert {(r.term, r.n_tokens) for r in tokens.key_terms(spark, ["melanoma", "nevus"], {"file": f}).collect()} == {("melanoma", 2), ("nevus", 1)}


def test_literal_cases(spark):
    df = readers.literal_cases(spark, [{"texto": "a", "categoria": "mel"}, {"texto": "b", "fuente": "x"}])
    assert df.columns == ["texto", "categoria", "fuente"] and sorted(map(str, df.collect())) == sorted(["Row(texto='a', categoria='mel', fuente=None)", "Row(texto='b', categoria=None, fuente='x')"])


def test_stream(spark, tmp_path):
    from corpusloom.streaming.curation import keyword_stream

    spark.createDataFrame([(1, "un melanoma"), (2, "nada")], "id int, text string").write.parquet(str(tmp_path / "in"))
    q = keyword_stream(spark, str(tmp_path / "in"), "id int, text string", "text").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.table("found").collect()] == [1]
