"""WordPiece against the public library, text by text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import tokens, wordpiece

tk = pytest.importorskip("tokenizers")


def library(vocabulary):
    own = tk.Tokenizer(tk.models.WordPiece({p: i for i, p in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=100))
    own.normalizer = tk.normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False)
    own.pre_tokenizer = tk.pre_tokenizers.BertPreTokenizer()
    return own


@pytest.fixture(scope="module")
def vocabulary():
    """Every piece of a public vocabulary, at the start of a word and behind it."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    plain = dict.fromkeys(p.removesuffix("</w>") for p in pieces)
    return ["[UNK]", *dict.fromkeys(x for p in plain if p for x in (p, "##" + p))]


def test_documents(spark, sf_dir, vocabulary):
    """Pieces and ids of all texts are the library's."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").repartition(3)
    got = rows.select("text", wordpiece.tokenizer(vocabulary)(F.col("text")).alias("p"), wordpiece.tokenizer(vocabulary, ids=True)(F.col("text")).alias("i")).collect()
    own = library(vocabulary)
    for r, e in zip(got, own.encode_batch([r.text or "" for r in got], add_special_tokens=False)):
        assert r.p == e.tokens and r.i == e.ids


def test_odd_texts(spark, vocabulary):
    rng = random.Random(4)
    parts = ["a", "Melanoma", "éß", "日本", "\U00020001", " ", "\t", "\n", "\r\n", " ", "　", " ", "\x00", "\x0b", "\x85", "​", "�", "­", "...", "$+<=>^`|~", "«¿", "x" * 99, "y" * 101, "é", "\U0001f600", "٣", "ª"]
    texts = ["", " ", "x" * 100, "y" * 101, "##a", "[UNK]", *["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, text string")
    got = {r.id: r.p for r in rows.select("id", wordpiece.tokenizer(vocabulary)(F.col("text")).alias("p")).collect()}
    assert got.pop(-1) == []
    own = library(vocabulary)
    for i, t in enumerate(texts):
        assert got[i] == own.encode(t, add_special_tokens=False).tokens, repr(t)


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[UNK]\nmela\n##noma\nme\n##la\nñu\n", encoding="utf-8")
    v = wordpiece.read_vocabulary(spark, str(tmp_path / "v.txt"))
    assert v == ["[UNK]", "mela", "##noma", "me", "##la", "ñu"]
    df = spark.createDataFrame([("melanoma, ñu",), ("mela mex",), (None,)], "text string")
    f = wordpiece.tokenizer(v)
    assert [r[0] for r in df.select(f(F.col("text"))).collect()] == [["mela", "##noma", "[UNK]", "ñu"], ["mela", "[UNK]"], []]
    assert [r[0] for r in df.select(wordpiece.tokenizer(v, ids=True)(F.col("text"))).collect()] == [[1, 2, 0, 5], [1, 0], []]
    assert {(r.term, r.n_tokens) for r in tokens.key_terms(spark, ["melanoma", "mela"], {"own": f}).collect()} == {("melanoma", 2), ("mela", 1)}
    got = wordpiece.profile(df, "text", {"own": v}).collect()
    assert {(r.n_words, r.n_tokens) for r in got} == {(None, 0), (2, 2), (2, 4)}
    with pytest.raises(ValueError, match="without"):
        wordpiece.tokenizer(["a"], ids=True)


def test_longest_match():
    known = {p: i for i, p in enumerate(["a", "ab", "abc", "##c", "##cd", "##d"])}
    assert wordpiece.cut_up("abcd", known, 4) == ["abc", "##d"] and wordpiece.cut_up("abx", known, 4) == ["[UNK]"]
    assert wordpiece.cut_up("a" * 101, known, 4) == ["[UNK]"]
