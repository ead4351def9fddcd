"""Token operators, toxicity, archives, page texts and chat formats."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, crf, html_text, pretokens, tokencount, warc
from tests.llm import brute

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "   a  b\n\n\n c\t", "don't I'LL we've 's", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ é ẛ̣", "日本語 テスト 123４５", "x\x00y\x1cz\u0085w v﻿", "🙂👍🏽 ok",
    "<|endoftext|> a<|startoftext|>b", "a" * 5000, "!?" * 900, "0123456789" * 50, " 　x ", "word " * 3000, "''s 're'", "Ünïcödé ẞ straße",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 2)] + [(1, "", "y"), (None, "null key", "z")], "doc_id long, text string, ids string").repartition(2)


def test_bpe(texts):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in [*enumerate(TEXTS * 2), (1, ""), (None, "null key")]:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert brute.ordered(bpe.digests(texts, RANKS, public_tokenizers.PATTERN).collect()) == brute.ordered(want)


def test_token_counts(texts, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = []
    for i, x in [*enumerate(TEXTS * 2), (1, ""), (None, "null key")]:
        n = len(t.encode(x or "", add_special_tokens=False))
        want.append((i, len((x or "").encode()), n, n > 2048))
    assert brute.ordered(tokencount.token_counts(texts, WORDS).collect()) == brute.ordered(want)


def test_small_chunks(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} shared words") for i in range(50)], "doc_id long, text string").coalesce(1)
    one = brute.ordered(tokencount.token_counts(docs, WORDS).collect())

    import functools

    small = functools.partial(pretokens.shuffle_words, chunk_bytes=40, buckets=3)
    old, tokencount.shuffle_words = tokencount.shuffle_words, small
    try:
        assert brute.ordered(tokencount.token_counts(docs, WORDS).collect()) == one
    finally:
        tokencount.shuffle_words = old


def test_packed_words():
    import numpy as np

    words = ["", "a", "é" * 70_000, "\x00\n", "\ud800", "日本"]
    steps, got = pretokens.unpack_words(pretokens.pack_words([0, 3, 4, 500, 70_000, 1 << 31], words))
    assert got == words and np.cumsum(steps.astype(np.int64)).tolist() == [0, 3, 4, 500, 70_000, 1 << 31]
    numbers, raw = pretokens.unpack(pretokens.pack([np.array([]), np.array([1, 1 << 32 - 1])], b"x"))
    assert [n.tolist() for n in numbers] == [[], [1, 1 << 31]] and raw == b"x"


def test_each_word_is_encoded_once(spark, tmp_path):
    """Over all chunks and tasks, and whatever order a shuffle brings the rows in; a text of a million words is one chunk."""
    docs = spark.createDataFrame([(i % 40, f"w{i % 7} shared" + " x" * (i % 3), "clash") for i in range(300)] + [(7, "long " * 1_000_000, "")], "doc_id long, text string, chunk string")
    path = str(tmp_path / "asked")

    def worker():
        def work(words):
            import os
            import uuid

            os.makedirs(path, exist_ok=True)
            if words:
                with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(words))
            return [[len(w)] for w in words]
        return work

    def assemble(keys, sizes, ends, slots, answers):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([keys, sizes, pa.array(ends)], ["doc_id", "size", "end"])

    out = pretokens.shuffle_words(docs.repartition(5), "doc_id", "text", lambda: str.split, worker, assemble, "doc_id long, size long, end long", buckets=5, chunk_bytes=200)
    assert out.agg(F.count("*"), F.sum("size")).first() == docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    asked = [w for f in (tmp_path / "asked").iterdir() for w in f.read_text().split("\n")]
    assert sorted(asked) == sorted({*(f"w{i}" for i in range(7)), "shared", "x", "long"})


def test_decode(spark, monkeypatch):
    with open(RANKS, "rb") as f:
        known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    rng = random.Random(0)
    rows = [(None,), ([],), *(([rng.randrange(50_000) for _ in range(rng.randrange(40))],) for _ in range(60)), ([5] * 9000,), (None,)]
    for size in (1 << 22, 50):
        monkeypatch.setattr(bpe, "GROUP_IDS", size)
        got = bpe.decode(spark.createDataFrame([(*r, "x") for r in rows], "ids array<int>, decoded string"), RANKS).collect()
        assert [None if r.decoded is None else bytes(r.decoded) for r in got] == [None if r[0] is None else b"".join(map(known.get, r[0])) for r in rows]
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), RANKS).collect()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == tokencount.token_counts(none, WORDS).count() == 0


def toxic_corpus(n, rng):
    bad = ["scum", "moron", "idiot"]
    rows = []
    for i in range(n):
        words = brute.sentence(rng, rng.randrange(20, 60)).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), y))
    return rows


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    moves = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 2, 5, 7)]
    for e, p in zip(chains, crf.marginals(chains, moves)):
        mass = np.zeros(len(e))
        total = 0.0
        for y in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(e[t] for t in range(len(e)) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            mass += w * np.array(y)
        assert np.allclose(p, mass / total)


def small_field(rng):
    rows = toxic_corpus(40, rng)
    texts = [crf.WORD.findall(t) for _, t, _ in rows] + [["scum"], ["x"]]
    truth = [float(w in ("scum", "moron", "idiot")) for t in texts for w in t]
    import numpy as np

    return crf.Field(crf.Model({"wscum", "wmoron", "widiot", "3sc"}), texts, np.array(truth))


def test_gradient_of_the_field():
    import numpy as np

    field = small_field(random.Random(5))
    x = field.start() + np.random.default_rng(1).normal(size=len(field.start())) * 0.3
    value, grad = field(x)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert (field(x + step)[0] - field(x - step)[0]) / 2e-5 == pytest.approx(grad[i], rel=1e-4, abs=1e-4)


def test_training_ends_where_the_gradient_is_flat():
    import numpy as np

    field = small_field(random.Random(6))
    x = crf.minimise(field, field.start(), 1e-6 * len(field.truth))
    assert np.linalg.norm(field(x)[1]) <= 1e-6 * len(field.truth)
    p, _, _ = field.marginals()
    assert ((p >= 0.5) == (field.truth > 0.5)).all()


def test_long_chain_in_little_memory():
    """One text of 500,000 words beside many short ones: the marginals of each are those it has alone."""
    import resource

    import numpy as np

    rng = np.random.default_rng(2)
    moves = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (3, 500_000, *rng.integers(0, 30, 300))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = crf.marginals(chains, moves)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    assert [len(p) for p in got] == [len(c) for c in chains]
    for c, p in zip(chains, got):
        if 0 < len(c) < 100:
            assert np.allclose(p, crf.marginals([c], moves)[0])
    assert np.allclose(got[1][:1000], crf.marginals([chains[1][:1050]], moves)[0][:1000])


def test_toxicity_of_awkward_rows(spark):
    """Empty tables, repeated rows and keys, very long texts, columns with inner names; flagged texts have spans on the words that did it."""
    rows = toxic_corpus(600, random.Random(3))
    long = "fine words " * 250_000
    extra = [(7000, long), (7001, long + "you scum, you idiot!"), (7002, "x"), (7002, "x"), (7002, "a moron"), (None, "idiot scum"), (None, None)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t, _ in rows] + [(*r, "c", 1) for r in extra], "doc_id long, text string, k string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (3, 0)], "doc_id long, toxic int")
    got = crf.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(r.spans for r in got if r.predicted) and [r.predicted for r in got if r.doc_id == 7000] == [0]
    assert [[(s.start, s.end) for s in r.spans] for r in got if r.doc_id == 7001] == [[(2_750_004, 2_750_008), (2_750_014, 2_750_019)]]
    assert sorted(r.predicted for r in got if r.doc_id == 7002) == [0, 0, 1] and sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]
    assert crf.toxicity(docs.limit(0), labels).count() == crf.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity(spark):
    rows = toxic_corpus(600, random.Random(2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "You IDIOT, İ scum!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in crf.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    assert got[9000].predicted == got[9001].predicted == 0 and got[9002].predicted == 1
    assert [(s.start, s.end) for s in got[9002].spans] == [(4, 9), (13, 17)]
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i, _, _ in rows)
    assert all(r.predicted in (0, 1) for r in crf.toxicity(docs, labels.limit(0)).collect())


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(4)
    big = brute.sentence(rng, 20000)
    pages = [(1, "http://a b/\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 200), (9, "v", "é" * 700), (8, "v", "é" * 700), (10, "w", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {1: 2, 8: 9}
    path = str(tmp_path / "gz")
    warc.write_warc(df, path, compression="gzip")
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 5
    payloads = {r.record_id: bytes(r.payload) for r in warc.reassemble(records).where("payload is not null").collect()}
    assert payloads["<urn:page:2>"] == big.encode()
    with pytest.raises(Exception, match="add up"):
        warc.reassemble(records.where("segment_number is null or segment_number <> 2")).collect()
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_warc_takes_every_row(spark, tmp_path, monkeypatch, broadcast_rows):
    """NULL keys and repeated keys and rows, long and short: one record each, none mixed up with another."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(6)
    a, b, c = (brute.sentence(rng, 9000) for _ in range(3))
    pages = [(None, "u", a), (None, "u", "tiny"), (None, None, "tiny"), (None, None, None), (7, "v", b), (7, "v", b), (7, "w", c), (7, "w", "tiny"), (3, "x", b), (2, "x", a), (None, "y", c), (1, None, "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    first = {(None, a): 2, (3, b): 7, (None, c): 7}
    raw = [(k, (h or "").encode(), first.get((k, h))) for k, _, h in pages]
    assert brute.ordered(got) == brute.ordered((k, len(h), hashlib.sha1(h).hexdigest(), "revisit" if f else "response", f) for k, h, f in raw)
    path = str(tmp_path / "warc")
    warc.write_warc(df, path)
    records = warc.read_records(spark, path)
    ids = [r.record_id for r in records.collect()]
    whole = warc.reassemble(records).collect()
    assert len(set(ids)) == len(ids) > len(pages) == len(whole)
    assert {r.refers_to for r in whole} - {None} == {"<urn:page:2>"} and "<urn:page:2>" in ids
    assert brute.ordered((r.page_key, bytes(r.payload)) for r in whole if r.record_type == "response") == brute.ordered((k and str(k), h) for k, h, f in raw if not f)


def test_warc_text_keys_and_digests(spark, tmp_path):
    """Keys of any characters come back; a payload that isn't what its record declares ends the job; nothing is left behind."""
    pages = [("a>b", "u", "x"), ("c\r\nWARC-Type: z", "u", "y" * 40_000), (" é 100%+", None, "y" * 40_000), ("", "u", None), ("a b", "u", "z" * 1200), (None, "u", "z" * 1200)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id string, url string, html string, digest string, first int")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == {"a>b": (1, "response", None), "c\r\nWARC-Type: z": (40_000, "response", None), " é 100%+": (40_000, "revisit", "c\r\nWARC-Type: z"),
                   "": (0, "response", None), "a b": (1200, "response", None), None: (1200, "revisit", "a b")}
    path = str(tmp_path / "warc")
    warc.write_warc(df, path)
    records = warc.read_records(spark, path)
    with pytest.raises(Exception, match="digest"):
        warc.reassemble(records.withColumn("payload_digest", F.when(F.col("payload_digest").isNotNull(), F.lit("sha1:" + "0" * 40)))).collect()
    assert warc.checked_payload("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ", b"") == b"" == warc.checked_payload("md5:x", b"") == warc.checked_payload(None, b"")
    from pathlib import Path

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not list(Path(folder).glob("warc-*"))


def test_unchunk():
    assert warc.unchunk(b"3;x=y\r\nabc\r\n2\r\n\r\n\r\n0\r\n\r\n") == b"abc\r\n"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site name</h2></header>
<nav><ul><li><a href="/a">Home, sweet home</a></li><li>About us today</li></ul></nav><div class="cookie-notice">We use cookies, ok?</div>
<div id="wrap"><article><h1>A  title</h1><p><b>First &amp; bold<br><p>Second para, with\n a line end &lt;b&gt; and more words in it.</p><script>var t="</p>";</script>
<div class="ad">Buy now, cheap!</div><p>Short.</p><ul><li>point one, a</li><li>point two, b</li></ul><form><label>Mail</label></form></article>
<aside>Related: more things, here.</aside><div id="comments"><p>Great post, thanks a lot for writing all of this down!</p></div></div><footer>&copy; me</footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "x", ""), (4, "y", "<p>broken <a href='x"), (5, "z", "no tags, just text"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_text.extract(pages).orderBy("page_id").collect()
    want = "A title\n\nFirst & bold\n\nSecond para, with a line end <b> and more words in it.\n\nShort.\n\npoint one, a\n\npoint two, b"
    assert [r.text for r in got] == [want, want, "", "", "broken", "no tags, just text"]
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i}, with a good many words, and marks.</p>" for i in range(6))
    page = f"<html><body><div class='menu'><a>x</a></div><div id='main-text'><h2>Head</h2>{body}</div><div class='sidebar'><p>Side text, which is long enough to count.</p></div></body></html>"
    assert html_text.main_blocks(page) == ["Head", *(f"Paragraph {i}, with a good many words, and marks." for i in range(6))]


def paragraphs(n, of="Paragraph"):
    return [f"{of} {i}, with a good many words, and marks." for i in range(n)]


def html_of(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


def test_page_of_several_parts():
    """Sections beside each other, one very long block among short ones, two articles: nothing of the text is lost."""
    a, b, long = paragraphs(7), paragraphs(3, "Later"), "A long passage, with marks. " * 60
    menu = "<ul><li><a href='/'>Home</a></li><li><a href='/x'>News, all of them</a></li></ul>"
    page = f"<body><div>{menu}</div><div id='content'><section>{html_of(a)}</section><section><h2>More</h2>{html_of(b)}</section></div></body>"
    assert html_text.main_blocks(page) == [*a, "More", *b]
    for tag in ("blockquote", "pre", "div"):
        page = f"<body><div>{menu}</div><div id='content'><h1>Title</h1>{html_of(b)}<{tag}>{long}</{tag}><p>Short.</p></div></body>"
        assert html_text.main_blocks(page) == ["Title", *b, long.strip(), "Short."], tag
    page = f"<body><div id='content'><h1>Title</h1>{html_of(b)}<table><tr><td>{long}</td></tr></table></div></body>"
    assert html_text.main_blocks(page) == ["Title", *b, long.strip()]
    page = f"<body><div>About us</div><div><div><h1>Title</h1></div><div><pre>{long}</pre></div></div></body>"
    assert html_text.main_blocks(page) == ["Title", long.strip()]
    page = f"<body><div>{menu}Bare text, too.<pre>{long}</pre></div></body>"
    assert html_text.main_blocks(page) == ["Bare text, too.", long.strip()]
    page = f"<body>{menu}<article><h2>One</h2>{html_of(a)}</article><article><h2>Two</h2>{html_of(b)}</article></body>"
    assert html_text.main_blocks(page) == ["One", *a, "Two", *b]


def test_page_with_misleading_names():
    """A name that says header, sidebar or comment somewhere doesn't cost the title or the text; real boilerplate still goes."""
    texts = paragraphs(6)
    for name in ("article-header", "post-header", "entry-header", "header"):
        page = f"<body><div class='menu'><p>A menu, here.</p></div><article><div class='{name}'><h1>Title</h1></div>{html_of(texts)}<div class='ad'>Buy, now!</div></article></body>"
        assert html_text.main_blocks(page) == ["Title", *texts], name
    aside = "<div class='sidebar'><p>Side text, which is long enough to count.</p></div>"
    for name in ("content has-sidebar", "layout-with-sidebar", "widget-content", "main search-page", "legal", "comment-free", "notice"):
        page = f"<body><div id='site-footer'><p>Foot text, of some length.</p></div>{aside}<div class='{name}'><h2>Head</h2>{html_of(texts)}{aside}</div></body>"
        assert html_text.main_blocks(page) == ["Head", *texts], name
    assert html_text.main_blocks(f"<body><span class='legal'>{texts[0]}</span></body>") == texts[:1]
    comments = html_of(paragraphs(20, "Comment"))
    for name in ("comments", "post-comments", "comment-list"):
        page = f"<body><div><h1>Title</h1>{html_of(texts)}</div><div class='{name}'>{comments}</div></body>"
        assert html_text.main_blocks(page) == ["Title", *texts], name


def test_links_and_embedded_text_of_an_article():
    """References that are links are text, in an article or beside the prose's paragraphs; so are formulas and fallbacks; menus are not."""
    texts, menu = paragraphs(5), "<ul><li><a href='/'>Home</a></li><li><a href='/x'>All news</a></li></ul>"
    refs = "<h2>Sources</h2><ol><li><a href='/1'>First source</a></li><li><a href='/2'>Second source</a></li></ol>"
    rest = f"<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds.</p><div><object data='x'>An object</object></div><div><canvas>A chart</canvas></div>{refs}"
    want = [*texts, "So a=1 holds.", "An object", "A chart", "Sources", "First source", "Second source"]
    for tag in ("article", "main", "div"):
        page = f"<body>{menu}<{tag}>{html_of(texts)}{rest}</{tag}><div>{menu}</div></body>"
        assert html_text.main_blocks(page) == want, tag
    nav = f"<article>{html_of(texts)}<nav>{menu}</nav><div class='related'>{menu}</div></article>"
    assert html_text.main_blocks(f"<body>{nav}</body>") == texts


def test_ratios_choose_the_nodes(monkeypatch):
    """Parts that no name tells from the text go by their paths' ratios: with those off the same pages come out otherwise."""
    texts = [f"{t} It goes on for a while, as texts do, and then it ends." for t in paragraphs(6)]
    teasers = "".join(f"<article><h3>Teaser {i}</h3><span>See it, now</span></article>" for i in range(4))
    chips = "".join(f"<div><span>Tag {i}.</span></div>" for i in range(12))
    pages = [
        (f"<body><article><h2>Head</h2>{html_of(texts)}</article><section>{teasers}</section></body>", ["Head", *texts]),
        (f"<body><div><div><h2>Head</h2>{html_of(texts)}</div><section>{chips}</section></div></body>", ["Head", *texts]),
    ]
    for page, want in pages:
        assert html_text.main_blocks(page) == want
    monkeypatch.setattr(html_text, "content_blocks", lambda blocks: blocks)
    for page, want in pages:
        assert html_text.main_blocks(page) != want


def test_page_in_a_form():
    texts = paragraphs(5)
    page = f"<body><form action='x'><div class='menu'>Menu</div><h1>Title</h1>{html_of(texts)}<form><label>Your mail</label></form></form></body>"
    assert html_text.main_blocks(page)[:6] == ["Title", *texts]
    page = f"<body><h1>Title</h1>{html_of(texts)}<form><p>Write to us, please.</p></form></body>"
    assert html_text.main_blocks(page) == ["Title", *texts]


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        html_text.main_blocks(page)
        return time.process_time() - began

    for n in (20_000,):
        for page in ("<div>x" * n, "<title>" * n, "<div class='ad'>x, y." * n, "<b>" * n + "x" + "</i>" * n, "<header>x" * n, "<p>one, two.</p>" * n, "<a href='x>" * n, "<section><p>a, b.</p>" * n):
            assert seconds(page) < 8, page[:20]


def test_pages_like_plain_version(sf_dir):
    """The test table's pages, whose text is one article, against a parser that knows just that."""
    import pyarrow.parquet as pq

    for page in pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist():
        assert html_text.main_blocks(page or "") == brute.article_blocks(page or "")


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preference_format(spark):
    a = turns(("system", "s"), ("user", "q"), ("assistant", "good"))
    rows = [(1, a, turns(("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", "more"))), (2, a, a), (3, None, a), (4, turns((None, None), ("user", "é")), turns((None, None)))]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in chat.preference_format(df).collect()}
    assert got[1].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n" and got[1].n_common == 2
    assert got[1].chosen == "<|assistant|>\ngood<|end|>\n"
    for r in got.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            assert all(text[: s.start].endswith("<|assistant|>\n") and text[s.start : s.end].endswith("<|end|>\n") for s in spans)
    assert [r.rejected[s.start : s.end] for r in (got[1],) for s in r.rejected_spans] == ["bad<|end|>\n"]
    assert (got[2].n_common, got[2].chosen, got[2].rejected) == (3, "", "") and (got[3].n_common, got[3].prompt) == (0, "")
    assert got[4].n_common == 1 and got[4].rejected == ""


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 1, "assistant", "d"), (1, 0, "user", "c"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (None, 0, "user", "n"), (4, 0, "user", "u"), (5, 0, "assistant", "v")]
    got = {r.pair_id: r for r in chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1} and [t.text for t in got[0].rejected] == ["a", "d"]
    assert chat.preference_format(chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0))).count() == 0


def test_next_replies(spark):
    """Every conversation has a pair, keys of any type, repeated rows, columns with inner names; replies go round in one ring."""
    keys = [f"c {i}" for i in range(300)]
    rows = [(k, 0, "user", f"q{k}", "x") for k in keys] + [(k, 1, "assistant", f"a{k}", "x") for k in keys if k != "c 7"] + [(None, 0, "user", "n", "x"), (keys[5], 0, "user", f"q{keys[5]}", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, last string")
    got = {r.pair_id: r for r in chat.next_replies(df).collect()}
    assert set(got) == set(keys) and [t.text for t in got["c 7"].rejected] == ["qc 7"] == [t.text for t in got["c 7"].chosen]
    ring = {k: r.rejected[-1].text[1:] for k, r in got.items() if k != "c 7"}
    at, seen = "c 0", set()
    while at not in seen:
        seen.add(at)
        at = ring[at]
    assert seen == set(keys) - {"c 7"} and len(got[keys[5]].chosen) == 3
    alone = chat.next_replies(df.where("conv_id = 'c 1'")).first()
    assert alone.chosen == alone.rejected and chat.next_replies(df.limit(0)).count() == 0
