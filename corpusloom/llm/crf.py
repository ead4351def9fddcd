"""Toxicity by a linear-chain conditional random field over words.

Labelled texts give labelled tokens: a word or word beginning that is much more
frequent among toxic texts than among clean ones marks its tokens in toxic texts.
The field (toxic or not, for every token) sees those features of a word and of the
words before and after it.  It is trained on these tokens and on the texts' labels together
(a toxic text has a toxic token at least, a clean one none) until the gradient of its
likelihood is flat; its forward-backward marginals give, for each text, a score and the
offsets of the offending words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)

#: Training takes at most so many labelled texts of either class, those of least hash, and
#: of each all tokens.  Scoring has no such bound.
TRAIN_TEXTS = 1500
#: Of these, the field's weights are fitted on all tokens of at most so many texts of either
#: class, those of least hash; features are chosen and texts are judged on all of them.
FIELD_TEXTS = 300
#: Labelled texts of more bytes aren't trained on, so that the driver gets 2 * TRAIN_TEXTS times that at most.
TRAIN_TEXT_BYTES = 1 << 16
#: A feature is typical of toxic texts from this likelihood ratio (2 ln) and these odds on.
MIN_EVIDENCE = 20.0
MIN_ODDS = 25.0
MIN_FORMS = 3
#: Weight of the squared parameters, and the gradient's length, to a token, at which training ends.
PENALTY = 0.05
FLAT = 1e-5
MOST_STEPS = 1000
#: Texts are scored in groups of so many tokens, a longer text by itself.
GROUP_TOKENS = 1 << 18
CACHE_WORDS = 400_000
WORD = re.compile(r"\w+")
PLACES = (-1, 0, 1)


def word_features(word: str) -> list[str]:
    """The word and its beginnings of 3 to 8 letters."""
    return ["w" + word, *(f"{n}" + word[:n] for n in range(3, 9) if len(word) > n)]


def typical_features(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Words and word beginnings that are typical of toxic texts.

    A beginning counts only if MIN_FORMS different words of toxic texts share it: one
    frequent word says nothing about others that begin like it.
    """
    sides: tuple[Counter, Counter] = (Counter(), Counter())
    forms: dict[str, set[str]] = {}
    for words, y in zip(texts, toxic):
        seen = set(words)
        sides[y].update({f for w in seen for f in word_features(w)})
        if y:
            for w in seen:
                for f in word_features(w)[1:]:
                    some = forms.setdefault(f, set())
                    if len(some) < MIN_FORMS:
                        some.add(w)
    n = [max(1, toxic.count(y)) for y in (0, 1)]
    typical = set()
    for f, c in sides[1].items():
        d = sides[0][f]
        share, base = c / (c + d), n[1] / (n[0] + n[1])
        evidence = 2 * (c * math.log(share / base) + (d * math.log((1 - share) / (1 - base)) if d else 0))
        if share > base and evidence >= MIN_EVIDENCE and (c / n[1]) / ((d + 0.2) / n[0]) >= MIN_ODDS:
            if f[0] == "w" or len(forms[f]) >= MIN_FORMS:
                typical.add(f)
    return typical


def _scan(m: list[np.ndarray], start: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v_t = M_t v_(t-1), scaled to sum 1, for 2 x 2 matrices ``m`` (m00, m01, m10, m11) of all t; the sums before scaling too.

    The chain is cut into about as many stretches as a stretch has places; all stretches
    are multiplied out at once, then joined, then gone through at once: some 2 sqrt(n)
    steps over arrays, and memory for a few numbers a place, whatever texts it is made of.
    """
    n = len(m[0])
    size = max(1, math.isqrt(n))
    count = -(-n // size)
    a, b, c, d = (
        np.concatenate([x, np.full(size * count - n, fill)]).reshape(count, size).T.copy() for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0))
    )
    p = np.zeros((4, count))
    p[0] = p[3] = 1.0
    for i in range(size):
        p = np.concatenate([a[i] * p[:2] + b[i] * p[2:], c[i] * p[:2] + d[i] * p[2:]])
        p /= p.sum(axis=0)
    first = np.empty((2, count))
    v = start
    for k in range(count):
        first[0, k], first[1, k] = v
        x, y = p[0, k] * v[0] + p[1, k] * v[1], p[2, k] * v[0] + p[3, k] * v[1]
        v = x / (x + y), y / (x + y)
    zero, one, sums = np.empty_like(a), np.empty_like(a), np.empty_like(a)
    u, w = first
    for i in range(size):
        x, y = a[i] * u + b[i] * w, c[i] * u + d[i] * w
        sums[i] = x + y
        u, w = x / sums[i], y / sums[i]
        zero[i], one[i] = u, w
    return tuple(x.T.reshape(-1)[:n] for x in (zero, one, sums))


def chains(emissions: np.ndarray, ends: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end (``ends``: where each ends): P(toxic) of every token, log Z of every chain, the places with a
    next token, and P(states of a place and its next), 2 x 2 for each.

    Empty chains are allowed; ``emissions`` are log odds of the two states at a token.  The
    potentials of a token are divided by the larger one, which goes into log Z, so that none
    overflows and none is cut off.
    """
    n = len(emissions)
    if n == 0:
        return np.zeros(0), np.zeros(len(ends)), np.zeros(0, dtype=np.int64), np.zeros((2, 2, 0))
    last = np.zeros(n, dtype=bool)
    last[ends[ends > 0] - 1] = True
    first = np.concatenate([[True], last[:-1]])
    larger = np.maximum(emissions, 0)
    off, on = np.exp(-larger), np.exp(emissions - larger)
    t = np.exp(moves - moves.max())
    pick = lambda at, x: np.where(at, 1.0, x)  # noqa: E731  (a chain begins and ends whatever lies beside it)
    f0, f1, sums = _scan([off * pick(first, t[0, 0]), off * pick(first, t[1, 0]), on * pick(first, t[0, 1]), on * pick(first, t[1, 1])])
    next_off, next_on = np.concatenate([off[1:], [1.0]]), np.concatenate([on[1:], [1.0]])
    back = [pick(last, t[0, 0] * next_off), pick(last, t[0, 1] * next_on), pick(last, t[1, 0] * next_off), pick(last, t[1, 1] * next_on)]
    b0, b1, _ = (x[::-1] for x in _scan([x[::-1] for x in back]))
    both = f1 * b1
    p = both / (f0 * b0 + both)
    at = np.flatnonzero(~last)
    pairs = np.array([[f[at] * t[i, j] * (on if j else off)[at + 1] * (b1 if j else b0)[at + 1] for j in (0, 1)] for i, f in enumerate((f0, f1))])
    logs = np.concatenate([[0.0], np.cumsum(np.log(sums) + larger + np.where(first, 0.0, moves.max()))])
    return p, np.diff(logs[np.concatenate([[0], ends])]), at, pairs / pairs.sum(axis=(0, 1))


def forward_backward(emissions: np.ndarray, ends: np.ndarray, moves: np.ndarray):
    """P(toxic) of every token of chains(), their summed log Z, and the expected moves (2 x 2)."""
    p, log_z, _, pairs = chains(emissions, ends, moves)
    return p, float(log_z.sum()), pairs.sum(axis=2)


def marginals(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """P(token is toxic | text) for every token of many texts, exact; memory grows with the tokens only."""
    ends = np.cumsum([len(e) for e in emissions], dtype=np.int64)
    p, _, _ = forward_backward(np.concatenate(emissions) if emissions else np.zeros(0), ends, moves)
    return np.split(p, ends[:-1]) if emissions else []


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, flat: float, steps: int = MOST_STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking search: f gives value and gradient; ends where the gradient is no longer than ``flat``."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(grad) <= flat:
            break
        way, used = -grad, []
        for s, y in reversed(past):
            used.append((s @ way) / (s @ y))
            way = way - used[-1] * y
        if past:
            s, y = past[-1]
            way = way * (s @ y) / (y @ y)
        else:
            way = way / np.linalg.norm(grad)
        for (s, y), k in zip(past, reversed(used)):
            way = way + s * (k - (y @ way) / (s @ y))
        size = 1.0
        while True:
            there, slope = f(x + size * way)
            if there <= value + 1e-4 * size * (grad @ way) or size < 1e-9:
                break
            size /= 2
        s, y = size * way, slope - grad
        if size < 1e-9:
            if not past:
                break
            past = []  # once more along the gradient
            continue
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, grad = x + s, there, slope
    return x


class Model:
    """Weights of the features at the places before, of and after a word, a bias, moves between the two states and a text-level fit."""

    def __init__(self, features: set[str] = frozenset()) -> None:
        self.index = {f: i for i, f in enumerate(sorted(features))}
        self.weights = np.zeros((len(PLACES), len(self.index)))
        self.bias = -3.0
        self.moves = np.zeros((2, 2))
        self.text = np.array([0.0, 1.0, 0.0])

    def features(self, word: str) -> list[int]:
        return [self.index[f] for f in word_features(word) if f in self.index]

    def emissions(self, said: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Log odds of all tokens: ``said`` are their columns in ``table``, summed weights by place; column 0 is of words without features."""
        out = self.bias + table[1][said]
        ahead = np.concatenate([said[1:], [0]]) if len(said) else said
        behind = np.concatenate([[0], said[:-1]]) if len(said) else said
        at = ends[(ends > 0) & (ends < len(said))]  # other texts' first tokens
        behind[at] = 0
        ahead[at - 1] = 0
        return out + table[0][behind] + table[2][ahead]

    def text_inputs(self, p: np.ndarray) -> tuple[float, float]:
        top = float(np.clip(p.max(), 1e-6, 1 - 1e-6)) if len(p) else 1e-6
        return math.log(top / (1 - top)), math.log1p(float(p[p > 0.05].sum())) if len(p) else 0.0

    def score(self, p: np.ndarray) -> float:
        z = self.text[0] + self.text[1:] @ np.array(self.text_inputs(p))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Coder(dict):
    """Word -> column of ``table``: words with the same features share one, those without any have 0."""

    def __init__(self, model: Model, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.model, self.most, self.columns, self.sums = model, most, {(): 0}, [np.zeros(len(PLACES))]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        key = tuple(self.model.features(word))
        if key not in self.columns:
            self.columns[key] = len(self.sums)
            self.sums.append(self.model.weights[:, list(key)].sum(axis=1))
        self[word] = k = self.columns[key]
        return k

    @property
    def table(self) -> np.ndarray:
        return np.array(self.sums).T

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(token is toxic | text) for all tokens, in groups of texts of GROUP_TOKENS."""
        found = [np.fromiter(map(self.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]
        out: list[np.ndarray] = []
        for a, b in _groups([len(x) for x in found], GROUP_TOKENS):
            ends = np.cumsum([len(x) for x in found[a:b]], dtype=np.int64)
            p, _, _ = forward_backward(self.model.emissions(np.concatenate(found[a:b]), ends, self.table), ends, self.model.moves)
            out += np.split(p, ends[:-1])
        return out


def _unlike(texts: list[list[str]]) -> list[int]:
    """Places of texts that share at most one of their 8 least word-triple hashes with any before."""
    met: set[int] = set()
    keep = []
    for i, words in enumerate(texts):
        triples = {" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))}
        least = sorted(zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in triples)[:8]
        if sum(h in met for h in least) < min(2, len(least)):
            keep.append(i)
        met.update(least)
    return keep


class Field:
    """Value and gradient of the field's penalised likelihood; parameters are weights, bias and moves in a row.

    It is that of the labelled tokens and, with ``toxic``, of the texts' own labels as well: that
    a clean text has no toxic token and a toxic one has one at least, whichever.  The
    first teaches what words of the list look like; only the second can give weight to words
    that aren't on it, to neighbours, and to moves.
    """

    def __init__(self, model: Model, texts: list[list[str]], truth: np.ndarray, toxic: np.ndarray | None = None) -> None:
        self.model, self.truth, self.toxic, self.k = model, truth, toxic, len(model.index)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        coder = Coder(model, 1 << 62)
        self.said = np.fromiter((coder[w] for t in texts for w in t), dtype=np.int64, count=len(truth))
        #: features x columns: which features a column has
        self.has = np.zeros((self.k, len(coder.sums)))
        for key, column in coder.columns.items():
            self.has[list(key), column] = 1
        last = np.zeros(len(truth), dtype=bool)
        last[self.ends - 1] = True
        at = np.flatnonzero(~last)
        self.moved = np.array([[((truth[at] == i) & (truth[at + 1] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=np.float64)
        self.at = at

    def load(self, x: np.ndarray) -> None:
        self.model.weights = x[: 3 * self.k].reshape(3, self.k)
        self.model.bias, self.model.moves = float(x[3 * self.k]), x[3 * self.k + 1 :].reshape(2, 2)

    def start(self) -> np.ndarray:
        x = np.zeros(3 * self.k + 5)
        share = np.clip(self.truth.mean(), 1e-6, 0.5)
        x[3 * self.k] = math.log(share / (1 - share))
        return x

    def marginals(self) -> np.ndarray:
        table = self.model.weights @ self.has
        return forward_backward(self.model.emissions(self.said, self.ends, table), self.ends, self.model.moves)

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        self.load(x)
        moves = self.model.moves
        e = self.model.emissions(self.said, self.ends, self.model.weights @ self.has)
        p, log_z, _, pairs = chains(e, self.ends, moves)
        gap, expected = p - self.truth, pairs.sum(axis=2) - self.moved
        value = float(log_z.sum()) - float(e @ self.truth) - float((self.moved * moves).sum()) + PENALTY * float(x @ x) / 2
        if self.toxic is not None:
            steps = np.maximum(self.sizes - 1, 0)
            none = np.maximum(log_z - steps * moves[0, 0], 1e-12)  # -log P(no token is toxic)
            value += float(np.where(self.toxic, -np.log(-np.expm1(-none)), none).sum())
            weight = np.where(self.toxic, -1 / np.expm1(np.minimum(none, 700)), 1.0)
            each = np.repeat(weight, self.sizes)
            gap = gap + each * p
            expected = expected + (pairs * each[self.at]).sum(axis=2)
            expected[0, 0] -= float(weight @ steps)
        columns = self.has.shape[1]
        per_place = [
            np.bincount(self.said[self.at], gap[self.at + 1], columns),  # the word before a token
            np.bincount(self.said, gap, columns),
            np.bincount(self.said[self.at + 1], gap[self.at], columns),
        ]
        grad = np.concatenate([*(self.has @ g for g in per_place), [gap.sum()], expected.reshape(-1)])
        return value, grad + PENALTY * x


def train(texts: list[str], toxic: list[int]) -> Model:
    """The field of largest penalised likelihood, then a small logistic fit of texts on its marginals.

    Training that doesn't end where the gradient is flat is an error.
    """
    words = [WORD.findall(t.lower()) for t in texts]
    keep = [i for i, w in enumerate(words) if w]
    words, toxic = [words[i] for i in keep], [toxic[i] for i in keep]
    # Copies among toxic texts are no new evidence for their words; copies among clean ones are evidence against.
    marked = [i for i, y in enumerate(toxic) if y]
    copies = set(marked) - {marked[j] for j in _unlike([words[i] for i in marked])}
    words, toxic = [w for i, w in enumerate(words) if i not in copies], [y for i, y in enumerate(toxic) if i not in copies]
    if not 0 < sum(toxic) < len(toxic):
        return Model()
    typical = typical_features(words, toxic)
    model = Model(typical)
    order = sorted(range(len(words)), key=lambda i: (zlib.crc32(" ".join(words[i]).encode("utf-8", "surrogatepass")), i))
    some = sorted(i for y in (0, 1) for i in [j for j in order if toxic[j] == y][:FIELD_TEXTS])
    known = {w: not typical.isdisjoint(word_features(w)) for w in {w for i in some for w in words[i]}}
    truth = np.array([toxic[i] and known[w] for i in some for w in words[i]], dtype=np.float64)
    field = Field(model, [words[i] for i in some], truth, np.array([bool(toxic[i]) for i in some]))
    best = minimise(field, field.start(), FLAT * len(truth))
    slope = float(np.linalg.norm(field(best)[1]))
    if not slope <= FLAT * len(truth):
        raise RuntimeError(f"the field's training didn't converge: the gradient is {slope:.3g} long, {FLAT * len(truth):.3g} is flat")
    x = np.array([(1.0, *model.text_inputs(p)) for p in Coder(model, 1 << 62).marginals(words)])
    prior, t = np.array([0.0, 1.0, 0.0]), np.array(toxic, dtype=np.float64)

    def loss(b: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ b
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(np.logaddexp(0, z).sum() - (t * z).sum() + ((b - prior) ** 2).sum() / 2), x.T @ (q - t) + (b - prior)

    model.text = minimise(loss, prior, 1e-6 * len(t))
    return model


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 5, is 0; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Train on labelled rows that aren't held out, at most TRAIN_TEXTS of either class, all their tokens.

    NULL labels and keys, and NULL texts, give no evidence; a key labelled twice is toxic
    if either label says so; of several texts with one key the least by hash is taken.
    Without both labels the model finds nothing.  Runs a job when it is called; the
    driver gets at most 2 * TRAIN_TEXTS texts of at most TRAIN_TEXT_BYTES each and trains on
    them, toxic copies of toxic texts left out (_unlike).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    own = docs.where(F.octet_length(text) <= TRAIN_TEXT_BYTES).select(F.col(key).alias("k"), F.col(text).alias("t"))
    picked = known.join(own.select("k"), "k", "left_semi")
    ids = [picked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(TRAIN_TEXTS) for y in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))  # at most 2 * TRAIN_TEXTS rows
    rows = own.join(chosen, "k").groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).orderBy("k").collect()
    return train([r["t"] for r in rows], [r["y"] for r in rows])


def _groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Stretches of consecutive texts with ``most`` tokens together, or one text with more."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))] if sizes else out


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score, spans`` for every row: spans are [start, end) code points of words at 0.5 and over.

    NULL and empty texts have no tokens and get the score of none; repeated rows and
    keys stay; an empty table gives no rows; nothing but the text is looked at.  Memory
    grows with the longest text only.
    """
    def run(batches):
        coder = Coder(model)

        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                scores, spans = [], []
                for t, p in zip(texts, coder.marginals([WORD.findall(t.lower()) for t in texts])):
                    scores.append(model.score(p))
                    hot = set(np.flatnonzero(p >= 0.5).tolist())
                    low = t.lower() if hot else ""
                    if hot and len(low) != len(t):  # a letter whose lower case is longer: match letter by letter
                        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                    spans.append([{"start": x.start(), "end": x.end()} for i, x in enumerate(WORD.finditer(low)) if i in hot] if hot else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    [key, "score", "spans"],
                )

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return docs.select(key, text).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted, spans`` for every row of ``docs``; see fit() and score() for NULLs, repeats and empty tables."""
    scored = score(docs, fit(docs, labels, text, key), text, key)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
