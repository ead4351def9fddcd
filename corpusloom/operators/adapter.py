"""Fine-tuning by a low-rank adapter on a frozen base, with an evaluation in every epoch.

A text is its first ``max_length`` words, as hashed ids padded with -1.  The base is learned
once from unlabelled texts and then frozen: inverse document frequencies and a matrix W of
``features x hidden``, the leading directions of the weighted texts by power iteration.
Fine-tuning learns a low-rank update of W and a head:

    tanh(x W + alpha / rank * dropout(x) A B) H + b

A is ``features x rank`` and starts at random, B is ``rank x hidden`` and starts at 0, so that
training starts at the base.  Only rank * (features + hidden) weights and the head are trained.

Training is synchronous: the rows are written once, in batches drawn by hash, and every step needs
the weights of the one before (Adam, with a linear decay of the rate).  Batches that fit a share of
SHARE_ROWS are taken in runs: a job reads the files of as many batches as a share has rows for, and its
one task takes their steps in order and returns the weights, so that a job's costs are paid once for a
run and no task sees more than a run.  In larger batches each step is a job, whose tasks add up the gradients of
their share of the batch, shares being drawn by hash and put in order, and Spark adds those of the shares.
Both ways gradients are whole numbers of 2 ** -32; so equal seeds give equal weights bit for bit on one
platform, whatever the partitions.  The driver holds the weights between jobs, whose number doesn't grow
with the rows.  After each epoch the validation rows are scored with the weights of then.

A NULL text counts as empty, which has no ids and is scored by the head alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed, HasStepSize, HasValidationIndicatorCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import text as tx
from ..functions.workers import ship
from ..sources import sinks
from . import metrics

ship(__name__)

#: Gradients are added up as whole numbers of one in so many.
FIXED = 1 << 32
#: Rows of a batch, or of the base's texts, that one task takes as a unit.
SHARE_ROWS = 1 << 14
CLASSES = 2


def token_ids(text: Column, features: int, max_length: int) -> Column:
    """The first ``max_length`` words as hashed ids, padded with -1 to that length."""
    words = F.slice(tx.words(F.coalesce(F.lower(text), F.lit(""))), 1, max_length)
    ids = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return F.concat(ids, F.array_repeat(F.lit(-1), max_length - F.size(ids)))


def _matrix(ids: pa.Array, max_length: int) -> np.ndarray:
    return ids.flatten().to_numpy(zero_copy_only=False).reshape(-1, max_length)


def _weights(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for what is padded, and the weight of each in its row, 0 there; a row has the length 1."""
    here = ids >= 0
    ids = np.where(here, ids, 0)
    raw = np.where(here, idf[ids], 0.0)
    size = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return ids, raw / np.where(size > 0, size, 1)


def _project(ids: np.ndarray, weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """x @ matrix for rows given as ids and weights."""
    out = np.zeros((len(ids), matrix.shape[1]))
    for j in range(ids.shape[1]):
        out += weights[:, j, None] * matrix[ids[:, j]]
    return out


def _add_outer(out: np.ndarray, ids: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
    """Add x' @ rows to ``out`` for x given as ids and weights."""
    for j in range(ids.shape[1]):
        np.add.at(out, ids[:, j], weights[:, j, None] * rows)


class Base:
    """The frozen part: inverse document frequencies and the matrix of ``features x hidden``."""

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, max_length: int):
        self.idf, self.matrix, self.max_length = idf, matrix, max_length

    @property
    def fingerprint(self) -> str:
        """Tells bases apart: a digest of all weights."""
        return hashlib.sha256(self.idf.astype("<f8").tobytes() + self.matrix.astype("<f8").tobytes() + str(self.max_length).encode()).hexdigest()

    @property
    def size(self) -> int:
        return self.matrix.size

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.max_length, float(f), list(map(float, w))) for i, (f, w) in enumerate(zip(self.idf, self.matrix))]
        spark.createDataFrame(rows, "id int, max_length int, idf double, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Base:
        rows = spark.read.parquet(path).orderBy("id").collect()
        return Base(np.array([r.idf for r in rows]), np.array([r.weights for r in rows]), rows[0].max_length)


def _shares(n: int) -> int:
    return -(-n // SHARE_ROWS)


def _place(seed: int, text: Column) -> Column:
    """By this rows are dealt and put in order: equal for equal texts, else random."""
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def _sums(parts: DataFrame) -> dict[int, int]:
    """The sums of ``at, value`` by ``at``, exact."""
    return {r.at: r.value for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}


def _dense(sums: dict[int, int], size: int) -> np.ndarray:
    out = np.zeros(size)
    out[list(sums)] = np.array(list(sums.values()), dtype=np.float64) / FIXED
    return out


def _whole(flat: np.ndarray) -> np.ndarray:
    return np.rint(flat * FIXED).astype(np.int64)


def _entries(flat: np.ndarray) -> pa.Table:
    """The entries of an array that aren't 0, as ``at, value`` in whole numbers."""
    whole = _whole(flat)
    at = np.flatnonzero(whole)
    return pa.table([pa.array(at, pa.int64()), pa.array(whole[at])], names=["at", "value"])


def fit_base(docs: DataFrame, text: str, features: int = config.ADAPTER["features"], hidden: int = config.ADAPTER["hidden"],
             max_length: int = config.ADAPTER["max_length"], rounds: int = 2, seed: int = config.SEED) -> Base:
    """The base of unlabelled texts: each round multiplies the texts' scatter with the directions so far and makes them orthogonal.

    A round is one job over all texts; what comes back has the size of the matrix.
    """
    spark = docs.sparkSession
    path = sinks.scratch(spark, "base-texts")
    docs.select(token_ids(F.col(text), features, max_length).alias("ids"), _place(seed, F.col(text)).alias("place")).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    found = rows.select(F.explode(F.array_distinct("ids")).alias("id")).where("id >= 0").groupBy("id").agg(F.count("*").alias("n")).collect()
    idf = np.full(features, np.log(n + 1.0))
    for r in found:
        idf[r.id] = np.log((n + 1.0) / (r.n + 1.0))
    idf = np.maximum(idf, 0)
    directions = np.random.default_rng(seed).standard_normal((features, hidden))
    dealt = rows.withColumn("share", F.pmod("place", F.lit(max(_shares(n), 1))))

    def times_scatter(q: np.ndarray) -> np.ndarray:
        def share(table: pa.Table) -> pa.Table:
            ids, weights = _weights(_matrix(table.sort_by("place").column("ids").combine_chunks(), max_length), idf)
            out = np.zeros(q.shape)
            _add_outer(out, ids, weights, _project(ids, weights, q))
            return _entries(out.reshape(-1))

        return _dense(_sums(dealt.groupBy("share").applyInArrow(share, "at long, value long")), q.size).reshape(q.shape)

    for _ in range(rounds):
        directions = times_scatter(np.linalg.qr(directions)[0])
    sinks.remove(spark, path)
    directions = np.linalg.qr(directions)[0] if n else directions
    # One size for all directions, so that the projections of a text are of the order of 1.
    return Base(idf, directions * np.sqrt(features / hidden), max_length)


class Tensors:
    """The trained weights as one flat array, and what they do."""

    def __init__(self, features: int, hidden: int, rank: int, alpha: float):
        self.shapes = {"A": (features, rank), "B": (rank, hidden), "H": (hidden, CLASSES), "b": (CLASSES,)}
        self.scale = alpha / rank

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        return out

    def start(self, seed: int) -> np.ndarray:
        """A and the head small and random, B and b 0."""
        rng = np.random.default_rng([seed, 1])
        flat = np.zeros(self.size)
        parts = self.split(flat)
        parts["A"][:] = rng.standard_normal(parts["A"].shape) / np.sqrt(parts["A"].shape[1])
        parts["H"][:] = rng.standard_normal(parts["H"].shape) * 0.02
        return flat

    def logits(self, base: Base, flat: np.ndarray, ids: np.ndarray) -> np.ndarray:
        w = self.split(flat)
        ids, weights = _weights(ids, base.idf)
        return np.tanh(_project(ids, weights, base.matrix) + self.scale * _project(ids, weights, w["A"]) @ w["B"]) @ w["H"] + w["b"]

    def gradient(self, base: Base, flat: np.ndarray, ids: np.ndarray, labels: np.ndarray, dropout: float, rng: np.random.Generator) -> np.ndarray:
        """The sum over rows of the gradients of the log loss."""
        w = self.split(flat)
        ids, weights = _weights(ids, base.idf)
        dropped = weights * (rng.random(weights.shape) >= dropout) / (1 - dropout)
        low = _project(ids, dropped, w["A"])
        h = np.tanh(_project(ids, weights, base.matrix) + self.scale * low @ w["B"])
        errors = softmax(h @ w["H"] + w["b"]) - np.eye(CLASSES)[labels]
        inner = (errors @ w["H"].T) * (1 - h * h) * self.scale
        out = np.zeros(self.size)
        g = self.split(out)
        _add_outer(g["A"], ids, dropped, inner @ w["B"].T)
        g["B"][:], g["H"][:], g["b"][:] = low.T @ inner, h.T @ errors, errors.sum(axis=0)
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Adam:
    def __init__(self, size: int, rate: float, steps: int):
        self.m, self.v, self.rate, self.steps, self.t = np.zeros(size), np.zeros(size), rate, max(steps, 1), 0

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        rate = self.rate * (1 - (self.t - 1) / self.steps)
        return flat - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class _AdapterParams(HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    textCol = Param(Params._dummy(), "textCol", "column of texts", typeConverter=TypeConverters.toString)
    rank = Param(Params._dummy(), "rank", "rank of the update", typeConverter=TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "the update is scaled by alpha / rank", typeConverter=TypeConverters.toFloat)

    def tensors(self, base: Base) -> Tensors:
        return Tensors(*base.matrix.shape, self.getOrDefault("rank"), self.getOrDefault("alpha"))


class AdapterClassifier(Estimator, _AdapterParams, HasMaxIter, HasStepSize, HasValidationIndicatorCol):
    """Fits an adapter on a frozen base; ``maxIter`` is the number of epochs, ``stepSize`` the first rate.

    Rows whose ``validationIndicatorCol`` is true aren't trained on; they are scored after each
    epoch.  A label other than 0 and 1 and a table without training rows are errors.
    """

    batchSize = Param(Params._dummy(), "batchSize", "mean rows of a batch", typeConverter=TypeConverters.toInt)
    dropout = Param(Params._dummy(), "dropout", "share of a text's ids that the update doesn't see in a step", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, base: Base | None = None, textCol: str = "text", labelCol: str = "label", predictionCol: str = "predicted", probabilityCol: str = "probability",
                 validationIndicatorCol: str | None = None, rank: int = config.ADAPTER["rank"], alpha: float = config.ADAPTER["alpha"], dropout: float = config.ADAPTER["dropout"],
                 maxIter: int = config.ADAPTER["epochs"], stepSize: float = config.ADAPTER["learning_rate"], batchSize: int = config.ADAPTER["batch_size"], seed: int = config.SEED):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        self.base = kwargs.pop("base", None)
        self._setDefault(textCol="text", labelCol="label", predictionCol="predicted", probabilityCol="probability", rank=config.ADAPTER["rank"], alpha=float(config.ADAPTER["alpha"]),
                         dropout=config.ADAPTER["dropout"], maxIter=config.ADAPTER["epochs"], stepSize=config.ADAPTER["learning_rate"], batchSize=config.ADAPTER["batch_size"], seed=config.SEED)
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def registry(self, base: str, counts: dict[str, int]) -> dict[str, str | int | float]:
        """All that a training run depends on, to be kept beside its result; ``base`` is the base's id."""
        names = {"seed": "seed", "rank": "rank", "alpha": "alpha", "dropout": "dropout", "stepSize": "learning_rate", "maxIter": "epochs", "batchSize": "batch_size"}
        known = {as_: self.getOrDefault(name) for name, as_ in names.items()}
        trained = self.tensors(self.base).size
        return {"base": base, "base_digest": self.base.fingerprint, **known, "max_length": self.base.max_length, "trained_weights": trained, "frozen_weights": self.base.size, **counts}

    def _rows(self, df: DataFrame, held: Column) -> tuple[DataFrame, int, str]:
        """All rows as ids, written once: with their label, their place and whether they are held out; how many are trained on; and where they are."""
        spark, base = df.sparkSession, self.base
        text, label = F.col(self.getOrDefault("textCol")), F.col(self.getLabelCol())
        path = sinks.scratch(spark, "adapter-rows")
        ids, unknown = token_ids(text, base.matrix.shape[0], base.max_length), label.isNull() | ~label.isin(0, 1)
        df.select(ids.alias("ids"), label.cast("int").alias("label"), _place(self.getSeed(), text).alias("place"), held.alias("held"), unknown.alias("unknown")).write.parquet(path)
        rows = spark.read.parquet(path)
        n, bad = rows.where(~F.col("held")).agg(F.count("*"), F.count_if("unknown")).first()
        if bad or not n:
            sinks.remove(spark, path)
            raise ValueError(f"{bad} rows without a known label" if bad else "no rows to train on")
        return rows, n, path

    def _batches(self, rows: DataFrame, count: int) -> tuple[DataFrame, str]:
        """The training rows as a table that is partitioned by batch, and where it is."""
        path = sinks.scratch(rows.sparkSession, "adapter-batches")
        dealt = rows.withColumn("batch", F.pmod("place", F.lit(count))).withColumn("share", F.pmod(F.xxhash64("place"), F.lit(_shares(self.getOrDefault("batchSize")))))
        dealt.repartition("batch", "share").write.partitionBy("batch").parquet(path)
        return rows.sparkSession.read.schema("ids array<int>, label int, place long, share long, batch long").parquet(path), path

    def _fit(self, df: DataFrame) -> AdapterModel:
        if self.base is None:
            raise ValueError("an adapter needs a base")
        base, seed, spark = self.base, self.getSeed(), df.sparkSession
        flag = self.getOrDefault("validationIndicatorCol") if self.isDefined("validationIndicatorCol") else None
        held = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(False)
        rows, n, rows_path = self._rows(df, held)
        size = self.getOrDefault("batchSize")
        count = max(-(-n // size), 1)
        batches, path = self._batches(rows.where(~F.col("held")).select("ids", "label", "place"), count)
        tensors, shared = self.tensors(base), spark.sparkContext.broadcast((base.idf, base.matrix, base.max_length))  # of the size of the weights
        epochs, dropout = self.getMaxIter(), self.getOrDefault("dropout")
        adam = Adam(tensors.size, self.getStepSize(), epochs * count)
        model = AdapterModel(tensors.start(seed), base.fingerprint, [])._with(self, base)

        def measured(epoch: int) -> None:
            if flag:
                model.history.append({"epoch": epoch, **model._measures(rows.where("held"))})

        def gradient(flat: np.ndarray, table: pa.Table, *at: int) -> np.ndarray:
            """That of one share of a batch, in an order of its own."""
            table = table.sort_by([("place", "ascending"), ("label", "ascending")])
            rng = np.random.default_rng([*at, table.column("share")[0].as_py()])
            frozen = Base(*shared.value)
            return tensors.gradient(frozen, flat, _matrix(table.column("ids").combine_chunks(), frozen.max_length), table.column("label").to_numpy(), dropout, rng)

        def steps(flat: np.ndarray, adam: Adam, epoch: int, run: list[int]):
            """The steps of a run of batches in order: the weights and moments after them; a batch drawn by hash can be empty."""
            def take(table: pa.Table) -> pa.Table:
                own, now, numbers = Adam(0, adam.rate, adam.steps), flat, table.column("batch").to_numpy()
                own.m, own.v, own.t = adam.m, adam.v, adam.t
                order = np.argsort(numbers, kind="stable")
                for batch in run:
                    a, b = np.searchsorted(numbers, [batch, batch + 1], sorter=order)
                    if a < b:
                        now = own.step(now, _whole(gradient(now, table.take(pa.array(order[a:b])), seed, epoch, batch)) / FIXED / (b - a))
                return pa.table([pa.array([own.t]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (now, own.m, own.v))], names=["t", "flat", "m", "v"])

            return take

        def shares(flat: np.ndarray, epoch: int, batch: int):
            def share(table: pa.Table) -> pa.Table:
                return pa.concat_tables([_entries(gradient(flat, table, seed, epoch, batch)), pa.table([pa.array([-1]), pa.array([table.num_rows])], names=["at", "value"])])

            return share

        together = SHARE_ROWS // size  # batches of a run; none if a batch is more than a share
        measured(0)
        for epoch in range(1, epochs + 1):
            order = np.random.default_rng([seed, epoch]).permutation(count).tolist()
            for at in range(0, count, max(together, 1)):
                run = order[at : at + max(together, 1)]
                now = batches.where(F.col("batch").isin(run))
                if together:
                    done = now.groupBy().applyInArrow(steps(model.flat, adam, epoch, run), "t long, flat array<double>, m array<double>, v array<double>").first()
                    if done:
                        adam.t, model.flat, adam.m, adam.v = done.t, *(np.array(x) for x in (done.flat, done.m, done.v))
                else:
                    sums = _sums(now.groupBy("share").applyInArrow(shares(model.flat, epoch, run[0]), "at long, value long"))
                    n = sums.pop(-1, 0)
                    if n:
                        model.flat = adam.step(model.flat, _dense(sums, tensors.size) / n)
            measured(epoch)
        shared.unpersist()
        sinks.remove(spark, path)
        sinks.remove(spark, rows_path)
        return model


class AdapterModel(Model, _AdapterParams, MLWritable, MLReadable):
    """An adapter, which scores texts together with the base that it was trained on.

    ``history`` has a row for each epoch, the frozen base's as epoch 0, if there were validation rows.
    """

    def __init__(self, flat: np.ndarray | None = None, of: str = "", history: list[dict] | None = None):
        super().__init__()
        self.flat, self.of, self.history, self.base = flat, of, history or [], None

    def _with(self, estimator: AdapterClassifier, base: Base) -> AdapterModel:
        for name in ("textCol", "labelCol", "predictionCol", "probabilityCol", "rank", "alpha", "seed"):
            self._set(**{name: estimator.getOrDefault(name)})
        self.base = base
        return self

    def attach(self, base: Base) -> AdapterModel:
        """Put the adapter onto its base; any other base is an error."""
        if base.fingerprint != self.of:
            raise ValueError("the adapter was trained on another base")
        self.base = base
        return self

    @property
    def trained_size(self) -> int:
        return self.flat.size

    def _probability(self, ids: Column) -> Column:
        base, flat, tensors = self.base, self.flat, self.tensors(self.base)

        def load():
            return lambda x: softmax(tensors.logits(base, flat, x.astype(np.int64)))

        score = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=config.ADAPTER["score_rows"], input_tensor_shapes=[[base.max_length]])
        return F.get(score(ids), F.lit(1))

    def _ids(self) -> Column:
        if self.base is None:
            raise ValueError("an adapter needs its base: attach() it")
        return token_ids(F.col(self.getOrDefault("textCol")), self.base.matrix.shape[0], self.base.max_length)

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability of label 1 and the prediction, which is 1 from 0.5 on."""
        p = self.getProbabilityCol()
        out = df.withColumn(p, self._probability(self._ids()))
        return out.withColumn(self.getPredictionCol(), (F.col(p) >= 0.5).cast("int"))

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        """loss, accuracy, f1_macro and recall of labelled rows; one job."""
        return self._measures(df.select(self._ids().alias("ids"), F.col(self.getLabelCol()).cast("int").alias("label")))

    def _measures(self, rows: DataFrame) -> dict[str, float]:
        """evaluate() of rows ``ids, label``."""
        p, label = F.col("probability"), F.col("label")
        scored = rows.select("label", self._probability(F.col("ids")).alias("probability")).withColumn("predicted", (p >= 0.5).cast("int"))
        own = F.greatest(F.when(label == 1, p).otherwise(1 - p), F.lit(1e-300))
        loss = F.sum((-F.log(own) * FIXED).cast("decimal(38,0)")) / F.count("*") / F.lit(FIXED)
        counted = metrics.confusion(scored, "label", "predicted", F.count("*").alias("rows"), F.coalesce(loss.cast("double"), F.lit(0.0)).alias("loss"))
        row = metrics.metrics(counted).first()
        return {k: row[k] for k in ("rows", "loss", "accuracy", "f1_macro", "recall")}

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """``epoch, rows, loss, accuracy, f1_macro, recall``."""
        names = "epoch long, rows long, loss double, accuracy double, f1_macro double, recall double"
        return spark.createDataFrame([tuple(h[n.split()[0]] for n in names.split(", ")) for h in self.history], names)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """The adapter alone: parameters, the digest of its base, history, and the trained weights; the base is kept elsewhere."""

    def __init__(self, instance: AdapterModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m, spark = self.instance, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"base": m.of, "history": m.history})
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.flat)], "at int, value double").coalesce(1).write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def load(self, path: str) -> AdapterModel:
        spark = self.sparkSession
        kept = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/weights").orderBy("at").collect()
        model = AdapterModel(np.array([r.value for r in rows]), kept["base"], kept["history"])
        model._resetUid(kept["uid"])
        DefaultParamsReader.getAndSetParams(model, kept)
        return model
