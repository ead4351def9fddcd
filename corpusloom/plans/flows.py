"""End-to-end flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import maps
from ..functions import text as tx
from ..operators import adapter, curate, metrics, model, split, synth
from ..operators.store import Store
from ..sources import readers, sinks


def filter_by_keyword(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Text files -> candidates: archivo_origen, texto, etiqueta_urgencia_sugerida, fuente."""
    found = curate.keyword_candidates(readers.read_documents(spark, path), "text", config.DOMAIN_TERMS, config.URGENT_TERMS)
    return found.select(F.col("file_name").alias("archivo_origen"), F.col("text").alias("texto"), F.col("suggested_label").alias("etiqueta_urgencia_sugerida"), F.lit(source).alias("fuente"))


def filter_by_code(spark: SparkSession, codes: dict[str, str], texts: dict[str, str], source: str) -> DataFrame:
    """Code tables and text folders by split -> one row per matching code with its document's text."""
    out = None
    for name in codes:
        rows = curate.prefix_join(readers.read_tsv(spark, codes[name]), "codigo", config.CODE_PREFIXES)
        docs = readers.read_documents(spark, texts[name]).select(F.col("stem").alias("articleID"), "text")
        part = curate.document_lookup(rows, docs, "articleID").select(
            F.col("articleID").alias("archivo_origen"), F.col("codigo").alias("codigo_cie10"), F.col("category").alias("categoria_ham10000"),
            F.col("label").alias("etiqueta_urgencia"), tx.clean_truncate(F.col("text"), config.TEXT_CHARS).alias("texto"),
            F.lit(name).alias("split_original"), F.lit(source).alias("fuente"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def build_corpus(spark: SparkSession, real: DataFrame, templates: dict[str, list[str]], fields: dict[str, list[str]]) -> DataFrame:
    """Real cases and balanced synthetic ones, labelled, in a stratified split and hash order."""
    made = synth.generate(spark, templates, fields).select(
        F.col("text").alias("texto"), F.col("category").alias("categoria_ham10000"), F.col("label").alias("etiqueta_urgencia"), F.lit("sintetico").alias("tipo_fuente"),
    )
    both = real.withColumn("tipo_fuente", F.lit("real")).unionByName(made, allowMissingColumns=True)
    return split.stratified_split(both, "categoria_ham10000", "texto").orderBy(split.hash_order(F.col("texto")), "texto")


def train_and_evaluate(corpus: DataFrame, text: str = "texto", label: str = "etiqueta_urgencia") -> tuple[object, DataFrame]:
    """The fitted model and ``metric, baseline, model, delta`` on the test split."""
    rows = metrics.require_labels(corpus.withColumn("label", maps.lookup(F.col(label), config.LABEL_IDS)), "label")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fitted = model.train(train, text, "label")
    base = metrics.metrics(metrics.confusion(metrics.majority_predictions(train, test, "label"), "label", "predicted"))
    own = model.evaluate(model.predict(fitted, test, text), "label")
    return fitted, metrics.delta(metrics.long_form(base, "baseline"), metrics.long_form(own, "model"))


def _split_labels(corpus: DataFrame, label: str) -> DataFrame:
    return metrics.require_labels(corpus.withColumn("label", maps.lookup(F.col(label), config.LABEL_IDS)), "label")


def fine_tune(corpus: DataFrame, store: Store, name: str, registry: str, unlabelled: DataFrame | None = None, text: str = "texto", label: str = "etiqueta_urgencia", **parameters) -> DataFrame:
    """A corpus with splits -> an adapter ``name`` and its base ``name-base`` in the store, and its registry as JSON; ``epoch, rows, loss, ...`` of the validation rows.

    The base is learned from ``unlabelled`` texts, or from the corpus' own; parameters are those of AdapterClassifier.
    """
    spark = corpus.sparkSession
    rows = _split_labels(corpus, label)
    base = adapter.fit_base(rows if unlabelled is None else unlabelled, text)
    known = rows.where("split in ('train', 'val')").withColumn("_held", F.col("split") == "val")
    estimator = adapter.AdapterClassifier(base=base, textCol=text, labelCol="label", validationIndicatorCol="_held", **parameters)
    fitted = estimator.fit(known)
    store.put(f"{name}-base", base)
    store.put(name, fitted, f"{name}-base")
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    kept = estimator.registry(f"{name}-base", {f"n_{s}": counts.get(s, 0) for s in ("train", "val", "test")})
    sinks.write_json(spark.createDataFrame([tuple(kept.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in kept.items())).coalesce(1), registry)
    return fitted.history_frame(spark)


def evaluate_adapter(corpus: DataFrame, store: Store, name: str, text: str = "texto", label: str = "etiqueta_urgencia") -> DataFrame:
    """``metric, baseline, model, delta`` on the test split: the majority of the training split against the adapter, taken from the store anew."""
    rows = _split_labels(corpus, label)
    train, test = rows.where("split = 'train'"), metrics.require_rows(rows.where("split = 'test'"), "test rows")
    base = metrics.metrics(metrics.confusion(metrics.majority_predictions(train, test, "label"), "label", "predicted"))
    own = model.evaluate(store.get(name).transform(test), "label")
    return metrics.delta(metrics.long_form(base, "baseline"), metrics.long_form(own, "model"))
