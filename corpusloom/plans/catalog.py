"""The catalog of queries over the test tables, each beside its SQL.

Terms, codes and templates are parameters of the operators; here they are words that
the test tables hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import maps, matching, vectors
from ..functions import text as tx
from ..operators import adapter, curate, metrics, model, split, store, synth, tokens, wordpiece
from ..sources import readers, sinks

TERMS = ["the", "eau", "schen"]
URGENT = ["idiot", "tion"]
PREFIXES = {"pro": ("promo", "urgente"), "eco": ("economy", "no_urgente"), "sta": ("standard", "no_urgente")}
TEMPLATES = {"a": ["{tiempo} en {ubicacion}", "de {ubicacion} a {ubicacion}"], "b": ["{ubicacion} desde hace {tiempo}"]}
TIMES = ["dos meses", "un año"]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL of the column builders.
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
CLEAN = f"substring(replace({STRIP}, chr(10), ' '), 1, 1500)"
ANY_TERM = "(contains(lower(text), 'the') OR contains(lower(text), 'eau') OR contains(lower(text), 'schen'))"
ANY_URGENT = "(contains(lower(text), 'idiot') OR contains(lower(text), 'tion'))"
WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
PRETOKENS = r"len(regexp_extract_all(text, '[^\s\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]'))"
TRUTHS = "SELECT l.doc_id, l.toxic AS truth, CASE WHEN contains(lower(d.text), 'idiot') OR contains(lower(d.text), 'lo') THEN 1 ELSE 0 END AS predicted FROM labels l JOIN documents d USING (doc_id)"
MATRIX = (f"SELECT count(*) FILTER (truth = 0 AND predicted = 0) AS tn, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, "
          f"count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 1 AND predicted = 1) AS tp FROM")


def _metrics_sql(matrix: str) -> str:
    return (
        f"WITH m AS ({matrix}), f AS (SELECT *, CASE WHEN 2*tn+fp+fn > 0 THEN 2*tn / (2*tn+fp+fn)::double END AS f0, "
        "CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp / (2*tp+fp+fn)::double END AS f1 FROM m) "
        "SELECT tn, fp, fn, tp, CASE WHEN tn+fp+fn+tp = 0 THEN 0.0::double ELSE (tn+tp) / (tn+fp+fn+tp)::double END AS accuracy, "
        "CASE WHEN f0 IS NULL AND f1 IS NULL THEN 0.0::double ELSE (coalesce(f0, 0::double) + coalesce(f1, 0::double)) / ((f0 IS NOT NULL)::int + (f1 IS NOT NULL)::int) END AS f1_macro, "
        "CASE WHEN tp+fn = 0 THEN 0.0::double ELSE tp / (tp+fn)::double END AS recall FROM f"
    )


def _hash(key: str) -> str:
    return f"md5('42|' || {key}::varchar)"


SPLIT_SQL = (
    "SELECT doc_id, lang, CASE WHEN i < floor(n * 0.7::double) THEN 'train' WHEN i < floor(n * 0.7::double) + floor(n * 0.15::double) THEN 'val' ELSE 'test' END AS split "
    f"FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {_hash('doc_id')}, doc_id) - 1 AS i FROM documents)"
)
MAJORITY = "SELECT toxic FROM labels l JOIN ({split}) s USING (doc_id) WHERE split = 'train' GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1".format(split=SPLIT_SQL)
BASELINE = f"SELECT toxic AS truth, ({MAJORITY}) AS predicted FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split = 'test'"


def _guessed(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return _t(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("toxic").alias("truth"), tx.contains_any(F.col("text"), ["idiot", "lo"]).cast("int").alias("predicted")
    )


def _labelled_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = split.stratified_split(_t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return _t(spark, sf, "labels").join(docs, "doc_id")


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled_split(spark, sf)
    return metrics.majority_predictions(rows.where("split = 'train'"), rows.where("split = 'test'"), "toxic")


# ---- scans and filters

@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def scan_partition_isin(spark, sf):
    return _t(spark, sf, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de'")
def filter_eq(spark, sf):
    return _t(spark, sf, "documents").where(F.col("lang") == "de").select("doc_id", "n_chars")


@query("SELECT page_id, url FROM pages WHERE suffix(url, '.html')")
def filter_suffix(spark, sf):
    return _t(spark, sf, "pages").where(F.col("url").endswith(".html")).select("page_id", "url")


@query(f"SELECT doc_id, {CLEAN} AS text FROM documents WHERE {ANY_TERM}")
def keyword_filter_any(spark, sf):
    return curate.keyword_candidates(_t(spark, sf, "documents").select("doc_id", "text"), "text", TERMS, URGENT).select("doc_id", "text")


@query(f"SELECT doc_id, CASE WHEN {ANY_URGENT} THEN 'urgente' ELSE 'revisar_manual' END AS label FROM documents")
def keyword_suggested_label(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", curate.suggested_label(F.col("text"), URGENT).alias("label"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_join_exists(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "lang").join(_t(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL")
def null_label_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left").agg(F.count_if(F.col("toxic").isNull()).alias("n"))


# ---- projections

@query("SELECT doc_id, lang FROM documents")
def project_columns(spark, sf):
    return _t(spark, sf, "documents").drop("text").select("doc_id", "lang")


@query("SELECT doc_id, 'real' AS tipo_fuente, 'corpus' AS fuente FROM documents")
def project_constants(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.lit("real").alias("tipo_fuente"), F.lit("corpus").alias("fuente"))


@query("SELECT doc_id, lang, " + ", ".join(f"'' AS {c}" for c in config.REVIEW_COLUMNS) + " FROM documents")
def review_sheet(spark, sf):
    return curate.review_sheet(_t(spark, sf, "documents"), ["doc_id", "lang"])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS label FROM documents")
def label_encode(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", maps.lookup(F.col("lang"), {"en": 0, "de": 1, "fr": 2}).alias("label"))


@query("SELECT doc_id, CASE toxic WHEN 0 THEN 'no_urgente' WHEN 1 THEN 'urgente' END AS label FROM labels")
def label_decode(spark, sf):
    return _t(spark, sf, "labels").select("doc_id", maps.lookup(F.col("toxic"), maps.inverse(config.LABEL_IDS)).alias("label"))


@query("SELECT r_regionkey, CASE r_name WHEN 'AFRICA' THEN 'urgente' WHEN 'ASIA' THEN 'urgente' ELSE 'no_urgente' END AS label FROM region")
def category_to_urgency(spark, sf):
    table = {n: "urgente" if n in ("AFRICA", "ASIA") else "no_urgente" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    return _t(spark, sf, "region").select("r_regionkey", maps.lookup_strict(F.col("r_name"), table).alias("label"))


@query("SELECT s_name AS name, s_acctbal::varchar AS balance, '' AS segment FROM supplier WHERE false UNION ALL "
       "SELECT c_name AS name, '' AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, '', '' FROM supplier")
def align_schema_union(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = _t(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return sinks.align(a.unionByName(b, allowMissingColumns=True), ["name", "balance", "segment"])


@query(f"SELECT doc_id, '{'=' * 80}' || chr(10) || 'CASO ' || row_number() OVER (ORDER BY doc_id) || ' de ' || count(*) OVER () || ' — archivo: ' || doc_id || chr(10) "
       f"|| 'Etiqueta sugerida automática: ' || toxic || chr(10) || '{'=' * 80}' || chr(10) || quality || chr(10) || chr(10) AS block FROM labels")
def review_report_block(spark, sf):
    return curate.review_blocks(_t(spark, sf, "labels").withColumn("text", F.col("quality").cast("string")), "doc_id", "toxic", "text")


# ---- joins

@query("SELECT p_partkey, CASE lower(substring(p_type, 1, 3)) WHEN 'pro' THEN 'promo' WHEN 'eco' THEN 'economy' ELSE 'standard' END AS category "
       "FROM part WHERE lower(substring(p_type, 1, 3)) IN ('pro', 'eco', 'sta')")
def prefix_classify(spark, sf):
    return curate.prefix_join(_t(spark, sf, "part").select("p_partkey", "p_type"), "p_type", PREFIXES).select("p_partkey", "category")


@query("SELECT category, label, count(*) AS n FROM part JOIN (VALUES ('pro', 'promo', 'urgente'), ('eco', 'economy', 'no_urgente'), ('sta', 'standard', 'no_urgente')) "
       "AS t(prefix, category, label) ON starts_with(replace(lower(p_type), '.', ''), prefix) GROUP BY category, label")
def prefix_join(spark, sf):
    rows = curate.prefix_join(_t(spark, sf, "part").select("p_type"), "p_type", PREFIXES)
    return rows.groupBy("category", "label").agg(F.count("*").alias("n"))


#: Prefixes that overlap, in the order in which they are tried.
OVERLAPPING = {"prom": ("promo", "urgente"), "e": ("e", "no_urgente"), "eco": ("economy", "urgente"), "pro": ("other", "no_urgente"), "st": ("st", "urgente"), "standard a": ("anodized", "no_urgente")}


@query("WITH t(rank, prefix, category, label) AS (VALUES " + ", ".join(f"({i}, '{p}', '{c}', '{u}')" for i, (p, (c, u)) in enumerate(OVERLAPPING.items())) + ") "
       "SELECT p_partkey, arg_min(prefix, rank) AS prefix, arg_min(category, rank) AS category, arg_min(label, rank) AS label FROM part JOIN t ON starts_with(replace(lower(p_type), '.', ''), prefix) GROUP BY p_partkey")
def prefix_join_overlapping(spark, sf):
    """The first prefix in order, one row a code."""
    return curate.prefix_join(_t(spark, sf, "part").select("p_partkey", "p_type"), "p_type", OVERLAPPING).drop("p_type")


@query("WITH t AS (SELECT DISTINCT lower(substring(p_type, 1, k)) AS prefix FROM part, range(3, 9) AS n(k) WHERE p_size % 5 = 0) "
       "SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix FROM part JOIN t ON starts_with(replace(lower(p_type), '.', ''), prefix) GROUP BY p_partkey")
def prefix_match_longest(spark, sf):
    """The longest of the prefixes in a table, here of the beginnings of some parts' types."""
    part = _t(spark, sf, "part")
    cuts = F.explode(F.array(*[F.lower(F.substring("p_type", 1, k)) for k in range(3, 9)])).alias("prefix")
    table = part.where("p_size % 5 = 0").select(cuts).distinct().withColumn("rank", -F.char_length("prefix"))
    return curate.prefix_match(part.select("p_partkey", "p_type"), "p_type", table).select("p_partkey", "prefix")


@query("WITH w AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM benchmark) WHERE length(word) >= 5) "
       "SELECT doc_id, count(*) AS n_terms FROM documents JOIN w ON contains(lower(text), word) GROUP BY doc_id")
def many_terms(spark, sf):
    """How many of the words of all benchmark items each text holds as substrings."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.char_length("word") >= 5)
    terms = matching.terms_of(words.select(F.lower("word").alias("word")), "word")
    found = _t(spark, sf, "documents").select("doc_id", F.size(matching.terms_in(F.col("text"), terms)).cast("long").alias("n_terms"))
    return found.where("n_terms > 0")


@query("WITH w AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS word FROM benchmark) WHERE length(word) >= 9) "
       f"SELECT doc_id, {CLEAN} AS text, 'urgente' AS suggested_label FROM documents WHERE EXISTS (SELECT 1 FROM w WHERE contains(lower(text), word))")
def many_terms_filter(spark, sf):
    """Candidates by a list of terms that is too long for a chain of tests."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")).where(F.char_length("word") >= 9)
    terms = matching.terms_of(words.select(F.lower("word").alias("word")), "word")
    return curate.keyword_candidates(_t(spark, sf, "documents").select("doc_id", "text"), "text", terms, terms)


@query(f"SELECT l.doc_id, l.quality, {CLEAN} AS text FROM labels l JOIN documents d USING (doc_id)")
def doc_lookup_join(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", tx.clean_truncate(F.col("text"), config.TEXT_CHARS).alias("text"))
    return curate.document_lookup(_t(spark, sf, "labels").select("doc_id", "quality"), docs, "doc_id")


@query("SELECT r_name, n_name, replace(replace('{tiempo} en {ubicacion}', '{ubicacion}', n_name), '{tiempo}', t) AS text FROM region CROSS JOIN nation CROSS JOIN (VALUES ('dos meses'), ('un año')) AS x(t)")
def cross_product_templates(spark, sf):
    places = _t(spark, sf, "region").select("r_name").crossJoin(_t(spark, sf, "nation").select("n_name"))
    df = places.select("*", F.explode(F.array(*[F.lit(x) for x in TIMES])).alias("t"))
    return df.select("r_name", "n_name", tx.render(F.lit("{tiempo} en {ubicacion}"), {"ubicacion": F.col("n_name"), "tiempo": F.col("t")}).alias("text"))


@query("SELECT n_nationkey, replace(replace('{ubicacion} a {ubicacion} desde hace {tiempo}', '{ubicacion}', n_name), '{tiempo}', 'dos meses') AS text FROM nation")
def template_render(spark, sf):
    values = {"tiempo": F.lit("dos meses"), "ubicacion": F.col("n_name")}
    return _t(spark, sf, "nation").select("n_nationkey", tx.render(F.lit("{ubicacion} a {ubicacion} desde hace {tiempo}"), values).alias("text"))


@query("WITH t(category, template) AS (VALUES ('a', '{tiempo} en {ubicacion}'), ('a', 'de {ubicacion} a {ubicacion}'), ('b', '{ubicacion} desde hace {tiempo}')) "
       "SELECT category, least(count(DISTINCT replace(replace(template, '{ubicacion}', s_name), '{tiempo}', w)), 40) AS n "
       "FROM t, supplier, (VALUES ('dos meses'), ('un año')) AS z(w) WHERE s_nationkey = 5 OR s_suppkey <= 9 GROUP BY category")
def synth_generate(spark, sf):
    """How many texts of each category are made, with the names of some suppliers as places; none keeps a field's mark."""
    places = [r[0] for r in _t(spark, sf, "supplier").where("s_nationkey = 5 or s_suppkey <= 9").select("s_name").distinct().limit(1000).collect()]  # values of one field: a parameter
    made = synth.generate(spark, TEMPLATES, {"ubicacion": places, "tiempo": TIMES}, {"a": "urgente", "b": "no_urgente"}, 40)
    return made.where(~F.contains("text", F.lit("{"))).groupBy("category").agg(F.count("*").alias("n"))


@query("WITH t(category, template) AS (VALUES ('a', '{tiempo} en {ubicacion}'), ('a', 'de {ubicacion} a {ubicacion}'), ('b', '{ubicacion} desde hace {tiempo}')), "
       "c AS (SELECT DISTINCT category, replace(replace(template, '{ubicacion}', n_name), '{tiempo}', w) AS text FROM t, nation, (VALUES ('dos meses'), ('un año')) AS z(w) WHERE n_regionkey < 2), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || text), text) AS i FROM c) "
       "SELECT text, category, CASE category WHEN 'a' THEN 'urgente' ELSE 'no_urgente' END AS label FROM r WHERE i <= 18")
def synth_rows(spark, sf):
    """The rendered sample itself, with the places of a table as one field's values (a handful: a parameter of the program)."""
    places = [r[0] for r in _t(spark, sf, "nation").where("n_regionkey < 2").select("n_name").collect()]
    return synth.generate(spark, TEMPLATES, {"ubicacion": places, "tiempo": TIMES}, {"a": "urgente", "b": "no_urgente"})


# ---- sources and sinks: what is written comes back

@query("SELECT c_custkey::bigint AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    """Written with other columns in another order beside it, twice, and read by schema."""
    path = sinks.scratch(spark, "csv")
    for _ in range(2):
        sinks.write_csv(_t(spark, sf, "customer"), path, ["c_custkey", "c_name", "c_mktsegment"])
    return readers.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string", line_ends=False)


@query("SELECT doc_id::bigint AS doc_id, lang, source FROM documents")
def csv_by_key_round_trip(spark, sf):
    """One folder for each language."""
    path = sinks.scratch(spark, "csv-by-key")
    sinks.write_csv(_t(spark, sf, "documents").select("doc_id", "source", "lang"), path, by="lang")
    return readers.read_csv(spark, path, "doc_id long, source string, lang string", line_ends=False)


@query("SELECT doc_id::varchar AS articleID, lang AS codigo, 'train' AS split_original FROM documents UNION ALL SELECT page_id::varchar, 'p', 'dev' FROM pages")
def tsv_splits_round_trip(spark, sf):
    """Tables without a header, one for each split."""
    tables = {
        "train": _t(spark, sf, "documents").select(F.col("doc_id").cast("string"), "lang"),
        "dev": _t(spark, sf, "pages").select(F.col("page_id").cast("string"), F.lit("p")),
    }
    paths = {name: sinks.scratch(spark, name) for name in tables}
    for name, rows in tables.items():
        rows.write.option("sep", "\t").csv(paths[name])
    return readers.read_splits(spark, paths, readers.read_tsv)


@query("SELECT text, count(*) OVER () AS n_files FROM (SELECT r_name || chr(10) AS text FROM region UNION ALL SELECT '')")
def documents_round_trip(spark, sf):
    """Text files, one for each region and one without bytes, found below a folder and read whole."""
    path = sinks.scratch(spark, "texts")
    names = _t(spark, sf, "region").select(F.col("r_name").alias("value"), F.col("r_name").alias("k"))
    names.write.partitionBy("k").text(path)
    names.select("value").where("false").coalesce(1).write.text(f"{path}/k=none at all")
    files = readers.list_files(spark, path, ".txt").agg(F.count("*").alias("n_files"))
    return readers.read_documents(spark, path).select("text").crossJoin(F.broadcast(files))  # one row


@query(_metrics_sql(f"{MATRIX} ({TRUTHS})"))
def metrics_json_round_trip(spark, sf):
    path = sinks.scratch(spark, "metrics")
    measured = metrics_binary(spark, sf)
    sinks.write_json(measured, path)
    return readers.read_json(spark, path, measured.schema)


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS term FROM documents), "
       "r AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS i FROM w GROUP BY lang, term) "
       "SELECT DISTINCT term, tokenizer, 1::bigint AS n_tokens, [term] AS tokens FROM r, (VALUES ('words'), ('pretokens')) AS k(tokenizer) WHERE i <= 11")
def key_term_pieces(spark, sf):
    """How tokenizers cut up the most frequent long words of each language."""
    from pyspark.sql import Window

    terms = _t(spark, sf, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("term"))
    ranked = terms.groupBy("lang", "term").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")))
    return tokens.key_terms(spark, sorted({r.term for r in ranked.where("i <= 11").select("term").collect()}))  # eleven a language


# ---- aggregates

@query("SELECT count(*) AS n FROM documents")
def count_rows(spark, sf):
    return _t(spark, sf, "documents").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf):
    return metrics.value_counts(_t(spark, sf, "documents"), "lang").orderBy(F.desc("n"), "lang")


@query("SELECT toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def counter_by_key(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left")
    return metrics.value_counts(rows, "toxic", nulls=True)


@query("SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'toxic' END AS field, coalesce(lang, source, toxic::varchar) AS value, count(*) AS n "
       "FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (toxic))")
def distribution_grouping_sets(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "lang", "source").join(_t(spark, sf, "labels"), "doc_id")
    out = rows.groupingSets([["lang"], ["source"], ["toxic"]], "lang", "source", "toxic").agg(
        F.count("*").alias("n"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return out.select(
        F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("toxic").alias("field"),
        F.coalesce("lang", "source", F.col("toxic").cast("string")).alias("value"), "n",
    )


@query("SELECT count(*) AS n, count(*) // 4 AS each FROM labels")
def review_workload(spark, sf):
    return _t(spark, sf, "labels").agg(F.count("*").alias("n")).select("n", F.floor(F.col("n") / 4).cast("long").alias("each"))


@query("SELECT quality AS majority FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1")
def majority_class(spark, sf):
    return metrics.majority_class(_t(spark, sf, "labels"), "quality")


@query(f"{MATRIX} ({TRUTHS})")
def confusion_matrix(spark, sf):
    return metrics.confusion(_guessed(spark, sf), "truth", "predicted")


@query(_metrics_sql(f"{MATRIX} ({TRUTHS})"))
def metrics_binary(spark, sf):
    return metrics.metrics(metrics.confusion(_guessed(spark, sf), "truth", "predicted"))


@query(f"SELECT fn AS false_negatives, fn + tp AS positives, fp AS false_positives, fp + tn AS negatives FROM ({MATRIX} ({TRUTHS}))")
def error_summary(spark, sf):
    return metrics.errors(metrics.confusion(_guessed(spark, sf), "truth", "predicted"))


@query(f"SELECT recall >= 0.85 AS recall_met, f1_macro > 0.75 AS f1_met FROM ({_metrics_sql(f'{MATRIX} ({TRUTHS})')})")
def metric_goal_check(spark, sf):
    return metrics.goals(metrics_binary(spark, sf))


@query(f"SELECT doc_id, toxic, ({MAJORITY}) AS predicted FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split = 'test'")
def majority_baseline_predict(spark, sf):
    return _baseline(spark, sf).select("doc_id", "toxic", "predicted")


@query(_metrics_sql(f"{MATRIX} ({BASELINE})"))
def majority_baseline_metrics(spark, sf):
    return metrics.metrics(metrics.confusion(_baseline(spark, sf), "toxic", "predicted"))


@query("SELECT metric, baseline, model, model - baseline AS delta FROM "
       f"(SELECT unnest(['accuracy', 'f1_macro', 'recall']) AS metric, unnest([accuracy, f1_macro, recall]) AS baseline FROM ({_metrics_sql(f'{MATRIX} ({BASELINE})')})) FULL JOIN "
       f"(SELECT unnest(['accuracy', 'f1_macro', 'recall']) AS metric, unnest([accuracy, f1_macro, recall]) AS model FROM ({_metrics_sql(f'{MATRIX} ({TRUTHS})')})) USING (metric)")
def metric_delta(spark, sf):
    base = metrics.long_form(majority_baseline_metrics(spark, sf), "baseline")
    return metrics.delta(base, metrics.long_form(metrics_binary(spark, sf), "model"))


@query("SELECT metric, rpad(metric, 15, ' ') || ' ' || printf('%.4f', baseline) || ' ' || printf('%.4f', model) || ' ' || printf('%+.4f', delta) AS line FROM ("
       "SELECT metric, baseline, model, model - baseline AS delta FROM "
       f"(SELECT unnest(['accuracy', 'f1_macro', 'recall']) AS metric, unnest([accuracy, f1_macro, recall]) AS baseline FROM ({_metrics_sql(f'{MATRIX} ({BASELINE})')})) FULL JOIN "
       f"(SELECT unnest(['accuracy', 'f1_macro', 'recall']) AS metric, unnest([accuracy, f1_macro, recall]) AS model FROM ({_metrics_sql(f'{MATRIX} ({TRUTHS})')})) USING (metric))")
def metric_report_lines(spark, sf):
    return metrics.report_lines(metric_delta(spark, sf))


@query(f"SELECT tn, fp, fn, tp, round(accuracy, 4) AS accuracy, round(f1_macro, 4) AS f1_macro, round(recall, 4) AS recall FROM ({_metrics_sql(f'{MATRIX} ({TRUTHS})')})")
def metrics_rounded(spark, sf):
    return metrics.rounded(metrics_binary(spark, sf))


# ---- windows, order, samples

@query(SPLIT_SQL)
def stratified_split(spark, sf):
    return split.stratified_split(_t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_hash('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 18")
def sample_k_per_category(spark, sf):
    return split.sample_per_stratum(_t(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", config.PER_CATEGORY)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def top_k_per_group(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    return _t(spark, sf, "documents").select("source", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def top_k(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query(f"SELECT doc_id, {_hash('doc_id')} AS place FROM documents ORDER BY place, doc_id")
def hash_shuffle(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", split.hash_order(F.col("doc_id")).alias("place")).orderBy("place", "doc_id")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_all(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(_t(spark, sf, "supplier").select(F.col("s_name").alias("name")))


# ---- scalar functions

@query("SELECT p_partkey, replace(lower(regexp_replace(p_type, '^\\s+|\\s+$', '', 'g')), '.', '') AS code FROM part")
def normalize_code(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", tx.normalize_code(F.col("p_type")).alias("code"))


@query(f"SELECT doc_id, {CLEAN} AS text FROM documents")
def clean_truncate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.clean_truncate(F.col("text"), config.TEXT_CHARS).alias("text"))


@query(f"SELECT doc_id, {WORDS} AS n_words FROM documents")
def word_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT doc_id, {PRETOKENS} AS n_tokens FROM documents")
def pretoken_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.size(tx.pretokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, CASE WHEN {WORDS} <> 0 THEN {PRETOKENS} / ({WORDS})::double END AS ratio FROM documents")
def token_ratio(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.ratio(F.size(tx.pretokens(F.col("text"))), tx.word_count(F.col("text"))).alias("ratio"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def basename(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.basename(F.col("url")).alias("name"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint AS class FROM embeddings")
def embedding_argmax(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("class"))


@query("SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 9)) AS probabilities FROM "
       "(SELECT vec_id, list_transform(embedding, lambda x: exp((x - list_max(embedding))::double)) AS e FROM embeddings)")
def embedding_softmax(spark, sf):
    p = vectors.softmax(F.col("embedding"))
    return _t(spark, sf, "embeddings").select("vec_id", F.transform(p, lambda x: F.round(x, 9)).alias("probabilities"))


# ---- tokens

PROFILE = (f"SELECT doc_id, {WORDS} AS n_words, 'words' AS tokenizer, {WORDS} AS n_tokens FROM documents UNION ALL "
           f"SELECT doc_id, {WORDS}, 'pretokens', {PRETOKENS} FROM documents")


@query(f"SELECT *, CASE WHEN n_words <> 0 THEN n_tokens / n_words::double END AS tokens_per_word FROM ({PROFILE})")
def token_profile(spark, sf):
    return tokens.profile(_t(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


# White space is Unicode's, as in the query: RE2's \s is ASCII.  The mean is added up in whole numbers of 1, 2^-26 and 2^-52, as in the query: a sum of doubles depends on the rows' order.
SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
COMPARE = (
    rf"WITH c AS (SELECT len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '')) AS n_words, "
    rf"len(regexp_extract_all(text, '[^{SPACE}\p{{P}}$+<=>^`|~]+|[\p{{P}}$+<=>^`|~]')) AS n_pretokens FROM documents), "
    "p AS (SELECT 'words' AS tokenizer, n_words, n_words AS n_tokens FROM c UNION ALL SELECT 'pretokens', n_words, n_pretokens FROM c), "
    "r AS (SELECT tokenizer, CASE WHEN n_words <> 0 THEN n_tokens / n_words::double END AS ratio FROM p), "
    "h AS (SELECT tokenizer, ratio, (ratio - floor(ratio)) * 67108864 AS high FROM r), "
    "m AS (SELECT tokenizer, (sum(floor(ratio)::bigint)::double + (sum(floor(high)::bigint)::double + sum(floor((high - floor(high)) * 67108864)::bigint)::double / 67108864) / 67108864) "
    "/ nullif(count(ratio), 0) AS mean, count(*) AS n FROM h GROUP BY tokenizer) "
    "SELECT tokenizer, floor(mean * 1e9 + 0.5) / 1e9 AS mean_ratio, n FROM m"
)


@query(COMPARE)
def tokenizer_compare(spark, sf):
    out = tokens.compare(tokens.profile(_t(spark, sf, "documents").select("text"), "text"))
    return out.select("tokenizer", (F.floor(F.col("mean_ratio") * 1e9 + 0.5) / 1e9).alias("mean_ratio"), "n")


@query(f"SELECT lang, round(avg(CASE WHEN {WORDS} <> 0 THEN {PRETOKENS} / ({WORDS})::double END), 9) AS mean_ratio FROM documents GROUP BY lang")
def mean_token_ratio(spark, sf):
    ratio = tx.ratio(F.size(tx.pretokens(F.col("text"))), tx.word_count(F.col("text")))
    return _t(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(ratio), 9).alias("mean_ratio"))


@query(r"SELECT doc_id, list_slice(regexp_extract_all(text, '[^\s\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]'), 1, 128) AS tokens FROM documents")
def token_truncate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tokens.truncate(tx.pretokens(F.col("text")), config.MAX_TOKENS).alias("tokens"))


def _vocabulary(spark: SparkSession) -> list[str]:
    """A WordPiece vocabulary by rule: the pieces of a public tokenizer, at the start of a word and behind it; written and read as a file of one piece a line."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = dict.fromkeys(p.removesuffix("</w>") for p in json.load(f)["model"]["vocab"])
    lines = [wordpiece.UNKNOWN, *dict.fromkeys(x for p in pieces if p for x in (p, wordpiece.CONTINUED + p))]
    path = sinks.scratch(spark, "vocabulary")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return wordpiece.read_vocabulary(spark, path)


@query("SELECT count(*) AS n, 0::bigint AS n_different FROM documents")
def wordpiece_equivalence(spark, sf):
    """Texts that a public library cuts into other pieces by the same vocabulary: none."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    vocabulary = _vocabulary(spark)
    own = Tokenizer(models.WordPiece({p: i for i, p in enumerate(vocabulary)}, unk_token=wordpiece.UNKNOWN, max_input_chars_per_word=wordpiece.LONGEST_WORD))
    own.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False)
    own.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    saved = own.to_str()
    a, b = wordpiece.tokenizer(vocabulary)(F.col("text")), tokens.tokenizer_of(saved)(F.col("text"))
    both = _t(spark, sf, "documents").select(a.alias("a"), b.alias("b"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))


@query(f"SELECT doc_id, {WORDS} AS n_words, true AS cuts_more FROM documents")
def wordpiece_profile(spark, sf):
    """Words of each text, and whether its WordPieces are as many or more; the pieces' number has no SQL and is tested against the library."""
    rows = wordpiece.profile(_t(spark, sf, "documents").select("doc_id", "text"), "text", {"wordpiece": _vocabulary(spark)})
    return rows.select("doc_id", "n_words", (F.col("n_tokens") >= F.col("n_words")).alias("cuts_more"))


@query()
def wordpiece_compare(spark, sf):
    """The mean of pieces a word, of WordPiece beside words and pre-tokens."""
    own = {**tokens.TOKENIZERS, "wordpiece": wordpiece.tokenizer(_vocabulary(spark))}
    return tokens.compare(tokens.profile(_t(spark, sf, "documents").select("text"), "text", own))


# ---- models: results differ by platform, so these have no SQL

def _fitted(spark: SparkSession, sf: str):
    rows = _labelled_split(spark, sf).join(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id").withColumn("label", F.col("toxic").cast("double"))
    return model.train(rows.where("split = 'train'"), "text", "label"), rows.where("split = 'test'")


@query()
def ml_train_predict(spark, sf):
    fitted, test = _fitted(spark, sf)
    return model.predict(fitted, test, "text").select("doc_id", "toxic", "predicted", "probability")


@query()
def ml_predict(spark, sf):
    fitted, _ = _fitted(spark, sf)
    return model.predict(fitted, _t(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "predicted")


@query()
def ml_metrics(spark, sf):
    fitted, test = _fitted(spark, sf)
    return model.evaluate(model.predict(fitted, test, "text"), "toxic")


@query(f"SELECT count(*) AS n, count_if(toxic = 1)::bigint AS n_toxic, count(*) AS n_probabilities FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split = 'test'")
def ml_test_rows(spark, sf):
    """What is known of the predictions on any platform: a row for each test row, its label beside it, and a probability."""
    fitted, test = _fitted(spark, sf)
    rows = model.predict(fitted, test, "text").where("predicted in (0, 1)")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("probability").between(0, 1)).alias("n_probabilities"))


@query(f"SELECT count(*) AS n, 0::bigint AS n_different FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split = 'test'")
def ml_reload_equivalence(spark, sf):
    """Rows for which a model saved and loaded again predicts otherwise: none."""
    fitted, test = _fitted(spark, sf)
    path = sinks.scratch(spark, "model")
    model.save(fitted, path)
    a = model.predict(fitted, test, "text").select("doc_id", F.col("predicted").alias("before"))
    b = model.predict(model.load(path), test, "text").select("doc_id", F.col("predicted").alias("after"))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("n_different"))


@query(f"SELECT count(*) AS n, 0::bigint AS n_different FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split = 'test'")
def ml_batched_equivalence(spark, sf):
    """Rows for which scoring in batches of 8 gives another label or probability than the pipeline: none."""
    fitted, test = _fitted(spark, sf)
    a = model.predict(fitted, test, "text").select("doc_id", "predicted", "probability")
    b = model.predict_in_batches(fitted, test, "text").select("doc_id", F.col("predicted").alias("p2"), F.col("probability").alias("q2"))
    other = (F.col("predicted") != F.col("p2")) | (F.abs(F.col("probability") - F.col("q2")) > 1e-9)
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(other).alias("n_different"))


# ---- the adapter on a frozen base; its scores differ by platform, the rows that they are of don't

EPOCHS, BATCH, RATE = 3, 128, 5e-3
HELD = f"SELECT * FROM labels l JOIN ({SPLIT_SQL}) s USING (doc_id) WHERE split ="


def _adapted(spark: SparkSession, sf: str):
    """(base, estimator, labelled rows): the base of all documents' texts, and the labelled rows with their split, written once as they are read many times."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    base = adapter.fit_base(docs, "text")
    path = sinks.scratch(spark, "labelled-texts")
    _labelled_split(spark, sf).join(docs, "doc_id").withColumn("held", F.col("split") == "val").write.parquet(path)
    rows = spark.read.parquet(path)
    return base, adapter.AdapterClassifier(base=base, labelCol="toxic", validationIndicatorCol="held", maxIter=EPOCHS, batchSize=BATCH, stepSize=RATE), rows


@query()
def adapter_epochs(spark, sf):
    """Loss and metrics on the validation rows after each epoch, and before the first."""
    _, estimator, rows = _adapted(spark, sf)
    return estimator.fit(rows.where("split <> 'test'")).history_frame(spark)


@query(f"SELECT epoch::bigint AS epoch, count(*) AS rows, 0::bigint AS n_different FROM ({HELD} 'val'), range(0, {EPOCHS + 1}) AS e(epoch) GROUP BY epoch")
def adapter_seed_equivalence(spark, sf):
    """By epoch the measures that a second fit with the same seed, on rows in other partitions, gives otherwise: none."""
    _, estimator, rows = _adapted(spark, sf)
    known = rows.where("split <> 'test'")
    a, b = (estimator.fit(df).history_frame(spark) for df in (known, known.repartition(3, "quality")))
    names = ["rows", "loss", "accuracy", "f1_macro", "recall"]
    again = b.select("epoch", *[F.col(c).alias(f"_{c}") for c in names])
    differ = sum(((F.col(c) != F.col(f"_{c}")).cast("long") for c in names), F.lit(0).cast("long"))
    return a.join(again, "epoch").select("epoch", "rows", differ.alias("n_different"))


@query(f"SELECT count(*) AS n, count_if(toxic = 1)::bigint AS n_toxic, 0::bigint AS n_different, "
       f"({config.ADAPTER['rank']} * ({config.ADAPTER['features']} + {config.ADAPTER['hidden']}) + 2 * {config.ADAPTER['hidden']} + 2)::bigint AS n_trained FROM ({HELD} 'test')")
def adapter_reload_equivalence(spark, sf):
    """Test rows for which the adapter, stored apart from its base and put onto it again, scores otherwise: none."""
    base, estimator, rows = _adapted(spark, sf)
    fitted = estimator.fit(rows.where("split <> 'test'"))
    paths = [sinks.scratch(spark, name) for name in ("base", "adapter")]
    base.save(spark, paths[0])
    fitted.write().save(paths[1])
    again = adapter.AdapterModel.load(paths[1]).attach(adapter.Base.load(spark, paths[0]))
    test = rows.where("split = 'test'").select("doc_id", "toxic", "text")
    both = fitted.transform(test).join(again.transform(test).select("doc_id", F.col("predicted").alias("p2"), F.col("probability").alias("q2")), "doc_id")
    other = (F.col("predicted") != F.col("p2")) | (F.col("probability") != F.col("q2"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(other).alias("n_different"), F.lit(again.trained_size).cast("long").alias("n_trained"))


@query(f"SELECT kind, count(*) AS n, 0::bigint AS n_different FROM ({HELD} 'test'), (VALUES ('adapter'), ('pipeline'), ('vocabulary')) AS k(kind) GROUP BY kind")
def store_by_id(spark, sf):
    """Test rows that models loaded by their id from a store score or cut up otherwise than before: none."""
    base, estimator, rows = _adapted(spark, sf)
    known, test = rows.where("split <> 'test'"), rows.where("split = 'test'").select("doc_id", "text")
    own = {"adapter": estimator.fit(known, {estimator.maxIter: 1}), "pipeline": model.train(known.withColumn("label", F.col("toxic").cast("double")), "text", "label"), "vocabulary": _vocabulary(spark)}
    kept = store.Store(spark, sinks.scratch(spark, "store"))
    kept.put("own/base", base)
    out = None
    for kind, thing in own.items():
        kept.put(f"own/{kind}", thing, "own/base" if kind == "adapter" else None)
        again = kept.get(f"own/{kind}")
        if kind == "vocabulary":
            a, b = (test.select("doc_id", wordpiece.tokenizer(v, ids=True)(F.col("text")).alias(c)) for v, c in ((thing, "a"), (again, "b")))
        else:
            score = (lambda m: m.transform(test)) if kind == "adapter" else (lambda m: model.predict(m, test, "text"))
            a, b = (score(m).select("doc_id", F.col("probability").alias(c)) for m, c in ((thing, "a"), (again, "b")))
        part = a.join(b, "doc_id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_different"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- the whole keyword flow in one query, and the flagship

@query(f"SELECT label, count(*) AS n, sum(length(text))::bigint AS chars FROM (SELECT {CLEAN} AS text, CASE WHEN {ANY_URGENT} THEN 'urgente' ELSE 'revisar_manual' END AS label FROM documents WHERE {ANY_TERM}) GROUP BY label")
def keyword_flow(spark, sf):
    found = curate.keyword_candidates(_t(spark, sf, "documents").select("text"), "text", TERMS, URGENT)
    return found.groupBy(F.col("suggested_label").alias("label")).agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars"))


@query(_metrics_sql(f"{MATRIX} ({BASELINE})"), name="flagship")
def flagship(spark, sf):
    """Documents with labels, split by language, scored by the majority baseline."""
    return majority_baseline_metrics(spark, sf)
