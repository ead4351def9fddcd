"""Readers with explicit schemas."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "texto string, categoria_ham10000 string, etiqueta_urgencia string, tipo_fuente string, fuente_detalle string, split string"
CODES = "articleID string, codigo string"
METRICS = ("accuracy double, f1_macro double, recall_urgente double, matriz_confusion struct<no_urgente_predicho_correctamente:bigint,"
           "no_urgente_predicho_como_urgente:bigint,urgente_predicho_como_no_urgente:bigint,urgente_predicho_correctamente:bigint>,"
           "tipo_baseline string, clase_predicha_siempre string")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, line_ends: bool = True) -> DataFrame:
    """Header, quoted commas and line ends, doubled quotes; blank fields are NULL.

    A file whose fields may hold line ends is read by one task; where they can't
    (``line_ends=False``) large files are read in parts.
    """
    return spark.read.schema(schema).option("header", True).option("multiLine", line_ends).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType = CODES) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def _with_empty(files: DataFrame) -> DataFrame:
    """``path, content`` of the files, those without bytes too, whose content is NULL.

    Spark's readers skip files without bytes but list them; the listing, which the
    driver has anyway, is joined with what was read.
    """
    listed = [(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    known = files.sparkSession.createDataFrame(listed, "path string")
    empty = known.join(files.where("length > 0").select("path"), "path", "left_anti")
    return files.where("length > 0").select("path", "content").unionByName(empty.withColumn("content", F.lit(None).cast("binary")))


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``file_name, stem, text``, one row per file below ``path``.

    Bytes that aren't UTF-8 are dropped and line ends become \\n.  A file without bytes has an empty text.
    """
    def decode(batches):
        import pyarrow as pa

        for b in batches:
            texts = [(x or b"").decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["file_name", "text"])

    files = _with_empty(_files(spark, path, pattern))
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInArrow(decode, "file_name string, text string")
    return named.select("file_name", F.regexp_replace("file_name", r"\.[^.]*$", "").alias("stem"), "text")


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Paths below ``path`` that end in ``suffix``, of files without bytes too; contents aren't read."""
    return _with_empty(_files(spark, path, f"*{suffix}")).select("path")


def read_splits(spark: SparkSession, paths: dict[str, str], reader) -> DataFrame:
    """``reader(spark, path)`` of each split, with its name as ``split_original``."""
    out = None
    for name, path in paths.items():
        part = reader(spark, path).withColumn("split_original", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, whole: bool = True) -> DataFrame:
    """One document a file, or with ``whole=False`` one a line, which large files need to be read in parts."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def literal_cases(spark: SparkSession, cases: list[dict[str, str]]) -> DataFrame:
    """Cases written out in a program as a relation: a column for each name that occurs, NULL where a case lacks it."""
    names = list(dict.fromkeys(n for c in cases for n in c))
    return literal(spark, [tuple(c.get(n) for n in names) for c in cases], ", ".join(f"`{n}` string" for n in names))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
