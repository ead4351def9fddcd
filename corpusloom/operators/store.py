"""A folder of models by id: classifiers, bases, adapters and vocabularies, each loaded by its name alone.

An entry is a folder with a manifest (kind, and for an adapter the id of its base) beside the
model's own files.  An entry is written under a name of its own first and its manifest last,
so that an entry without a manifest, left by a job that died, isn't found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from . import adapter, model, wordpiece


@dataclass
class Store:
    """Models below ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[\w.-]+(/[\w.-]+)?", name) or ".." in name:
            raise ValueError(f"not an id: {name}")
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def put(self, name: str, thing: PipelineModel | adapter.Base | adapter.AdapterModel | list[str], base: str | None = None) -> None:
        """Keep a model as ``name``; an id that is taken is an error, and so is an adapter whose base isn't kept as ``base``."""
        path = self._path(name)
        if self._exists(f"{path}/manifest"):
            raise ValueError(f"there is a model {name}")
        if isinstance(thing, adapter.AdapterModel):
            if base is None or self.get(base).fingerprint != thing.of:
                raise ValueError("an adapter is kept with the id of the base that it was trained on")
            kind = "adapter"
            thing.write().overwrite().save(f"{path}/files")
        elif isinstance(thing, adapter.Base):
            kind = "base"
            thing.save(self.spark, f"{path}/files")
        elif isinstance(thing, list):
            kind = "vocabulary"
            self.spark.createDataFrame([("\n".join(thing),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/files")
        else:
            kind = "pipeline"
            model.save(thing, f"{path}/files")
        self.spark.createDataFrame([(kind, base)], "kind string, base string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    def get(self, name: str):
        """What is kept as ``name``: an adapter comes attached to its base; an unknown id is an error."""
        path = self._path(name)
        if not self._exists(f"{path}/manifest"):
            raise KeyError(f"no model {name}")
        kept = self.spark.read.schema("kind string, base string").json(f"{path}/manifest").first()
        files = f"{path}/files"
        if kept.kind == "adapter":
            return adapter.AdapterModel.load(files).attach(self.get(kept.base))
        if kept.kind == "base":
            return adapter.Base.load(self.spark, files)
        return wordpiece.read_vocabulary(self.spark, files) if kept.kind == "vocabulary" else model.load(files)
