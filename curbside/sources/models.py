"""Fitted models on shared storage; the label vocabulary is part of them.

A ``ModelStore`` names a model by what it was made from: the files behind its
input tables (path, size, time) and its parameters.  A model is written to a
folder of its own, then published by renaming a small manifest, which names the
folder, into place.  So changed tables give a new model, nobody reads one that is
half written, and of two writers of one model either serves both.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

#: What reading a missing or broken model raises.
UNREADABLE = (Py4JJavaError, PySparkException, ValueError, KeyError)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_or_none(path: str) -> PipelineModel | None:
    """The stored model, or none if it is missing or unreadable."""
    try:
        return load_model(path)
    except UNREADABLE:
        return None


def load_or_train(path: str, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The stored model, or a newly trained one if it is missing or unreadable."""
    model = load_or_none(path)
    if model is None:
        model = train()
        save_model(model, path)
    return model


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's path and the file system that holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def input_files(tables: Iterable[DataFrame]) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of the files behind the tables, in order."""
    wanted: dict[str, set[str]] = defaultdict(set)
    spark = None
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles():
            wanted[file.rsplit("/", 1)[0]].add(file)
    found = set()
    for folder, files in wanted.items():
        place, system = _file_system(spark, folder)
        for status in system.listStatus(place):
            path = status.getPath()
            if path.toUri().toString() in files or path.toString() in files:
                found.add((path.toString(), status.getLen(), status.getModificationTime()))
    missing = sum(map(len, wanted.values())) - len(found)
    if missing:
        raise ValueError(f"{missing} input files are not listed in their folders")
    return sorted(found)


def fingerprint(tables: Iterable[DataFrame], **parameters: Any) -> str:
    """Digest of the files behind the tables and of the parameters."""
    made_from = json.dumps([input_files(tables), parameters], sort_keys=True, default=str)
    return hashlib.sha256(made_from.encode()).hexdigest()


class ModelStore:
    """Models, or tables made for them, under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, name: str, made_from: str) -> str:
        return f"{self.root}/{name}/{made_from}.json"

    def manifest(self, name: str, made_from: str) -> dict | None:
        """What was published of this name and origin, if anything."""
        path = self._manifest(name, made_from)
        place, system = _file_system(self.spark, path)
        if not system.exists(place):
            return None
        try:
            found = json.loads(self.spark.read.text(path, wholetext=True).first()[0])
        except (*UNREADABLE, TypeError):
            return None
        return found if found.get("made_from") == made_from and "folder" in found else None

    def publish(self, name: str, made_from: str, save: Callable[[str], None], **notes: Any) -> str:
        """Write by ``save(folder)``, then make it the one that readers find; gives the
        folder they find, which is another's if that was first."""
        base = f"{self.root}/{name}"
        folder = f"{base}/{uuid.uuid4().hex}"
        save(folder)
        draft, system = _file_system(self.spark, f"{folder}.draft")
        out = system.create(draft, True)
        content = {"name": name, "made_from": made_from, "folder": folder, **notes}
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        final, _ = _file_system(self.spark, self._manifest(name, made_from))
        if not system.rename(draft, final):
            system.delete(draft, False)
        published = self.manifest(name, made_from)
        if published is None:
            # Something unreadable lies where the manifest belongs.
            raise ValueError(f"no manifest could be published at {self._manifest(name, made_from)}")
        if published["folder"] != folder:
            own, _ = _file_system(self.spark, folder)
            system.delete(own, True)
        return published["folder"]

    def withdraw(self, name: str, made_from: str) -> None:
        """Take the manifest away, so that the next to ask makes the model anew."""
        place, system = _file_system(self.spark, self._manifest(name, made_from))
        system.delete(place, False)

    def find(self, name: str, made_from: str, load: Callable[[str], Any] = load_model) -> Any | None:
        """The published model, or none if there is none or it cannot be read."""
        published = self.manifest(name, made_from)
        try:
            return None if published is None else load(published["folder"])
        except UNREADABLE:
            return None

    def get(
        self,
        name: str,
        made_from: str,
        make: Callable[[], Any],
        save: Callable[[Any, str], None] = save_model,
        load: Callable[[str], Any] = load_model,
        reread: bool = False,
        **notes: Any,
    ) -> Any:
        """The published model, else a newly made one, published now; with ``reread``
        (for what is only computed on writing) as it was stored."""
        found = self.find(name, made_from, load)
        if found is None:
            self.withdraw(name, made_from)
            made = make()
            folder = self.publish(name, made_from, lambda folder: save(made, folder), **notes)
            found = load(folder) if reread else made
        return found
