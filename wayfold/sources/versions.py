"""Versioned layers: a version is written whole beside the others, then activated by one file that only one writer can make.

``_log/<number>.json`` names each version's folder; the highest number is the active one. A writer says which version its work is based on and claims the
next number: if another has it already, the writer fails and nothing has changed. A crash before the claim leaves a folder that nothing
names. Readers look at the log once and then read one version's folder, which no later upgrade touches until drop_old().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_log"


class Conflict(RuntimeError):
    """Another writer has activated a version since."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    layers: tuple[str, ...]

    def read(self, spark: SparkSession, layer: str) -> DataFrame:
        if layer not in self.layers:
            raise KeyError(f"version {self.number} has no layer {layer}")
        return spark.read.parquet(f"{self.folder}/{layer}")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _entry(root: str, number: int) -> str:
    return f"{root}/{LOG}/{number:012d}.json"


def _log(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/{LOG}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The active version, or an earlier one by its number; None if nothing has been activated. What it reads never changes."""
    root = root.rstrip("/")
    log = _log(spark, root)
    number = number if number is not None else log[-1] if log else None
    if number is None:
        return None
    if number not in log:
        raise KeyError(f"no version {number}")
    text = spark.read.text(_entry(root, number), wholetext=True).first().value
    found = json.loads(text)
    return Version(number, f"{root}/{found['folder']}", tuple(found["layers"]))


def write(layers: dict[str, DataFrame], root: str) -> str:
    """Writes layers to a new folder below ``root`` that nothing names yet; returns the folder."""
    if not layers:
        raise ValueError("a version needs layers")
    folder = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, df in layers.items():
        df.write.parquet(f"{folder}/{name}")
    return folder


def activate(spark: SparkSession, root: str, folder: str, layers: tuple[str, ...], based_on: int | None) -> Version:
    """Makes ``folder`` the active version if ``based_on`` (None: nothing) still is; raises Conflict if not, and changes nothing.

    The claim is a file that must not exist: it is written under another name and then renamed, which the store does only if the name is free.
    """
    root = root.rstrip("/")
    log = _log(spark, root)
    active = log[-1] if log else None
    if active != based_on:
        raise Conflict(f"version {active} is active, not {based_on}")
    number = 0 if based_on is None else based_on + 1
    fs, directory = _fs(spark, f"{root}/{LOG}")
    fs.mkdirs(directory)
    _, staged = _fs(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}")
    _, entry = _fs(spark, _entry(root, number))
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps({"folder": folder.rpartition("/")[2], "layers": sorted(layers)}, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri() if entry.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(staged, entry, none)
    except Py4JJavaError as e:
        fs.delete(staged, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(entry):
            raise Conflict(f"version {number} was activated meanwhile") from None
        raise
    return Version(number, folder, tuple(sorted(layers)))


def upgrade(layers: dict[str, DataFrame], root: str, based_on: int | None) -> Version:
    """write(), then activate(). A writer that loses removes what it has written."""
    spark = next(iter(layers.values())).sparkSession
    folder = write(layers, root)
    try:
        return activate(spark, root, folder, tuple(layers), based_on)
    except Conflict:
        fs, path = _fs(spark, folder)
        fs.delete(path, True)
        raise


def drop_old(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes the folders of all but the ``keep`` newest versions, and what writers that came to nothing have left; returns their names.

    To be called after an activation, when no one reads the older versions or writes a new one any more. Log entries stay: numbers are never used twice.
    """
    if keep < 1:
        raise ValueError("the active version stays")
    root = root.rstrip("/")
    kept = {current(spark, root, n).folder.rpartition("/")[2] for n in _log(spark, root)[-keep:]}
    fs, path = _fs(spark, root)
    gone = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("v-") and name not in kept:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
