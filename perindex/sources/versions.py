"""Tables that are replaced as a whole: versions, and a pointer to the current one.

An overwrite in place deletes the old rows before the new ones are there. Here a write
goes to a folder of its own, a small pointer file is then exchanged in one step, and the
old folder is removed last. A run that fails anywhere leaves the old table readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER, PREFIX = "_CURRENT", "v-"


def _place(spark: SparkSession, path: str):
    """The Hadoop path of ``path`` and its file system, whichever it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system it names."""
    place, files = _place(spark, path)
    return files.exists(place)


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the current version of the table in ``path``; None if it has no versions."""
    pointer, files = _place(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def resolve(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of ``path``.

    ``path`` may be a table with versions, one of several tables under a common
    version, or a plain folder, which is returned as it is.
    """
    path = path.rstrip("/")
    if version := current(spark, path):
        return f"{path}/{version}"
    parent, _, name = path.rpartition("/")
    if parent and (version := current(spark, parent)):
        return f"{parent}/{version}/{name}"
    return path


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Exchange the pointer by a rename over it, which readers see before or after."""
    jvm = spark._jvm
    pointer, files = _place(spark, f"{path}/{POINTER}")
    fresh, _ = _place(spark, f"{path}/{POINTER}-{version}")
    stream = files.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(fresh), files.makeQualified(pointer), over)


def replace(
    spark: SparkSession,
    path: str,
    write: Callable[[str], None],
    owned: tuple[str, ...] | None = None,
) -> str:
    """Let ``write`` fill a new version of ``path``, then make it the current one.

    What the new version replaces is removed after that: the version before it, and
    the folders named in ``owned``, which an unversioned table may have left (by
    default everything else in ``path``). Returns the folder of the new version. One
    writer at a time is assumed, as for any overwrite.
    """
    version = f"{PREFIX}{uuid.uuid4().hex}"
    before = current(spark, path)
    folder = f"{path}/{version}"
    try:
        write(folder)
        _point(spark, path, version)
    except BaseException:
        unfinished, files = _place(spark, folder)
        files.delete(unfinished, True)
        raise
    root, files = _place(spark, path)
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name in (version, POINTER):
            continue
        if name == before or owned is None or name in owned:
            files.delete(status.getPath(), True)
    return folder
