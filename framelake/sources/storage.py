"""Listing and small files on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def files(spark: SparkSession, path: str) -> list[str]:
    """All files under ``path``, sorted; none if there is no such path.  ``listFiles`` would ask for each
    file's owner and blocks, which on a local file system starts a process a file."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    out, rest = [], [p]
    while rest:
        for s in fs.listStatus(rest.pop()):
            if s.isDirectory():
                rest.append(s.getPath())
            else:
                out.append(s.getPath().toString())
    return sorted(out)


def touch(spark: SparkSession, path: str) -> None:
    _fs(spark, path).create(_path(spark, path), True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme."""
    return _fs(spark, path).makeQualified(_path(spark, path)).toString()


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Folders right below ``path`` whose names start with ``prefix``."""
    fs, p = _fs(spark, path), _path(spark, path)
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(x.toString() for x in found if x.getName().startswith(prefix))


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, to = _fs(spark, source), _path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_path(spark, source), to):
        raise OSError(f"cannot move {source} to {target}")
