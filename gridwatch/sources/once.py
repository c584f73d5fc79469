"""Files that are created whole and only once, and listings of date folders, on any file system that Spark reaches."""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path)


def _conf(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call created ``path``: of several writers at once one does. Readers see nothing or all of it, as a
    finished temporary file takes the name and an existing file isn't replaced."""
    folder, name = path.rsplit("/", 1)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if (own := _local(temporary)) is not None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, _local(path))  # fails where the name is taken, unlike a rename
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    jvm, conf = spark.sparkContext._jvm, _conf(spark)
    fs = _path(spark, path).getFileSystem(conf)
    out = fs.create(_path(spark, temporary), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context, options = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), conf), jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.NONE
    try:
        context.rename(_path(spark, temporary), _path(spark, path), how)
    except Py4JJavaError as e:
        fs.delete(_path(spark, temporary), False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there. No file is opened."""
    p = _path(spark, path)
    fs = p.getFileSystem(_conf(spark))
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def partition_values(spark: SparkSession, path: str, column: str = "date") -> list[str]:
    """Values of a partition column by the names of its folders."""
    found = (re.fullmatch(re.escape(column) + "=(.*)", n) for n in listed(spark, path))
    return [unquote(m[1]) for m in found if m]
