"""Files of any store that Spark reaches, through Hadoop's FileSystem."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Stores in which of two writers of a name the later one wins.
NOT_EXCLUSIVE = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs"}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file, whole or not at all; False if there is one already.

    The text goes to a hidden file first, which then gets the name if no other has it: by a link on a local or mounted disk,
    by a rename that doesn't overwrite on HDFS and the like.  Stores without such a step are refused.
    """
    fs, p = _fs(spark, path)
    if (scheme := fs.getUri().getScheme()) in NOT_EXCLUSIVE:
        raise ValueError(f"{scheme} can't give a name to one of two writers; keep the table on HDFS or a mounted disk")
    jvm = spark._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if scheme == "file":
            name = lambda x: jvm.java.nio.file.Path.of(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(x).toString(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(name(p), name(hidden))
        else:
            rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hidden, p, rename)
    except Exception:
        if fs.exists(p):
            return False
        raise
    finally:
        fs.delete(hidden, False)
    return True


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir; under a temporary folder only for a local master that names none."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        local = conf.get("spark.master", "").startswith("local[")
        found = "file://" + tempfile.gettempdir() + "/keyloom" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_keyloom"
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
