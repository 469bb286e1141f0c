"""Files as objects, and objects as files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_as_objects(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """``path, content`` of all files below a folder, paths relative to it; the input of ``put_objects``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(base).toString().rstrip("/") + "/"
    # file paths come as URIs, with one or three slashes after the scheme
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    rest = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 1, F.lit(2**31 - 1))
    found = reader.load(folder)
    # the reader knows empty files but gives no rows for them
    names = spark.createDataFrame([(unquote(n),) for n in found.inputFiles()], "path string").select(rest.alias("path"))
    read = found.select(rest.alias("path"), "content")
    return names.join(read, "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))


def objects_as_files(objects: DataFrame, folder: str) -> DataFrame:
    """Write ``path, content`` below a local or mounted folder that all executors share; returns ``path, size``.

    Paths that would leave the folder are an error. The work is done when the result is used.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        root = os.path.realpath(folder)
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                target = os.path.realpath(os.path.join(root, path))
                if not target.startswith(root + os.sep):
                    raise ValueError(f"{path!r} is outside the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.part-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pd.DataFrame({"path": rows["path"], "size": rows["content"].map(len)})

    return objects.select("path", "content").mapInPandas(of, "path string, size bigint")
