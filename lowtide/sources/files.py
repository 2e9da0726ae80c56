"""File listings and byte access shared by the readers."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _names_in(pattern: str) -> tuple[str, str] | None:
    """(folder, regular expression) of a pattern that has its wildcards, ``*`` and ``?``, in the last name alone."""
    folder, _, name = pattern.rpartition("/")
    whole = re.fullmatch(r"(?:[A-Za-z][\w+.-]*:(?://[^/]*)?)?(/.*)", folder)
    if not whole or not re.search(r"[*?]", name) or re.search(r"[\[\]{}\\]", name) or re.search(r"[*?\[\]{}\\]|/\.{1,2}(/|$)", folder):
        return None
    path = re.escape(re.sub(r"/+", "/", whole[1]).rstrip("/"))
    last = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in name)
    return folder, f"^([A-Za-z][\\w+.-]*:(//[^/]*)?)?{path}/{last}(/.*)?$"


def find_files(spark: SparkSession, search: str) -> DataFrame:
    """(path, length, modificationTime) of the files that match ``;``-separated
    globs; a folder stands for everything under it. Contents are not read.

    Where only the last name has wildcards, its folder is listed once and the names are matched afterwards: Spark lists
    every match of a glob as a root of its own, which takes a look-up for each file. Such a pattern may match nothing.
    """
    parts = [p.strip() for p in search.split(";") if p.strip()]

    def listed(part: str) -> DataFrame:
        plain = _names_in(part)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(plain[0] if plain else part)
        files = files.select("path", "length", "modificationTime")
        return files.where(F.col("path").rlike(plain[1])) if plain else files

    return reduce(DataFrame.unionByName, [listed(p) for p in parts]).dropDuplicates(["path"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): small text files, one row each."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    plain = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return text.select(plain.alias("path"), F.col("value").alias("content"))


def stem(path):
    """File name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def store(path: str):
    """The Arrow filesystem of a path as Spark names it, and the path in it."""
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^hdfs:/(?!/)", "hdfs:///", path))  # as Spark names them
    if path.startswith("file:") or "://" not in path:
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(quote(path, safe=":/?&=@%"))


def open_range(path: str, offset: int, size: int) -> bytes:
    """Bytes of a file on any filesystem Arrow knows."""
    files, inner = store(path)
    with files.open_input_file(inner) as f:
        f.seek(offset)
        return f.read(size)


def reader(path: str):
    """A function (offset, size) to bytes over one open file; close it by ``reader(path).close``."""
    files, inner = store(path)
    source = files.open_input_file(inner)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    read.close = source.close
    return read


def put_file(path: str, content: bytes) -> None:
    files, inner = store(path)
    files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(inner) as f:
        f.write(content)
