"""Shift-JIS portal bytes to UTF-8 text.

Spark decodes with the JVM charset ``windows-31j`` (the Windows code page of
Shift-JIS, which also maps NEC/IBM extensions such as ``髙①㈱``). Both
``spark.sql.legacy.javaCharsets`` and ``spark.sql.legacy.codingErrorAction``
must be on (``seika.session.REQUIRED_CONF``): the first admits the charset,
the second turns malformed bytes into U+FFFD instead of failing the task, as
the reference's decoder does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The charset name and the byte-order mark.
SJIS = "windows-31j"
BOM = "﻿"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sjis_to_utf8(content, add_bom: bool = False) -> Column:
    """Decode Shift-JIS bytes to text, optionally with a leading BOM."""
    text = F.decode(_c(content), SJIS)
    return F.concat(F.lit(BOM), text) if add_bom else text


def utf8_to_sjis(text) -> Column:
    """The inverse direction (test data, round trips)."""
    return F.encode(_c(text), SJIS)


def read_sjis_files(spark: SparkSession, path: str, add_bom: bool = False) -> DataFrame:
    """E6 on files: (path, text) for every file under ``path``; one task reads
    and decodes one file's bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", sjis_to_utf8("content", add_bom).alias("text"))
