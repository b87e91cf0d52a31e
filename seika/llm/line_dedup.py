"""Line dedup: explode normalised lines, hash them, count distinct documents
per hash, drop the lines of keys over the threshold, reassemble by position.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased, known by its 128-bit BLAKE2 hash. Keys of at least
``min_chars`` code points in at least ``min_docs`` distinct documents keep
their lines only in the largest doc_id that holds them.

Scale: a document sends each of its long keys once, as (hash, doc_id); the
distinct count first spreads a hot key over (hash, doc_id) and then adds up
partial counts, so no task sees all rows of a key. Only keys over the
threshold are joined back: by broadcast if they are few (``common.small_enough``), so that a
hot key's rows stay where they are, else by a join whose hot keys AQE splits. Each
document gets the hashes it must drop as one array, bounded by its own lines.

Defined cases: a null or empty text is one empty line; documents with a null
doc_id don't count towards the threshold and never are the largest holder;
rows that share a doc_id are one document when counting (a line repeated
between them counts once) and are each reassembled on their own; extra columns are carried unchanged, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seika.llm.common import WHITE, small_enough
from seika.session import stage

_STRIP = WHITE.encode()


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line's key, or None if the key is too short."""
    key = line.strip(_STRIP).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                found = {_key(x, min_chars) for x in text.encode().split(b"\n")} if text else set()
                found.discard(None)
                ids += [i] * len(found)
                keys += found
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])
    return run


def _reassemble(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, dropped, kept = [], [], []
            for text, drop in zip(b.column("text"), b.column("drop"), strict=True):
                parts = (text.as_py() or "").encode().split(b"\n")
                gone = set(drop.as_py() or ())
                stay = [x for x in parts if _key(x, min_chars) not in gone] if gone else parts
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.record_batch([b.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                                   pa.array(kept, pa.string())], ["row", "n_lines", "n_dropped", "kept_text"])
    return run


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: list[str] | None = None) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): ``row`` is a struct of the
    document's columns (``carry``; all without the text if not given)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = stage(ids.mapInArrow(_long_keys(min_chars), "doc_id long, key binary"), "line-keys")
    shared = stage(pairs.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
                   .where(F.col("n") >= min_docs).select("key", "keeper"), "line-shared")
    if small_enough(shared):
        shared = F.broadcast(shared)
    drops = (pairs.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
             .select(F.col("doc_id").alias("drop_id"), "drop"))
    names = [c for c in docs.columns if c != "text"] if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text",
                       F.col("doc_id").cast("long").alias("id"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")), "left").select("row", "text", "drop")
    schema = T.StructType([joined.schema["row"], T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_reassemble(min_chars), schema)


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with their lines dropped; same columns, ``n_chars`` brought up to date if there is one."""
    out = line_dedup(docs, **options)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (hot.key IS NOT NULL AND l.doc_id IS DISTINCT FROM hot.keeper) AS gone
      FROM l LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
