"""Suffix-array dedup of byte strings, over sampled suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is
removed. Which suffixes are sorted follows from the content alone: of each
``SPREAD`` neighbouring starts the one whose ``GRAM`` bytes hash lowest is an
anchor (the leftmost of equals). The window of 400 bytes at s owns the anchor among
[s, s + SPREAD), so equal windows own anchors at equal offsets, and the
KEY = LENGTH - SPREAD + 1 bytes from there lie inside both.

1. Each anchor's suffix is named by its leading tokens: 128 bits of the KEY bytes
   from the anchor on, then 64 bits of its whole context (SPREAD - 1 bytes before,
   LENGTH after). Only equality matters here, so suffixes are ordered by these fingerprints and not by their bytes.
2. Splitters sampled from the suffixes cut that order into buckets; a bucket
   sorts locally by multikey quicksort (by the next token only among equals of the
   last), and neighbours are compared, across bucket boundaries too. As the order ends with
   document and position, a suffix that stands in a third of all documents is
   spread over many buckets.
3. A suffix whose whole context has an equal neighbour covers its context. A suffix that shares its KEY
   bytes with a neighbour but not its context (a match begins or ends here) sends
   the hashes of its own windows; windows of equal hash, found within a batch and then
   among the batches, cover their bytes.
4. The spans are joined to the documents and merged.

Scale: about 2 / (SPREAD + 1) suffixes a byte are shuffled, 40 bytes each. Texts without a mark never
travel as long as at most ``BROADCAST_KEYS`` rows are marked (their 128-bit keys are broadcast then; beyond
that all texts are joined); the same rule holds for the windows found twice and for the texts they stand in. A
passage common to all documents is counted by partial sums. The boundary rows are two a bucket.
A bucket is held by one task: there are as many as keep it at about ``BUCKET_ROWS`` rows, by the
measured size of the texts; splitters are sampled in proportion.

Defined cases: null text is empty; texts under ``LENGTH`` bytes stay whole; a row is known by 128 bits of doc_id and
text, so rows that share a doc_id are kept apart and equal rows are copies
of each other; null doc_ids take part. A very long text is cut into overlapping pieces. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seika.llm.common import RollingHash, mix64, row_keys, row_slices, texts_of
from seika.session import stage

LENGTH, SPREAD, GRAM = 400, 128, 16
KEY = LENGTH - SPREAD + 1
PIECE = 1 << 20
# Rows of the splitter sample for each bucket.
SAMPLE_A_BUCKET = 40
# Suffixes of a bucket, at about 100 bytes each in the task that sorts it.
BUCKET_ROWS = 2_000_000
# Keys of 16 bytes that may be broadcast: about 40 MB in an executor.
BROADCAST_KEYS = 500_000

_A, _B = RollingHash(21), RollingHash(22)
_POS_BITS = np.uint64(23)  # positions in a piece: PIECE + 2 * LENGTH < 2 ** 23


class Piece:
    """Bytes with the starts whose windows are complete, and their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.a, self.b = _A.prefix(data), _B.prefix(data)
        self.starts = np.zeros(0, np.int64)
        if n < LENGTH:
            return
        at = np.arange(n - GRAM + 1)
        low = mix64(_A.of(self.a, at, at + GRAM))
        low = (low & ~((np.uint64(1) << _POS_BITS) - np.uint64(1))) | at.astype(np.uint64)
        # Sliding minimum over SPREAD values: the least of a block's end and the next block's beginning.
        pad = -len(low) % SPREAD
        blocks = np.concatenate((low, np.full(pad + SPREAD, np.uint64(2**64 - 1)))).reshape(-1, SPREAD)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - LENGTH + 1)
        least = np.minimum(behind[:len(starts)], ahead[SPREAD - 1:SPREAD - 1 + len(starts)])
        self.doc = np.searchsorted(offsets, starts, side="right") - 1
        whole = starts + LENGTH <= offsets[self.doc + 1]
        self.starts, self.doc = starts[whole], self.doc[whole]
        self.anchor = (least[whole] & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = (hi - lo).astype(np.uint64)
        return mix64(_A.of(self.a, lo, hi) + n), mix64(_B.of(self.b, lo, hi) ^ (n << np.uint64(32)))


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, last row + 1, byte from, byte to, first own start): rows together up to PIECE bytes,
    or parts of one long row. A part's bytes begin LENGTH before its own starts and end 2 * LENGTH after them."""
    for lo, hi in row_slices(offsets, PIECE):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= PIECE:
            yield lo, hi, begin, end, begin
            continue
        for own in range(begin, end, PIECE - 3 * LENGTH):
            yield lo, hi, max(begin, own - LENGTH), min(end, own + PIECE - LENGTH), own


def _cut(data: np.ndarray, offsets: np.ndarray, cut: tuple[int, int, int, int, int]) -> tuple[Piece, np.ndarray, int, int]:
    """The piece; where its documents begin, in the piece; its own starts [from, to)."""
    lo, hi, begin, end, own = cut
    inside = np.clip(offsets[lo:hi + 1], begin, end) - begin
    last = int(offsets[hi]) if begin == offsets[lo] and end == offsets[hi] else own + PIECE - 3 * LENGTH
    return Piece(data[begin:end], inside), offsets[lo:hi] - begin, own - begin, last - begin


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position in its text, key hash 1, key hash 2, context hash, bytes
    before, bytes after) of all anchors, each once."""
    for cut in pieces(data, offsets):
        p, base, own_from, own_to = _cut(data, offsets, cut)
        if not len(p.starts):
            continue
        new = np.ones(len(p.starts), bool)
        new[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.doc[1:] != p.doc[:-1])
        new &= (p.starts >= own_from) & (p.starts < own_to)
        at, doc = p.anchor[new], p.doc[new]
        k0, k1 = p.hashes(at, at + KEY)
        left = np.maximum(p.offsets[doc], at - (SPREAD - 1))
        right = np.minimum(p.offsets[doc + 1], at + LENGTH)
        c0, c1 = p.hashes(left, right)
        context = mix64(c0 ^ mix64(c1 + (at - left).astype(np.uint64)))
        yield doc + cut[0], at - base[doc], k0, k1, context, at - left, right - at



_ORDER = ("k0", "k1", "context", "tail")


def _anchor_rows(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    """(rows of the batch, columns) of the anchors of a batch (t0, t1, text)."""
    data, offsets = texts_of(b.column(2))
    name = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    for row, pos, k0, k1, context, before, after in anchors_of(data, offsets):
        tail = mix64(mix64(name[row]) + pos.astype(np.uint64))
        yield pa.array(row), {"pos": pos, "k0": k0.view(np.int64), "k1": k1.view(np.int64), "context": context.view(np.int64),
                              "tail": tail.view(np.int64), "before": before.astype(np.int32), "after": after.astype(np.int32)}


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, c in _anchor_rows(b):
            yield pa.record_batch([pa.array(c[x]) for x in _ORDER], list(_ORDER))


def buckets_of(cols: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or below each row, compared by all columns."""
    out = np.searchsorted(splitters[0], cols[0], side="left")
    tied = np.flatnonzero(np.searchsorted(splitters[0], cols[0], side="right") > out)
    if len(tied):
        n = len(splitters[0])
        both = [np.concatenate((s, c[tied])) for s, c in zip(splitters, cols, strict=True)]
        order = np.lexsort(both[::-1])  # stable: a splitter stands before equal rows
        below = np.cumsum(order < n)
        out[tied[order[order >= n] - n]] = below[order >= n]
    return out.astype(np.int32)


_ANCHOR = "t0 long, t1 long, pos long, k0 long, k1 long, context long, before int, after int, bucket int"
_ANCHOR_NAMES = [x.split()[0] for x in _ANCHOR.split(", ")]


def _emit(splitters: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, c in _anchor_rows(b):
                c["bucket"] = buckets_of([c[x] for x in _ORDER], splitters)
                yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), *(pa.array(c[x]) for x in _ANCHOR_NAMES[2:])], _ANCHOR_NAMES)
    return run


def anchors_in(own: DataFrame) -> float:
    """About how many anchors the texts have."""
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1.0, 2.0 * size / (SPREAD + 1))


def splitters_of(own: DataFrame, buckets: int, there: float) -> list[np.ndarray]:
    """Keys that cut the order into about equal buckets, from the anchors of
    sampled documents: about SAMPLE_A_BUCKET rows a bucket reach the driver."""
    want = SAMPLE_A_BUCKET * buckets
    some = own.sample(fraction=min(1.0, 4 * want / there), seed=7)
    rows = some.mapInArrow(_sampled, ", ".join(f"{c} long" for c in _ORDER)).sample(fraction=min(1.0, max(0.25, want / there)), seed=8)
    got = rows.toPandas()
    cols = [got[c].to_numpy(np.int64) for c in _ORDER]
    order = np.lexsort(cols[::-1])
    at = order[np.unique(np.linspace(0, len(order), buckets + 1)[1:-1].astype(np.int64))] if len(order) else order
    return [c[at] for c in cols]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several columns: quicksort by the first, then by each next one among ties only."""
    order = np.argsort(columns[0], kind="quicksort")
    if not len(order):
        return order
    rows = np.arange(len(order))
    group = np.cumsum(np.concatenate(([0], np.diff(columns[0][order]) != 0)))
    for column in columns[1:]:
        tied = np.bincount(group)[group] > 1
        rows, group = rows[tied], group[tied]
        if not len(rows):
            break
        inner = np.lexsort((column[order[rows]], group))
        order[rows] = order[rows][inner]
        value = column[order[rows]]
        group = np.cumsum(np.concatenate(([0], (np.diff(group) != 0) | (np.diff(value) != 0))))
    return order


_MARK = ("t0 long, t1 long, pos long, before int, after int, covered boolean, asks boolean, bucket int, edge int, "
         "k0 long, k1 long, context long")
_MARK_NAMES = [x.split()[0] for x in _MARK.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a partition's buckets and compares neighbours. Returns the rows
    that have an equal, and each bucket's first (``edge`` 1) and last row (2; 3 if it is both)."""
    read = list(batches)
    if not sum(b.num_rows for b in read):
        return
    table = pa.Table.from_batches(read)
    bucket, k0, k1, context = (table.column(x).to_numpy() for x in ("bucket", "k0", "k1", "context"))
    order = multikey_order([bucket, k0, k1, context])
    bucket, k0, k1, context = (x[order] for x in (bucket, k0, k1, context))
    same_bucket = np.diff(bucket) == 0
    same_key = same_bucket & (np.diff(k0) == 0) & (np.diff(k1) == 0)
    same_context = same_key & (np.diff(context) == 0)
    sides = lambda x: (np.concatenate(([False], x)), np.concatenate((x, [False])))
    (key_before, key_after), (con_before, con_after) = sides(same_key), sides(same_context)
    covered = con_before | con_after
    # A context's first row asks if the row before it has the same key, its last row if the row after has.
    asks = (key_before & ~con_before) | (key_after & ~con_after)
    edge = (np.concatenate(([True], ~same_bucket)) + 2 * np.concatenate((~same_bucket, [True]))).astype(np.int32)
    keep = np.flatnonzero(covered | asks | (edge > 0))
    for lo in range(0, len(keep), 20_000):
        k = keep[lo:lo + 20_000]
        rows = table.take(pa.array(order[k]))
        get = lambda name: rows.column(name).combine_chunks()
        inner = pa.array(edge[k] == 0)
        named = lambda name: pa.compute.if_else(inner, pa.scalar(None, pa.int64()), get(name))
        yield pa.record_batch([get("t0"), get("t1"), get("pos"), get("before"), get("after"), pa.array(covered[k]), pa.array(asks[k]),
                               get("bucket"), pa.array(edge[k]), named("k0"), named("k1"), named("context")], _MARK_NAMES)


def suffix_marks(own: DataFrame, buckets: int) -> DataFrame:
    """(t0, t1, pos, before, after, covered, asks) of the anchors that have
    an equal; ``own``: t0, t1, text. ``buckets`` is the least number of buckets."""
    long = own.where(F.octet_length("text") >= LENGTH).select("t0", "t1", "text")
    there = anchors_in(long)
    buckets = max(buckets, -int(-there // BUCKET_ROWS))
    anchors = long.mapInArrow(_emit(splitters_of(long, buckets, there)), _ANCHOR)
    compared = stage(anchors.repartitionById(buckets, "bucket").mapInArrow(_compare, _MARK), "suffix-marks")
    # Two rows a bucket, however many suffixes there are: neighbours across the boundaries.
    w = Window.orderBy("bucket", F.col("edge") == 2)
    ends = compared.where("edge > 0")
    for side, bit, there in ((F.lag, 1, "before"), (F.lead, 2, "after")):
        has = F.col("edge").bitwiseAND(bit) > 0
        key = F.coalesce(has & (side("k0").over(w) == F.col("k0")) & (side("k1").over(w) == F.col("k1")), F.lit(False))
        ends = ends.withColumn(f"key_{there}", key).withColumn(f"con_{there}", key & (side("context").over(w) == F.col("context")))
    ends = ends.withColumn("covered", F.col("covered") | F.col("con_before") | F.col("con_after")).withColumn(
        "asks", F.col("asks") | (F.col("key_before") & ~F.col("con_before")) | (F.col("key_after") & ~F.col("con_after")))
    names = ["t0", "t1", "pos", "before", "after", "covered", "asks"]
    return compared.where("edge = 0").select(*names).unionByName(ends.select(*names)).where("covered OR asks")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    keep, last = [], 0
    for lo, hi in spans:
        keep.append(text[last:lo])
        last = hi
    return b"".join([*keep, text[last:]])


def windows_of(texts: pa.Array, asked: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: (start, hash 1, hash 2) of the windows that own an asked anchor."""
    data, offsets = texts_of(texts)
    wanted = np.sort(np.concatenate([(np.int64(i) << 40) + a for i, a in enumerate(asked)])) if asked else np.zeros(0, np.int64)
    out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in asked]
    for c in pieces(data, offsets):
        p, base, own_from, own_to = _cut(data, offsets, c)
        if not len(p.starts):
            continue
        name = ((p.doc + c[0]).astype(np.int64) << 40) + (p.anchor - base[p.doc])
        at = np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)
        mine = (wanted[at] == name) & (p.starts >= own_from) & (p.starts < own_to) if len(wanted) else np.zeros(len(name), bool)
        starts, doc = p.starts[mine], p.doc[mine]
        h0, h1 = p.hashes(starts, starts + LENGTH)
        for d in np.unique(doc):
            k = doc == d if len(base) == 1 else slice(*np.searchsorted(doc, [d, d + 1]))
            new = (starts[k] - base[d], h0[k].view(np.int64), h1[k].view(np.int64))
            out[d + c[0]] = [np.concatenate((x, y)) for x, y in zip(out[d + c[0]], new, strict=True)]
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, "
           "kept_sha256 string, kept binary")
_RESULT_NAMES = [x.split()[0] for x in _RESULT.replace("start:long,end:long", "").split(", ")]
_PASS = _RESULT + ", t0 long, t1 long, open binary, starts array<long>, h0 array<long>, h1 array<long>, known array<boolean>"


def _result(ids: pa.Array, texts: list[bytes], spans: list[list[tuple[int, int]]], keep_text: bool) -> list[pa.Array]:
    kept = [cut(t, s) for t, s in zip(texts, spans, strict=True)]
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
            pa.array([len(s) for s in spans], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept if keep_text else [None] * len(kept), pa.binary())]


def _first_pass(keep_text: bool):
    """Documents none of whose windows wait for an answer are done; the others keep
    their text (``open``). All bring the hashes of the windows asked for; ``known`` ones have an equal in their batch."""
    names = [x.split()[0] for x in _PASS.replace("start:long,end:long", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            spans, asked = [], []
            for marks in b.column("marks"):
                pos, before, after, covered, asks = (marks.values.field(i).to_numpy(zero_copy_only=False) if marks.is_valid else np.zeros(0, np.int64) for i in range(5))
                c = covered.astype(bool)
                spans.append(merge(list(zip((pos[c] - before[c]).tolist(), (pos[c] + after[c]).tolist(), strict=True))))
                asked.append(np.unique(pos[asks.astype(bool)]).astype(np.int64))
            todo = [i for i, a in enumerate(asked) if len(a)]
            found = windows_of(texts.take(pa.array(todo, pa.int64())), [asked[i] for i in todo]) if todo else []
            # Windows that stand twice in this batch need no answer; one of each is sent on for the other batches.
            at = np.concatenate([np.full(len(f[0]), i) for i, f in zip(todo, found, strict=True)] or [np.zeros(0, np.int64)])
            start, h0, h1 = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
            order = np.lexsort((h1, h0))
            same = (np.diff(h0[order]) == 0) & (np.diff(h1[order]) == 0)
            after_equal, twice = np.zeros(len(at), bool), np.zeros(len(at), bool)
            after_equal[order[1:]] = same
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            for i, x in zip(at[twice].tolist(), start[twice].tolist(), strict=True):
                spans[i].append((x, x + LENGTH))
            spans = [merge(x) for x in spans]
            send, waits = ~after_equal, set(at[~twice].tolist())
            cut_at = np.searchsorted(at[send], np.arange(b.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pa.array(x[send])) for x in (start, h0, h1, twice)]
            raw = [(t.as_py() or "").encode() for t in texts]
            columns = _result(b.column("doc_id"), raw, spans, keep_text)
            yield pa.record_batch([*columns, b.column("t0"), b.column("t1"), pa.array([t if i in waits else None for i, t in enumerate(raw)], pa.binary()), *lists], names)
    return run


def _second_pass(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("open").to_pylist()
            spans = [merge([(s["start"], s["end"]) for s in old] + [(x, x + LENGTH) for x in new or ()])
                     for old, new in zip(b.column("spans").to_pylist(), b.column("hits").to_pylist(), strict=True)]
            yield pa.record_batch(_result(b.column("doc_id"), texts, spans, keep_text), _RESULT_NAMES)
    return run


def _unmarked(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column("text")]
            yield pa.record_batch(_result(b.column("doc_id"), texts, [[] for _ in texts], keep_text), _RESULT_NAMES)
    return run


def _meet(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """(rows whose key ``found`` hasn't, the others with its ``columns``). Rows travel only if their key is found, or
    if there are too many keys to broadcast: then all rows come with null columns for those without."""
    found = found.select(*[F.col(k).alias(f"found_{k}") for k in keys], *columns)
    on: Column = F.col(keys[0]) == F.col(f"found_{keys[0]}")
    for k in keys[1:]:
        on &= F.col(k) == F.col(f"found_{k}")
    drop = [f"found_{k}" for k in keys]
    if found.count() > BROADCAST_KEYS:
        return None, rows.join(found, on, "left").drop(*drop)
    few = F.broadcast(found.select(*drop))
    return rows.join(few, on, "left_anti"), rows.join(few, on, "left_semi").join(found, on).drop(*drop)


def suffix_dedup(docs: DataFrame, keep_text: bool = True, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept): spans in
    bytes; ``kept`` are the remaining bytes (null without ``keep_text``)."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(doc_id.alias("doc_id"), *row_keys(doc_id, text), text.alias("text"))
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = stage(suffix_marks(own, buckets).groupBy("t0", "t1")
                  .agg(F.collect_list(F.struct("pos", "before", "after", "covered", "asks")).alias("marks")), "suffix-marked")
    plain, marked = _meet(own, marks, ["t0", "t1"], ["marks"])
    done = stage(marked.select("doc_id", "t0", "t1", "text", "marks").mapInArrow(_first_pass(keep_text), _PASS), "suffix-pass")
    windows = done.select("t0", "t1", F.explode(F.arrays_zip("starts", "h0", "h1", "known")).alias("w")).select(
        "t0", "t1", F.col("w.starts").alias("start"), F.col("w.h0").alias("h0"), F.col("w.h1").alias("h1"), F.col("w.known").alias("known"))
    # Equal windows meet as counts, each batch sending one of its equals.
    twice = stage(windows.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "suffix-twice")
    _, equal = _meet(windows.where("NOT known"), twice.withColumn("twice", F.lit(True)), ["h0", "h1"], ["twice"])
    hits = stage(equal.where("twice").groupBy("t0", "t1").agg(F.collect_set("start").alias("hits")), "suffix-hits")
    rest, late = _meet(done.where("open IS NOT NULL"), hits, ["t0", "t1"], ["hits"])
    late = late.select("doc_id", "open", "spans", "hits").mapInArrow(_second_pass(keep_text), _RESULT)
    out = late.unionByName(done.where("open IS NULL").select(*late.columns))
    for part in (rest, plain.select("doc_id", "text").mapInArrow(_unmarked(keep_text), _RESULT) if plain is not None else None):
        out = out if part is None else out.unionByName(part.select(*late.columns))
    return out
