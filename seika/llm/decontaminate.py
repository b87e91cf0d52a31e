"""Benchmark decontamination by an FM-index per training shard.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Every
13 consecutive words of a benchmark item are a window; an item of fewer words is one window.
A task indexes its documents shard by shard, searches all windows backward at
once through wavelet ranks, locates occurrences by sampled suffix positions and
merges the words they cover into removal spans.

A word outside the windows' vocabulary can't be part of an occurrence, so only runs of vocabulary words as long
as the shortest window are indexed. Windows of full length and shorter ones have an
index each, so that one short item doesn't bring all its benchmark's words into the index.

Scale: the documents are read once and not shuffled. The benchmark is dealt into blocks of about
``block_bytes`` of text (all its windows, no sample), or one item; tasks build each block's windows and write them
to the shared folder, and the tasks that search read block after block from there for each shard, the
last few staying in memory (``HELD_BYTES``). Only the block numbers pass through the driver. A shard has at most ``shard_words`` words, or one document.

Defined cases: null or empty text has no words and is not contaminated; benchmark rows with null
or wordless text have no windows; rows that share an item_id are one item; windows of a null item_id mark words but are
not listed; repeated documents are judged row by row, in the task that reads them; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seika.llm.fm_index import FMIndex
from seika.session import checkpoint_dir
from seika.sources.fs import open_in_task

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 2 << 20
HELD_BYTES = 64 << 20
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD_TEXT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Windows:
    """The windows of one length class of a benchmark block."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]]):
        self.vocabulary: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), int(self.lengths.max(initial=0))), np.int32)
        for i, w in enumerate(windows):
            self.patterns[i, self.patterns.shape[1] - len(w):] = [self.vocabulary[x] for x in w]
        self.items = list(windows.values())
        self.least = int(self.lengths.min(initial=0))


def window_classes(items: list[tuple[int | None, bytes]], size: int) -> list[Windows]:
    full: dict[tuple[bytes, ...], set[int]] = {}
    short: dict[tuple[bytes, ...], set[int]] = {}
    for item_id, text in items:
        w = words_of(text)
        if not w:
            continue
        to = full if len(w) >= size else short
        for i in range(max(1, len(w) - size + 1)):
            own = to.setdefault(tuple(w[i:i + size]), set())
            if item_id is not None:
                own.add(item_id)
    return [Windows(x) for x in (full, short) if x]


def find_in_shard(texts: list[list[bytes]], classes: list[Windows]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Per text: merged spans of hit words [start, end), and the item ids found."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    cover = np.zeros(int(first[-1]) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts]
    for c in classes:
        ids = np.fromiter((i for t in texts for i in map(c.vocabulary.get, t, repeat(0))), np.int32, int(first[-1]))
        inside = ids > 0
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = ends - starts >= c.least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            continue
        size = ends - starts
        seg_at = np.concatenate(([0], np.cumsum(size + 1)))  # places of the segments in the indexed text
        text = np.zeros(int(seg_at[-1]), np.int32)
        take = np.repeat(starts - seg_at[:-1], size + 1) + np.arange(len(text))
        real = np.ones(len(text), bool)
        real[seg_at[1:] - 1] = False
        text[real] = ids[take[real]]
        index = FMIndex(text, len(c.vocabulary) + 1)
        lo, hi = index.search(c.patterns, c.lengths)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        n = (hi - lo)[found]
        which = np.repeat(found, n)
        rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        word = take[index.locate(rows)]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + c.lengths[which], -1)
        doc = np.searchsorted(first, word, side="right") - 1
        pairs = np.unique(doc * len(c.items) + which)
        for p in pairs.tolist():
            items[p // len(c.items)] |= c.items[p % len(c.items)]
    hit = np.cumsum(cover[:-1]) > 0
    begin, end = hit.copy(), hit.copy()
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    begin[1:] &= ~hit[:-1] | edge[1:-1]
    end[:-1] &= ~hit[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, s, e in zip(np.searchsorted(first, starts, side="right") - 1, starts, ends, strict=True):
        spans[d].append((int(s - first[d]), int(e - first[d])))
    return spans, [sorted(x) for x in items]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [T.StructField("n_words", T.LongType()),
          T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
          T.StructField("items", T.ArrayType(T.LongType()))]


def _build(window: int):
    def run(table: pa.Table) -> pa.Table:
        classes = window_classes(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), window)
        rows = [pickle.dumps(classes)] if classes else []
        return pa.table({"block": pa.array(table.column("block").to_pylist()[:len(rows)], pa.int32()), "windows": pa.array(rows, pa.large_binary()).cast(pa.binary())})
    return run


def stage_windows(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Folders below the shared one with a block's windows each."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    folder = f"{checkpoint_dir(benchmark.sparkSession).rstrip('/')}/seika-stage/windows-{uuid.uuid4().hex[:12]}"
    dealt = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    dealt.groupBy("block").applyInArrow(_build(window), "block int, windows binary").write.partitionBy("block").parquet(folder)
    there = benchmark.sparkSession.read.schema("windows binary, block int").parquet(folder).select("block").distinct().collect()
    return [f"{folder}/block={b}" for b in sorted(r["block"] for r in there)]


_HELD: OrderedDict[str, tuple[int, list[Windows]]] = OrderedDict()


def _windows_in(folder: str) -> list[Windows]:
    """A block's windows; blocks used last stay in the worker up to HELD_BYTES."""
    if folder not in _HELD:
        fs, path = open_in_task(folder)
        raw = [x for x in pq.read_table(path, filesystem=fs, columns=["windows"], partitioning=None).column("windows").to_pylist()]
        size = sum(map(len, raw))
        while _HELD and size + sum(n for n, _ in _HELD.values()) > HELD_BYTES:
            _HELD.popitem(last=False)
        _HELD[folder] = (size, [c for x in raw for c in pickle.loads(x)])
    _HELD.move_to_end(folder)
    return _HELD[folder][1]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def find_in_blocks(texts: list[list[bytes]], folders: list[str]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """``find_in_shard`` over all blocks."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for folder in folders:
        for i, (own, found) in enumerate(zip(*find_in_shard(texts, _windows_in(folder)), strict=True)):
            spans[i] += own
            items[i].update(found)
    return [merge_spans(x) for x in spans], [sorted(x) for x in items]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [T.StructField("n_words", T.LongType()),
          T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
          T.StructField("items", T.ArrayType(T.LongType()))]


def _search(folders: list[str], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lo, total = [], 0, 0
            column = b.column(1)
            for i in range(b.num_rows):
                texts.append(words_of(column[i].as_py() or b""))
                total += len(texts[-1])
                if total >= shard_words or i + 1 == b.num_rows:
                    spans, items = find_in_blocks(texts, folders)
                    yield pa.record_batch([
                        b.column(0).slice(lo, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS),
                        pa.array(items, pa.list_(pa.int64()))], ["row", "n_words", "spans", "items"])
                    texts, lo, total = [], i + 1, 0
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW,
                       shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_hit, spans, items, contaminated); ``row``: struct of the
    ``carry`` columns (all if not given), spans in words, items sorted as numbers."""
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_search(stage_windows(benchmark, window, block_bytes), shard_words), T.StructType([rows.schema["row"], *_FOUND]))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    return find_contamination(docs, benchmark, **options).where(~F.col("contaminated")).select("row.*")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD_TEXT.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last:at[s][0]])
        last = at[e - 1][1]
    return "".join(out) + text[last:]


def excise_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document, its removal spans cut out of the text; same columns."""
    found = find_contamination(docs, benchmark, **options).select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field("text").to_pylist()
            new = [cut_spans(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in zip(texts, b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(new, pa.string())], ["row", "new_text"])

    out = found.mapInArrow(run, T.StructType([found.schema["row"], T.StructField("new_text", T.StringType())]))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
