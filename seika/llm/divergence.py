"""Source divergence audit: how far apart the sources of a language are, by their terms.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` (ASCII letters and all other characters), A-Z lower-cased. A
language keeps the V terms that at least ``min_docs`` of its documents hold. In
a group (lang, source), or in a whole language, a kept term counted c times has
p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N being the sum of the counts; two
values differ by floor((p - q)^2 / (p + q)). All arithmetic is exact.

Cube partitioning: the groups of a language are dealt into blocks of about
``GROUPS`` and its kept terms into blocks of about ``TERMS``. A cell owns (group block,
group block, term block); a group's slice of a term block is replicated to the
cells of its group block, each cell computes the partial divergences of its
pairs of groups, and the partial sums are reduced along the term axis.

Scale: a task counts the terms of its documents before anything is shuffled, so
a hot source or term sends a row a task. A cell holds at most two group blocks of
one term block, whatever the hot source's size. Pairs are
symmetric: only cells with first block <= second are computed. Broadcasts: the
languages' totals, if there are at most ``BROADCAST_LANGS``, else a join.

Exactness holds up to 9 * 10^15 occurrences in a language (64-bit remainders) in the cells.

Defined cases: null text, lang and source are '' (a language and a source of
their own); every row is a document of its own, so repeated rows and repeated or null doc_ids count again;
groups without terms take part (N = 0); with V = 0 every pair has value 0; a
language of one source has no pairs. Columns other than text, lang and source are not read. An empty table gives an empty result.
Texts of any length are counted in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seika.session import stage

GROUPS, TERMS = 64, 4096
PIECE = 4 << 20
# Distinct (group, term) entries a task counts before it sends them on.
ENTRIES = 200_000
BROADCAST_LANGS = 10_000
SCALE = 1_000_000_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    t = text.translate(_TABLE)
    at, n = 0, len(t)
    while at < n:
        stop = n
        if n - at > PIECE:
            stop = t.rfind(b" ", at, at + PIECE)
            if stop <= at:
                stop = t.find(b" ", at + PIECE)
            stop = n if stop < 0 else stop + 1
        yield t[at:stop].split()
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for lo in range(0, len(terms), 20_000):
                some = terms[lo:lo + 20_000]
                yield pa.record_batch([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                                       pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                                      ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            raw = text.as_py()
            if not raw:
                continue
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            seen: set[bytes] = set()
            for terms in terms_of(raw):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(n) - before
            if entries > ENTRIES:
                yield from sent()
                groups.clear()
                entries = 0
    yield from sent()


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total), exactly: three decimal digits of the quotient at a time."""
    whole, rest = np.divmod(n, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell: groups of block i with groups of block j."""
    lang, tblock, i, j = (table.column(c)[0].as_py() for c in ("lang", "tblock", "i", "j"))
    sources, blocks = table.column("source").to_pylist(), table.column("gblock").to_numpy()
    total = table.column("total").to_numpy()
    n_terms = table.column("n_terms")[0].as_py()
    lists = table.column("cells").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat = lists.flatten()
    size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    tid, n = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
    used, col = np.unique(tid, return_inverse=True)
    count = np.zeros((len(sources), len(used)), np.int64)
    count[np.repeat(np.arange(len(sources)), size), col] = n
    p = share(count + 2, np.broadcast_to(total[:, None], count.shape))
    zero = share(np.full(len(total), 2, np.int64), total)
    rest = n_terms - len(used)  # kept terms that no group of the cell has
    rows_i, rows_j = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    first, second, value = [], [], []
    for x in rows_i:
        others = rows_j[rows_j > x] if i == j else rows_j
        if len(others):
            f = ((p[others] - p[x]) ** 2 // (p[others] + p[x])).sum(axis=1)
            f += rest * ((zero[others] - zero[x]) ** 2 // (zero[others] + zero[x]))
            first += [sources[x]] * len(others)
            second += [sources[k] for k in others]
            value.append(f)
    values = np.concatenate(value) if value else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "first": pa.array(first, pa.string()), "second": pa.array(second, pa.string()),
                     "value": pa.array(values, pa.int64())})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that hold it; staged."""
    counted = _own(docs).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return stage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-terms")


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _with_langs(df: DataFrame, langs: DataFrame, few: bool, columns: list[str]) -> DataFrame:
    own = langs.select("lang", *columns)
    return df.join(F.broadcast(own) if few else own, "lang")


def _share(n: str, total: str) -> F.Column:
    """``share`` as a column."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({n} + 2 AS decimal(20,0))) div cast({total} AS decimal(20,0))")


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: each other source of the language with its
    divergence, all ranks; part ``term``: the kept terms of the group that are more frequent there than in
    the language, only the first ``top_terms``. Rank 1 has the greatest value; equal values go by item."""
    counted = term_counts(docs)
    kept = stage(counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                 .where(F.col("docs") >= min_docs).drop("docs"), "divergence-kept")
    groups = _own(docs).select("lang", "source").distinct()
    totals = counted.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = stage(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "divergence-groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    langs = stage(langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("lang_total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_total"),
                               F.ceil(F.col("sources") / GROUPS).alias("gblocks"),
                               F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / TERMS)).alias("tblocks")), "divergence-langs")
    few = langs.count() <= BROADCAST_LANGS
    # Kept terms numbered within their block.
    w = Window.partitionBy("lang", "tblock")
    dealt = (_with_langs(kept, langs, few, ["tblocks"]).withColumn("tblock", F.pmod(F.xxhash64("term"), "tblocks")).drop("tblocks")
             .withColumn("tid", F.row_number().over(w.orderBy("term")) - 1))
    counts = stage(counted.select("lang", "source", "term", "n").join(dealt, ["lang", "term"]), "divergence-counts")
    return _pairs(counts, dealt, groups, langs).unionByName(_terms(counts, groups, langs, few, top_terms))


def _pairs(counts: DataFrame, dealt: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    blocks = langs.select("lang", "v", "gblocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tblocks") - 1)).alias("tblock")).join(
        dealt.groupBy("lang", "tblock").agg(F.count(F.lit(1)).alias("n_terms")), ["lang", "tblock"], "left")
    slices = counts.groupBy("lang", "source", "tblock").agg(F.collect_list(F.struct(F.col("tid").cast("long").alias("tid"), "n")).alias("cells"))
    own = (groups.join(blocks, "lang")
           .select("lang", "source", "tblock", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "gblocks",
                   # A language without kept terms has no shares; any positive total will do.
                   F.greatest(F.lit(1), F.col("n") + 2 * F.col("v")).alias("total"))
           .join(slices, ["lang", "source", "tblock"], "left")
           .withColumn("gblock", F.pmod(F.xxhash64("source"), "gblocks")))
    cells = (own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gblocks") - 1)))
             .withColumn("i", F.least("gblock", "other")).withColumn("j", F.greatest("gblock", "other"))
             .select("lang", "tblock", "i", "j", "gblock", "source", "total", "n_terms",
                     F.coalesce("cells", F.array().cast("array<struct<tid:long,n:long>>")).alias("cells")))
    partial = cells.groupBy("lang", "tblock", "i", "j").applyInArrow(_cell, "lang string, first string, second string, value long")
    # The rows of a cell come in any order, so a pair may stand either way round in the cells of different term blocks.
    whole = partial.groupBy("lang", F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).agg(
        F.sum("value").alias("value"))
    both = whole.withColumn("side", F.explode(F.array(F.struct(F.col("first").alias("source"), F.col("second").alias("item")),
                                                     F.struct(F.col("second").alias("source"), F.col("first").alias("item")))))
    return _ranked(both.select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value"))


def _terms(counts: DataFrame, groups: DataFrame, langs: DataFrame, few: bool, top: int) -> DataFrame:
    own = _with_langs(groups, langs, few, ["v", "lang_total"]).select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), "lang_total")
    rows = (counts.join(own, ["lang", "source"]).withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))
            .where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)")))
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
lang AS (SELECT l.lang, coalesce(k.v, 0) AS v, coalesce(k.n, 0) + 2 * coalesce(k.v, 0) AS total
         FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang) k ON k.lang = l.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY w.lang, w.source, w.term),
gn AS (SELECT g.lang, g.source, coalesce(s.n, 0) + 2 * lang.v AS total
       FROM g JOIN lang ON lang.lang = g.lang LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = g.lang AND s.source = g.source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // gn.total AS p,
             1 + (1000000000::HUGEINT * (k.lang_n + 2)) // lang.total AS q
      FROM gn JOIN kept k ON k.lang = gn.lang JOIN lang ON lang.lang = gn.lang
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL
      SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
