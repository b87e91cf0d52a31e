"""Host-level quality rules, in DataFrame functions only.

Each document is measured by base rules on its whole text. Failures are summed
by host (the ``source`` column), each host's failure rate is shrunk with a beta
prior fitted to all hosts' rates by the method of moments, and hosts whose
shrunken rate passes ``max_host_rate`` reject all their documents.

Scale: the measures are computed once, inside the row (array functions, no
shuffle of words), and written to the shared folder; the host sums are partial
aggregates, so a hot host costs one row per task; only rejected hosts are joined
back to the documents: by broadcast if they are few (``common.small_enough``), so that no document travels to its host's
task, else by a join whose hot hosts Spark splits. The trigram comparison uses 64-bit hashes within one
document.

Defined cases: null or empty text has no words and fails; a null source is no
host, such documents are judged by their own rules only; one host alone gives
no variance, its prior then has the least weight; repeated rows are judged row
by row; extra columns, whatever their names, are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seika.llm.common import WHITE, small_enough
from seika.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
# Bounds of the prior's weight, in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0


def _repeat_words(tri: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. ``tri``: (hash,
    position) of each window, sorted, so equal windows are neighbours."""
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    return F.array_compact(F.transform(tri, lambda x, i: F.when(
        same(F.get(tri, i - 1), x) | same(F.get(tri, i + 1), x), x["p"])))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the base columns to (row, source, text); drops nothing but the helper arrays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    d = docs.withColumns({
        "words": F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")),
        "lines": lines,
        "word_chars": F.char_length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "tri": F.when(F.size("words") >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"),
                               i.alias("p"))))),
    }).drop("words", "lines")
    d = d.withColumn("at", F.sort_array(F.coalesce(_repeat_words(F.col("tri")), F.array().cast("array<int>")))).drop("tri")
    at = F.col("at")
    d = d.withColumn("n_repeat_words", F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda s, x: s + x)).drop("at")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, rejected), one row per host."""
    hosts = (measured.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("host"))
             .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    fit = hosts.agg(F.avg("rate").alias("m"), F.coalesce(F.var_samp("rate"), F.lit(0.0)).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(PRIOR_LEAST), F.least(
        F.lit(PRIOR_MOST), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(PRIOR_LEAST))
    prior = fit.select(F.struct((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b"))).scalar()
    hosts = hosts.withColumn("prior", prior)
    return hosts.select(
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("prior.a")) / (F.col("n_docs") + F.col("prior.a") + F.col("prior.b"))).alias("shrunk_rate"),
    ).withColumn("rejected", F.col("shrunk_rate") > max_host_rate)


def quality_rules(docs: DataFrame, carry: list[str] | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rejected, kept); ``row``: struct of the ``carry`` columns (all if not given)."""
    names = docs.columns if carry is None else carry
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), source.alias("source"), "text")
    measured = stage(measure(inner).drop("text"), "quality")
    bad = stage(host_rates(measured, max_host_rate).where("rejected").select(F.col("host").alias("bad_host")), "quality-hosts")
    if small_enough(bad, "bad_host"):
        bad = F.broadcast(bad)
    judged = measured.join(bad, F.col("source") == F.col("bad_host"), "left")
    return (judged.withColumn("host_rejected", F.col("bad_host").isNotNull())
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("source", "bad_host"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass; same columns."""
    return quality_rules(docs, **options).where("kept").select("row.*")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
m AS (
  SELECT doc_id, source, words, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
tri AS (
  SELECT doc_id, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS g, i
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM m)),
rep AS (
  SELECT doc_id, i FROM tri JOIN (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
b AS (
  SELECT m.doc_id, source, n_words, word_chars, n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AS base_failed
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
fit AS (SELECT avg(f / n) AS mu, coalesce(var_samp(f / n), 0) AS v FROM h),
prior AS (SELECT mu, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, mu * (1 - mu) / v - 1)) ELSE 1.0 END AS k FROM fit),
bad AS (SELECT source FROM h, prior WHERE (f + mu * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad))) AS kept
FROM b
"""
