"""The ``opN_`` queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.llm import (
    chat_tools,
    decontaminate,
    divergence,
    jaccard_join,
    license_scan,
    line_dedup,
    packing,
    pii,
    quality_rules,
    suffix_dedup,
    token_align,
    url_filter,
    warc,
)
from seika.llm.common import documents, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
    url_filter.Rule("block", "example.org", "/en/1"),
]

TOOL_SCHEMAS = {
    "search": {"required": ["query"], "properties": {"query": "string", "limit": "integer"}},
    "lookup": {"required": ["query", "key"], "properties": {"query": "string", "key": "string"}},
    "calculate": {"required": ["limit"], "properties": {"limit": "string"}},
}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def _no_items(items) -> "F.Column":
    return F.coalesce(items, F.array().cast("array<long>"))


@query("op1_line_dedup", line_dedup.ORACLE)
def op1(spark, sf_dir):
    """Line dedup of all documents."""
    out = line_dedup.line_dedup(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    """Suffix-array dedup of all documents' bytes."""
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    left = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut inside a character leaves a replacement character here, not in the hash
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", left.alias("kept_text"))


@query("op3_warc", warc.ORACLE)
def op3(spark, sf_dir):
    """All pages written to WARC archives and read back."""
    folder = warc.archive_folder(spark)
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_jaccard_join")
def op4(spark, sf_dir):
    """Jaccard join of all documents, as components."""
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


@query("op5_url_filter")
def op5(spark, sf_dir):
    """All page urls judged by the rules, else by the template tree; the pages a rule decides are the labelled ones."""
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def chat_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in calls and results: an assistant's turn is a call with its text
    as query, a user's turn the result of the call one turn before."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.when(F.pmod("turn", F.lit(5)) == 3, "lookup").when(F.pmod("turn", F.lit(7)) == 5, "calculate").otherwise("search")
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    ref = F.when(F.col("turn") >= 3, F.concat(F.lit(',"after":{"$ref":"c'), F.floor(F.col("turn") / 2).cast("string"), F.lit('"}'))).otherwise("")
    arguments = F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), F.col("turn").cast("string"), ref, F.lit("}"))
    calls = t.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), "turn",
                                                 name.alias("name"), arguments.alias("arguments"))
    results = t.where("role = 'user' AND turn > 0").select("conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"),
                                                           F.col("text").alias("content"))
    return calls, results


_OP6_ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, text,
         CASE WHEN turn % 5 = 3 THEN 'lookup' WHEN turn % 7 = 5 THEN 'calculate' ELSE 'search' END AS name,
         CASE WHEN turn >= 3 THEN 'c' || (turn // 2) END AS used
  FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'user' AND turn > 0),
lev AS (
  SELECT conv_id, call_id, 0 AS level FROM c WHERE used IS NULL
  UNION ALL
  SELECT c.conv_id, c.call_id, lev.level + 1 FROM c JOIN lev ON c.conv_id = lev.conv_id AND c.used = lev.call_id),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.name, c.text, c.used, r.content,
         c.call_id IS NULL AS orphan, r.call_id IS NULL AS no_result
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT j.conv_id, j.call_id, j.turn, lev.level,
       CASE WHEN orphan THEN 'orphan_result'
            WHEN j.used IS NOT NULL AND p.call_id IS NULL THEN 'missing_dependency'
            WHEN lev.level IS NULL THEN 'blocked'
            WHEN j.name <> 'search' THEN 'invalid'
            WHEN no_result THEN 'no_result' ELSE 'ok' END AS status,
       CASE WHEN orphan THEN NULL WHEN j.name = 'lookup' THEN 'key is missing' WHEN j.name = 'calculate' THEN 'limit is not string' ELSE '' END AS problems,
       sha256('{"arguments":' || CASE WHEN orphan THEN 'null' ELSE '{' || CASE WHEN j.used IS NULL THEN '' ELSE '"after":{"$ref":"' || j.used || '"},' END
              || '"limit":' || j.turn || ',"query":' || to_json(coalesce(j.text, ''))::VARCHAR || '}' END
              || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"id":"' || j.call_id || '","name":'
              || coalesce('"' || j.name || '"', 'null') || '}') AS json_sha256
FROM j LEFT JOIN lev ON j.conv_id = lev.conv_id AND j.call_id = lev.call_id
LEFT JOIN c p ON p.conv_id = j.conv_id AND p.call_id = j.used
"""


@query("op6_chat_tools", _OP6_ORACLE)
def op6(spark, sf_dir):
    """Tool calls of all conversations linked, ordered, checked and serialised."""
    out = chat_tools.link_tool_calls(*chat_tables(spark, sf_dir), TOOL_SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "level", "status", F.array_join("problems", "; ").alias("problems"), F.sha2("json", 256).alias("json_sha256"))


@query("op7_decontaminate")
def op7(spark, sf_dir):
    """All documents searched for all benchmark windows."""
    out = decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    named = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), "contaminated")


@query("op8_packing")
def op8(spark, sf_dir):
    """All documents packed into windows of at most 4096 tokens."""
    out = packing.pack_documents(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


@query("op9_quality_rules", quality_rules.ORACLE)
def op9(spark, sf_dir):
    """All documents judged by their own rules and their host's failure rate."""
    out = quality_rules.quality_rules(documents(spark, sf_dir), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_license_scan", license_scan.oracle())
def op10(spark, sf_dir):
    """The best licence template of every document."""
    return license_scan.license_scan(documents(spark, sf_dir))


def tokenizer_paths() -> token_align.Paths:
    import public_tokenizers
    return token_align.Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_token_align")
def op11(spark, sf_dir):
    """All documents' tokens of two tokenizers aligned, links scored by corpus-wide counts."""
    paths = tokenizer_paths()
    out = token_align.score_documents(token_align.align_documents(documents(spark, sf_dir), paths, carry=["doc_id"]), paths)
    sha = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))


@query("op12_pii")
def op12(spark, sf_dir):
    """Personal data in all documents."""
    out = pii.find_personal_data(documents(spark, sf_dir), carry=["doc_id"])
    counts = [pii.count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in pii.KINDS if k.base]
    return out.select("row.doc_id", *counts, F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"), pii.named(F.col("spans")).alias("spans"))


@query("op13_divergence", divergence.ORACLE)
def op13(spark, sf_dir):
    """Divergences of the sources of each language, and the terms that stand out in each source."""
    return divergence.divergence(documents(spark, sf_dir))
