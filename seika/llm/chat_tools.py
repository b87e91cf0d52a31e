"""Chat formatting: tool calls linked with their results, in DataFrame functions only.

Calls (conv_id, call_id, turn, name, arguments) and results (conv_id, call_id,
content) are joined by (conv_id, call_id). A call may use earlier calls: every
``{"$ref": "<call_id>"}`` in its arguments is a dependency. Calls are ordered topologically: ``level`` 0
uses nothing, a call's level is one more than the highest it uses. Arguments are
checked against the tool's schema (required keys and JSON types), and each call is
serialised as canonical JSON: keys sorted, no blanks.

Scale: all steps are hash joins on (conv_id, call_id) or partial aggregates, and no
conversation is gathered. Levels are found by peeling: a round settles the calls whose dependencies are
all settled, so rounds are as many as the longest chain and each call is settled once; each round is
written to the shared folder. (conv_id, level, turn, call_id) is the order, so no window over a conversation is needed.
Schemas are a parameter, a literal expression.

Defined cases: of calls that share (conv_id, call_id) the earliest turn counts (then the smallest
name and arguments), with the dependencies of all; of results the smallest content; ``n_calls`` and ``n_results`` count them; a result
without a call is an ``orphan_result`` row; dependencies on unknown calls give ``missing_dependency``, on each
other ``cycle``, and whatever uses such a call is ``blocked``; null or broken arguments give ``invalid``; status is the
first that holds of missing_dependency, cycle, blocked, invalid, no_result, ok. Null ids never match; they stay rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seika.session import stage

_REF = r'\{\s*"\$ref"\s*:\s*"([^"]+)"\s*\}'


def _type_of(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", F.lit("string")).when(kind == "BOOLEAN", F.lit("boolean")).when(kind == "BIGINT", F.lit("integer"))
            .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.lit("number")).when(kind.startswith("ARRAY"), F.lit("array"))
            .when(kind.startswith("OBJECT"), F.lit("object")))


def problems_of(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Array of what is wrong with the arguments; empty if they fit the tool's schema.
    A schema is {"required": [...], "properties": {key: type}}; an integer is a number, a $ref fits any type."""
    v = F.try_parse_json(arguments)
    checks = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        found = [F.when(F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), F.lit(None).cast("string")).otherwise("not a JSON object")]
        for key in sorted(set(schema.get("required", ())) | set(schema.get("properties", {}))):
            if not key.replace("_", "").isalnum():
                raise ValueError(f"key {key!r} is not a plain name")
            part = F.try_variant_get(v, f"$.{key}", "variant")
            kind, want = _type_of(part), schema.get("properties", {}).get(key)
            if key in schema.get("required", ()):
                found.append(F.when(v.isNotNull() & part.isNull(), F.lit(f"{key} is missing")))
            if want:
                fits = (kind == want) | ((kind == "integer") & F.lit(want == "number")) | F.try_variant_get(part, "$['$ref']", "string").isNotNull()
                found.append(F.when(part.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.lit(f"{key} is not {want}")))
        checks = F.when(name == tool, F.array_compact(F.array(*found))).otherwise(checks)
    return checks


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, level, status, problems, n_calls, n_results, json), a row
    for each call and each result without one."""
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = F.struct("turn", "name", "arguments").alias("call")
    refs = F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(_REF), F.lit(1))
    # Ids and references only; the texts are shuffled once, at the end.
    known = stage(calls.where(named).select(*key, refs.alias("uses")), "chat-calls")
    edges = stage(known.select(*key, F.explode("uses").alias("used")).distinct(), "chat-edges")
    ids = known.select(F.col("conv_id").alias("k1"), F.col("call_id").alias("k2")).distinct()
    absent = edges.join(ids, (F.col("conv_id") == F.col("k1")) & (F.col("used") == F.col("k2")), "left_anti").select(*key).distinct()
    settled = stage(known.select(*key).distinct().join(edges, key, "left_anti").withColumn("level", F.lit(0)), "chat-levels")
    done, open_edges, level = settled, edges, 0
    while True:
        # Edges onto calls settled in the last round are resolved; a call without open edges is settled next.
        last = settled.select(F.col("conv_id").alias("s1"), F.col("call_id").alias("s2"))
        left = stage(open_edges.join(last, (F.col("conv_id") == F.col("s1")) & (F.col("used") == F.col("s2")), "left_anti"), "chat-edges")
        ready = open_edges.select(*key).distinct().join(left.select(*key).distinct(), key, "left_anti")
        level += 1
        settled = stage(ready.withColumn("level", F.lit(level)), "chat-levels")
        if not settled.limit(1).count():
            break
        done, open_edges = done.unionByName(settled), left
    # What is never settled uses an absent call, lies on a cycle, or uses such a call.
    stuck = stage(left.select(*key).distinct(), "chat-stuck")
    cyclic = _on_cycles(left, stuck)

    # One shuffle brings a call, its results and what was found out about it together.
    columns = {"call": "struct<turn:bigint,name:string,arguments:string>", "content": "string", "is_call": "int", "is_result": "int",
               "level": "int", "absent": "boolean", "cyclic": "boolean", "stuck": "boolean"}

    def part(d: DataFrame, **have: Column) -> DataFrame:
        return d.select(*key, *[have.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    said = part(calls, call=call, is_call=F.lit(1)).unionByName(part(results, content=F.col("content"), is_result=F.lit(1)))
    facts = part(done, level=F.col("level"))
    for d, name in ((absent, "absent"), (cyclic, "cyclic"), (stuck, "stuck")):
        facts = facts.unionByName(part(d, **{name: F.lit(True)}))
    j = said.where(named).unionByName(facts).groupBy(*key).agg(
        F.min("call").alias("call"), F.min("content").alias("content"), F.count("is_call").alias("n_calls"), F.count("is_result").alias("n_results"),
        *[F.max(c).alias(c) for c in ("level", "absent", "cyclic", "stuck")])
    lone = said.where(~named).withColumns({"n_calls": F.coalesce("is_call", F.lit(0)).cast("long"),
                                           "n_results": F.coalesce("is_result", F.lit(0)).cast("long")}).drop("is_call", "is_result")
    j = j.unionByName(lone).select(*key, "call.*", "content", "n_calls", "n_results", "level", "absent", "cyclic", "stuck")
    orphan = F.col("n_calls") == 0
    j = j.withColumn("problems", F.when(~orphan, problems_of(F.col("name"), F.col("arguments"), schemas)))
    status = (F.when(orphan, "orphan_result").when(F.col("absent"), "missing_dependency").when(F.col("cyclic"), "cycle")
              .when(F.col("stuck"), "blocked").when(F.size("problems") > 0, "invalid").when(F.col("n_results") == 0, "no_result").otherwise("ok"))
    text = lambda c: F.when(F.col(c).isNotNull(), F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))
    field = lambda k, v: F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null")))
    canonical = F.to_json(F.try_parse_json(F.col("arguments")))
    json = F.concat(F.lit("{"), F.concat_ws(",", field("arguments", canonical), field("content", text("content")),
                                            field("id", text("call_id")), field("name", text("name"))), F.lit("}"))
    return j.select(*key, "turn", "level", status.alias("status"), "problems", "n_calls", "n_results", json.alias("json"))


def _on_cycles(edges: DataFrame, stuck: DataFrame) -> DataFrame:
    """Calls on a cycle: peel the stuck calls also from the other side (those that no
    stuck call uses), after those that wait for an absent call only."""
    key = ["conv_id", "call_id"]
    live = edges.join(stuck.select(F.col("conv_id").alias("u1"), F.col("call_id").alias("u2")),
                      (F.col("conv_id") == F.col("u1")) & (F.col("used") == F.col("u2"))).select(*key, "used")
    live = stage(live, "chat-cycles")
    while True:
        heads = live.select("conv_id", F.col("used").alias("call_id")).distinct()
        tails = live.select(*key).distinct()
        inner = heads.join(tails, key, "left_semi").select(F.col("conv_id").alias("i1"), F.col("call_id").alias("i2"))
        kept = (live.join(inner, (F.col("conv_id") == F.col("i1")) & (F.col("call_id") == F.col("i2")), "left_semi")
                .join(inner, (F.col("conv_id") == F.col("i1")) & (F.col("used") == F.col("i2")), "left_semi"))
        kept = stage(kept, "chat-cycles")
        if kept.count() == live.count():
            return kept.select(*key).distinct()
        live = kept
