"""Licence scan in DataFrame functions only: Dice coefficient over word bigrams.

Units are the lines of a document, its whole text, and runs of consecutive lines with at most
(2 - d) / d times the words of the template. Of the runs that overlap each other, a line or the
whole text, one counts, if it is the best of them (of equal ones the longest template's). A unit is normalised to
lower-case ASCII words; its set of distinct word bigrams is compared to every
template whose size can reach the threshold: Dice >= d needs
d / (2 - d) <= |unit| / |template| <= (2 - d) / d, so other templates are
pruned by size, and units too short or too long for all templates are dropped
before any bigram is made.

Scale: one pass keeps the documents that hold d / (2 - d) of a template's bigrams, as all with a
match do; they are written to the shared folder. Only units over the threshold are shuffled, as
(doc_id, licence, dice), runs with their lines. Templates are a parameter, held as one literal.
The complete texts (``licenses``) are read by the driver.

Defined cases: null or empty text, or fewer than two words, matches nothing;
of equal scores the licence id that sorts first wins; rows that share a doc_id
share their best match, null doc_ids likewise; every row of the input gives one row.
"""

from __future__ import annotations

import math
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seika.session import stage

MIN_DICE = 0.75

# Licence notices and short licence texts, as published with each licence.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def full_texts() -> dict[str, str]:
    """The complete licence texts, named as their file with ``-full``."""
    folder = resources.files("seika.llm") / "licenses"
    return {f.name.removesuffix(".txt") + "-full": f.read_text() for f in folder.iterdir() if f.name.endswith(".txt")}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def _pairs(words: Column) -> Column:
    """Hashes of the word bigrams in order; ``words`` must have two words at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def bigrams(words: Column) -> Column:
    """Hashes of the distinct word bigrams; ``words`` must have two words at least."""
    return F.array_distinct(_pairs(words))


def _template_sets(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], int]]:
    """(id, bigram hashes, words) of each template, by the same expressions as the units'."""
    rows = spark.createDataFrame(sorted(templates.items()), "id string, text string").select("id", words_of(F.col("text")).alias("words"))
    return sorted(tuple(r) for r in rows.select("id", bigrams(F.col("words")), F.size("words")).collect())


def _computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with more columns, each made once a row: an explode keeps them out of later lambdas and filters."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _candidates(docs: DataFrame, known: Column, sets: list[tuple[str, list[int], int]], fewest: int) -> DataFrame:
    """(doc_id, text, near) of the documents that hold ``need`` bigrams of a template; ``near``: the ids of all such.
    Nothing else can match, for a unit's bigrams are its document's."""
    every = sorted({g for _, grams, _ in sets for g in grams})
    frame = _computed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), words=words_of(F.coalesce("text", F.lit(""))))
    frame = frame.where(F.size("words") >= 2)
    frame = _computed(frame, hits=F.filter(_pairs(F.col("words")), lambda g: g.isin(every))).where(F.size("hits") >= fewest)
    near = F.filter(known, lambda t: (t["need"] <= F.size("hits")) & (F.size(F.array_intersect(t["grams"], F.col("hits"))) >= t["need"]))
    return _computed(frame.drop("words"), near=F.transform(near, lambda t: t["id"])).where(F.size("near") > 0).select("doc_id", "text", "near")


def _run_matches(docs: DataFrame, known: Column, min_dice: float) -> DataFrame:
    """(doc_id, license, dice) of runs of lines that match better than what they overlap.

    A match has ``need`` of the template's bigrams at least, and
    a run may be taken to start at a line with one of them, if ``need`` of them stand in the
    ``most`` words that follow. From each such line one pass gives the best run: a bigram counts
    if its occurrence before lies above the first line.
    """
    frame = _computed(docs.where(F.contains("text", F.lit("\n"))), words=words_of(F.col("text")))
    frame = _computed(frame, grams=_pairs(F.col("words"))).drop("words")
    # Of every word: its line (of those with words), its place there, whether it is the last.
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.size(words_of(x))), lambda n: n > 0)
    at = F.flatten(F.transform(lines, lambda n, k: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        k.alias("line"), i.alias("place"), (i == n).alias("last")))))
    order = F.sort_array(F.transform("grams", lambda g, p: F.struct(g.alias("g"), p.alias("p"))))
    frame = _computed(frame.withColumn("row", F.monotonically_increasing_id()), at=at, order=order).drop("text", "grams")
    before = F.sort_array(F.transform("order", lambda x, k: F.struct(
        x["p"].alias("p"), x["g"].alias("g"),
        F.when(F.get("order", k - 1)["g"] == x["g"], F.get("order", k - 1)["p"]).alias("before"))))
    frame = _computed(frame, before=before).drop("order")
    frame = frame.select("row", "doc_id", "at", "before", (F.element_at("at", -1)["line"]).alias("end"), F.explode(F.filter(known, lambda t: F.array_contains("near", t["id"]))).alias("t"))
    word = lambda p: F.get("at", p)
    frame = _computed(frame, pos=F.transform("before", lambda x: F.struct(
        x["p"].alias("p"), word(x["p"])["line"].alias("line"), word(x["p"])["place"].alias("place"), word(x["p"] + 1)["line"].alias("to"),
        word(x["p"] + 1)["last"].alias("last"), F.coalesce(word(x["before"])["line"], F.lit(-1)).alias("before"),
        F.array_contains("t.grams", x["g"]).alias("hit")))).drop("at", "before")
    frame = _computed(frame, hits=F.filter("pos", lambda x: x["hit"]))
    frame = _computed(frame, starts=F.filter(F.transform("hits", lambda x, q: F.struct(
        x["line"].alias("line"), (x["p"] - x["place"] + 1).alias("first"),
        (F.coalesce(F.get("hits", q - 1)["line"] != x["line"], F.lit(True))
         & F.coalesce(F.get("hits", q + F.col("t.need") - 1)["p"] - x["p"] < F.col("t.most"), F.lit(False))).alias("on"))), lambda x: x["on"]))
    frame = frame.drop("hits").where(F.size("starts") > 0)

    def best(start: Column) -> Column:
        def add(done: Column, x: Column) -> Column:
            new = x["before"] < start["line"]
            n, hit = done["n"] + new.cast("int"), done["hit"] + (new & x["hit"]).cast("int")
            minus = -2.0 * hit / (F.col("t.n") + n)
            here = x["last"] & (minus < done["minus"])
            return F.struct(n.alias("n"), hit.alias("hit"), F.when(here, minus).otherwise(done["minus"]).alias("minus"),
                            F.when(here, x["to"]).otherwise(done["to"]).alias("to"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hit"), F.lit(0.0).alias("minus"), F.lit(-1).alias("to"))
        return F.aggregate(F.slice("pos", start["first"] + 1, F.col("t.most") - 1), zero, add, lambda done: F.struct(
            start["line"].alias("line"), done["to"].alias("to"), done["minus"].alias("minus"), (-F.col("t.n")).alias("short"),
            # Lines and whole texts are units anyway; a run as good as one is not counted again.
            ((start["line"] != done["to"]) & ((start["line"] > 0) | (done["to"] < F.col("end")))).alias("run"), F.col("t.id").alias("id")))

    found = _computed(frame, found=F.transform("starts", best)).select("row", "doc_id", F.filter("found", lambda x: x["minus"] <= -min_dice).alias("found"))
    found = found.where(F.size("found") > 0).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    none = F.struct(F.lit(None).cast("struct<line:int,to:int,minus:double,short:int,run:boolean,id:string>").alias("last"),
                    F.array().cast("array<struct<line:int,to:int,minus:double,short:int,run:boolean,id:string>>").alias("out"))

    def closed(done: Column) -> Column:
        return F.when(F.coalesce(done["last"]["run"], F.lit(False)), F.concat(done["out"], F.array(done["last"]))).otherwise(done["out"])

    def sweep(done: Column, x: Column) -> Column:
        last = done["last"]
        over = F.coalesce(x["line"] <= last["to"], F.lit(False))
        better = F.struct(x["minus"], x["short"], x["run"], x["id"]) < F.struct(last["minus"], last["short"], last["run"], last["id"])
        return F.struct(F.when(over & ~better, last).otherwise(x).alias("last"), F.when(over, done["out"]).otherwise(closed(done)).alias("out"))

    return found.select("doc_id", F.explode(F.aggregate("found", none, sweep, closed)).alias("m")).select(
        "doc_id", F.col("m.id").alias("license"), (-F.col("m.minus")).alias("dice"))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """(doc_id, license, dice) of every unit's best template at or over ``min_dice``."""
    templates = TEMPLATES | full_texts() if templates is None else templates
    sets = _template_sets(docs.sparkSession, templates)
    widest = (2 - min_dice) / min_dice
    need = lambda n: max(1, math.ceil(n / widest - 1e-9))
    known = F.array(*[F.struct(F.lit(name).alias("id"), F.split(F.lit(",".join(map(str, grams))), ",").cast("array<bigint>").alias("grams"),
                               F.lit(len(grams)).alias("n"), F.lit(need(len(grams))).alias("need"),
                               F.lit(math.floor(words * widest)).alias("most")) for name, grams, words in sets])
    # Sizes of the templates decide which units can match at all.
    least, most = min(len(g) for _, g, _ in sets) / widest, max(len(g) for _, g, _ in sets) * widest
    docs = stage(_candidates(docs, known, sets, min(need(len(g)) for _, g, _ in sets)), "license-candidates")
    text = F.col("text")
    # A whole text of one line is that line.
    units = F.when(F.contains(text, F.lit("\n")), F.concat(F.array(text), F.split(text, "\n"))).otherwise(F.array(text))
    # The words are made inside explode, so that no later filter is pushed down into them and computes them again.
    u = docs.select("doc_id", "near", F.explode(F.transform(units, words_of)).alias("words"))
    u = u.where(F.size("words") >= max(2, int(least) + 1))
    u = u.withColumn("grams", bigrams(F.col("words"))).drop("words")
    u = u.withColumn("n", F.size("grams")).where(F.col("n").between(least, most))
    near = F.filter(known, lambda t: F.array_contains("near", t["id"]) & (2 * F.least(t["n"], F.col("n")) >= min_dice * (t["n"] + F.col("n"))))
    scored = F.transform(near, lambda t: F.struct(
        (-2.0 * F.size(F.array_intersect(t["grams"], F.col("grams"))) / (t["n"] + F.col("n"))).alias("minus"),
        t["id"].alias("id")))
    best = u.select("doc_id", F.array_min(scored).alias("best"))
    best = best.where(F.col("best.minus") <= -min_dice).select(
        "doc_id", F.col("best.id").alias("license"), (-F.col("best.minus")).alias("dice"))
    return best.unionByName(_run_matches(docs, known, min_dice))


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, license, dice, n_matches) for every document; null, null, 0 without a match."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    best = (license_matches(own, **options).groupBy(F.col("doc_id").alias("id"))
            .agg(F.min(F.struct((-F.col("dice")).alias("minus"), F.col("license").alias("license"))).alias("best"),
                 F.count(F.lit(1)).alias("n")))
    return (own.select("doc_id").join(best, F.col("doc_id").eqNullSafe(F.col("id")), "left")
            .select("doc_id", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("dice"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_matches")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(templates: dict[str, str] = TEMPLATES, min_dice: float = MIN_DICE) -> str:
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in sorted(templates.items()))
    words = "string_split(trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    return f"""
WITH tw AS (SELECT id, {words.format('text')} AS w FROM (VALUES {rows}) v(id, text)),
t AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
u0 AS (
  SELECT doc_id, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
u1 AS (SELECT row_number() OVER () AS k, doc_id, {words.format('unit')} AS w FROM u0),
u AS (SELECT k, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
      FROM u1 WHERE len(w) BETWEEN 2 AND 100000),
s AS (
  SELECT k, doc_id, id, 2.0::DOUBLE * len(list_intersect(t.g, u.g)) / (len(t.g) + len(u.g)) AS dice
  FROM u, t WHERE 2 * least(len(t.g), len(u.g)) >= {min_dice} * (len(t.g) + len(u.g))),
b AS (SELECT k, doc_id, min(id) AS id, any_value(dice) AS dice
      FROM (SELECT *, max(dice) OVER (PARTITION BY k) AS top FROM s) WHERE dice = top AND dice >= {min_dice} GROUP BY k, doc_id),
d AS (SELECT doc_id, max(dice) AS dice, count(*) AS n FROM b GROUP BY 1)
SELECT documents.doc_id, (SELECT min(id) FROM b WHERE b.doc_id = d.doc_id AND b.dice = d.dice) AS license,
       d.dice AS dice, coalesce(d.n, 0)::BIGINT AS n_matches
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
"""
