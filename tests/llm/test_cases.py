"""Defined cases: nulls, empty tables, extra and clashing columns, repeated rows, and the guard of the entry."""

import os
import random
import re
import shutil
import subprocess
import sys
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seika.llm import (
    chat_tools,
    components,
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    packing,
    quality_rules,
    queries,
    suffix_dedup,
    url_filter,
    warc,
)
from seika.llm.common import prepare

from . import brute

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOC + ", row string, key int, n_lines string, drop string, marks string, kept boolean, h long, words string, spans string"


def doc_table(spark, rows, schema=DOC):
    prepare(spark)
    n = len(schema.split(", "))
    return spark.createDataFrame([tuple([*r, *[None] * (n - len(r))]) for r in rows], schema)


LONG = "A line of some length that many of the documents hold, word for word."
BODY = " ".join(f"word{i} goes on" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, BODY, "en", None, 5), (3, BODY, None, "b", 5), (3, BODY, None, "b", 5),
    (3, BODY + " other", "en", "b", 5), (None, None, None, None, None), *[(10 + i, f"{LONG}\nown {i} " + BODY, "en", "c", 1) for i in range(6)]]


def test_clashing_columns_come_back(spark):
    docs = doc_table(spark, ROWS, CLASH)
    bench = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    for out in (line_dedup.dedup_documents(docs), quality_rules.kept_documents(docs), jaccard_join.one_of_each(docs),
                decontaminate.clean_documents(docs, bench), decontaminate.excise_documents(docs, bench)):
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.collect()
    for out in (suffix_dedup.suffix_dedup(docs), packing.pack_documents(docs), license_scan.license_scan(docs)):
        out.collect()


def test_nulls_and_repeats(spark):
    docs = doc_table(spark, ROWS)
    lines = {(r["row"]["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()}
    assert {(1, 1, 0), (None, 1, 0), (10, 2, 1), (15, 2, 0)} <= lines
    kept = quality_rules.quality_rules(docs).collect()
    assert len(kept) == len(ROWS)
    assert {r["row"]["doc_id"] for r in kept if not r["kept"]} >= {1, 2}
    join = jaccard_join.jaccard_join(docs).collect()
    assert len(join) == len(ROWS)
    assert {r["component_id"] for r in join if r["doc_id"] in (3, 10, 15)} == {3}
    assert {r["component_id"] for r in join if r["doc_id"] is None} == {None}
    assert {(r["doc_id"], r["component_id"]) for r in join if r["doc_id"] in (1, 2)} == {(1, 1), (2, 2)}
    one = jaccard_join.one_of_each(docs).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in one) == [0, 0, 1, 2, 3, 3, 3]
    want = sorted(brute.suffix_dedup([r[:2] for r in ROWS]), key=str)
    cut = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in cut), key=str) == want
    packed = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] in (1, 2)) == 2
    scan = license_scan.license_scan(docs).collect()
    assert len(scan) == len(ROWS)


def test_rows_of_one_doc_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i} goes on" for i in range(40)) for x in "abc")
    # Doc 5 is the first of its own text and stands in doc 3's class with the other one.
    rows = [(5, a), (5, b), (3, b), (8, a + " near"), (9, c)]
    out = jaccard_join.jaccard_join(doc_table(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(3, 3), (5, 3), (5, 3), (8, 3), (9, 9)]


def test_empty_tables(spark):
    docs = doc_table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (line_dedup.dedup_documents(docs), quality_rules.kept_documents(docs), jaccard_join.one_of_each(docs), jaccard_join.jaccard_join(docs),
                decontaminate.clean_documents(docs, bench), suffix_dedup.suffix_dedup(docs), packing.pack_documents(docs), license_scan.license_scan(docs)):
        assert out.count() == 0
    some = doc_table(spark, ROWS)
    assert decontaminate.clean_documents(some, bench).count() == len(ROWS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.url_filter(pages, queries.URL_RULES).count() == 0
    folder = warc.archive_folder(spark)
    warc.write_warc(pages, folder)
    assert warc.read_warc(spark, folder).count() == 0


# Letters of every block that NFC parts into a letter and a mark, or swaps for others.
PARTED = ("\u0958\u095c\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69"
          "\ufb1d\ufb1f\ufb2a\ufb2c\ufb36\ufb3e\ufb40\ufb43\ufb46\ufb4e\u2126\u212a\u212b\uf900\u0130\u1112\u1161\u11ab")


def test_packing_of_words_that_the_normaliser_parts():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    texts = ["hello \u0938\u095c\u0915 there", *PARTED, *(f"one a{c}b two {c}{c}\n{c}" for c in PARTED), " ".join(PARTED)]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == [*encode.tok.encode(text, add_special_tokens=False).ids, 2], ascii(text)
    fresh = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    fresh.ends_word[:] = False  # no count of ends fits: by offsets
    assert [x.tolist() for x in fresh(["some words of text"])] == [x.tolist() for x in encode(["some words of text"])]


def test_packing_looks_up_stems_and_no_punctuation():
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    words = ["stem", "Stem", "STEM,", "stem.", "stem...%%%", "stem\u00e9", "stem\u00e9,", "don't", "don't!", "stem'", "'s", "'s,", "''s", "U.S.", "u.s", "a1", "a1.",
             "stem:/)]}>\"';,", ".", "...", "'", "<|endoftext|>", "x<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>,", "h\u0331", "H\u0331.", "J\u030c,", "\u0130,",
             "\u0130.a", "a\u0338,", "=\u0338", "a=\u0338", "\u095c,", "a\u095c.", "\u03a3\u03a3.", "tab\there,", "tab\t,", "\u00a0,", "a\u00a0.", "\u0661.", "\U0001f600.", "a\0.", ""]
    texts = [*words, " ".join(words), "\n".join(words), "", None, *(f"{v} {w}\n{w}{v}" for v in words for w in words)]
    for _ in range(2):  # the second time all stems are known
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == [*encode.tok.encode(text or "", add_special_tokens=False).ids, 2], ascii(text)
    fresh = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    list(fresh(["stem Stem STEM stem, Stem. STEM! stem?! stem... (stem)"]))
    assert set(fresh.known) == {"", "stem", "(stem"}


def test_hosts_are_rejected_together(spark):
    bad = [(i, "too short", "en", "spam", 1) for i in range(40)] + [(100, BODY, "en", "spam", 1)]
    good = [(200 + i, BODY + f" {i}", "en", f"s{i % 4}", 1) for i in range(40)]
    out = {r["row"]["doc_id"]: r for r in quality_rules.quality_rules(doc_table(spark, bad + good)).collect()}
    assert out[100]["host_rejected"] and not out[100]["base_failed"] and not out[100]["kept"]
    assert all(out[200 + i]["kept"] for i in range(40))


def sql(spark, name, tables):
    con = duckdb.connect()
    for table, df in tables.items():
        frame = df.toPandas()
        con.register(f"{table}_frame", frame)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM {table}_frame")
    cur = con.execute(queries.ORACLE[name])
    return [d[0] for d in cur.description], cur.fetchall()


def test_license_scan_against_sql(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(100 + i, t.upper().replace(" ", "\t ") + " extra", "en", "s", 1) for i, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(200, "Some text.\nReleased under the MIT License.\nAnd Licensed under CC BY-NC 4.0.", "en", "s", 1), (201, "nothing here", "en", "s", 1)]
    docs = doc_table(spark, rows)
    cols, want = sql(spark, "op10_license_scan", {"documents": docs})
    got = [tuple(r) for r in license_scan.license_scan(docs).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r[cols.index("license")] for r in sorted(got)[:len(license_scan.TEMPLATES)]] == list(license_scan.TEMPLATES)


def test_license_texts_wrapped_and_embedded(spark):
    full, short = license_scan.full_texts(), license_scan.TEMPLATES
    wrapped = "\n".join(textwrap.wrap(short["Apache-2.0-header"], 78))
    other = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(30))
    texts = {name: (f"Copyright (c) 2020 Some One\n\n{text}", name, 1) for name, text in full.items()}
    texts |= {f"in {name}": (f"{other}\n{text}\n{other}", name, 1) for name, text in full.items()}
    texts["header"] = (f"{other}\n{wrapped}\n{other}", "Apache-2.0-header", 1)
    texts["comment"] = ("#!/bin/sh\n" + "\n".join(f"# {x}" for x in wrapped.split("\n")) + f"\n{other}", "Apache-2.0-header", 1)
    texts["both"] = (f"{full['MIT-full']}\n{other}\n{full['ISC-full']}\n{other}\n{full['MIT-full']}", None, 3)
    texts["none"] = (other, None, 0)
    rows = [(i, t, "en", "s", 1) for i, (t, _, _) in enumerate(texts.values())]
    out = {r["doc_id"]: r for r in license_scan.license_scan(doc_table(spark, rows)).collect()}
    for i, (name, (_, want, n)) in enumerate(texts.items()):
        if want in ("Apache-2.0-full", "GPL-3.0-full", "MPL-2.0-full", "Unlicense-full"):  # these hold their own notice
            assert out[i]["license"].startswith(want.removesuffix("-full")) and out[i]["dice"] > 0.9, (name, out[i])
        elif want:
            assert out[i]["license"] == want and out[i]["dice"] > 0.9, (name, out[i])
        if name not in full and name[3:] not in full:
            assert out[i]["n_matches"] == n, (name, out[i])


def test_license_runs_against_plain_python(spark):
    rng = random.Random(5)
    notice = license_scan.TEMPLATES["MPL-2.0-header"].split()
    rows = []
    for i in range(30):
        words = [w for w in notice if rng.random() > 0.06] + rng.choices(notice, k=rng.randrange(12))
        words = rng.choices("abc", k=rng.randrange(9)) + words + rng.choices("the of mpl".split(), k=rng.randrange(9))
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words), "en", "s", 1))
    grams = lambda w: set(zip(w, w[1:]))
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).split()
    t, want = norm(" ".join(notice)), {}
    for i, text, *_ in rows:
        lines = [norm(x) for x in text.split("\n")]
        runs = [[w for x in lines[a:b] for w in x] for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
        dice = max(2 * len(grams(r) & grams(t)) / (len(grams(r)) + len(grams(t))) for r in runs if 2 <= len(r) <= len(t) * 5 / 3)
        want[i] = round(dice, 9) if dice >= 0.75 else None
    out = license_scan.license_scan(doc_table(spark, rows), templates={"MPL": " ".join(notice)}).collect()
    assert {r["doc_id"]: r["dice"] and round(r["dice"], 9) for r in out} == want
    assert len(set(want.values())) > 5


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b\r\nX: y", ""), (5, "http://c", "ä" * 2000),
         (6, "http://c", "ä" * 2000), (7, "http://d", "one"), (7, "http://d", "one"), (8, "http://e", "p\r\n\r\nWARC/1.1\r\n")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([*PAGES, (None, "http://n", "one")], "page_id long, url string, html string").repartition(3)
    folder = warc.archive_folder(spark)
    manifest = warc.write_warc(pages, folder, roll_bytes=300, partitions=2)
    assert manifest.count() > 2
    back = warc.read_warc(spark, folder, payloads=True).collect()
    assert len(back) == len(PAGES) + 1
    kind = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back), key=str)
    assert kind == sorted([(0, "revisit", 7, 3), (1, "response", None, 8), (2, "revisit", 1, 8), (3, "response", None, 0), (4, "revisit", 3, 0),
                           (5, "response", None, 4000), (6, "revisit", 5, 4000), (7, "response", None, 3), (7, "revisit", 7, 3), (8, "response", None, 15)], key=str)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response"}
    assert texts[5] == "ä" * 2000 and texts[8] == "p\r\n\r\nWARC/1.1\r\n"
    assert all(r["payload_digest"] == warc.sha1_base32(texts[r["page_id"]].encode()) for r in back if r["record_type"] == "response")
    # The same pages give the same files, and small payloads may all be responses.
    again = warc.archive_folder(spark)
    key = lambda m: sorted((r["file"], r["sha256"]) for r in m.collect())
    assert key(warc.write_warc(pages.repartition(5), again, roll_bytes=300, partitions=2)) == key(manifest)
    small = warc.archive_folder(spark)
    warc.write_warc(pages, small, min_dedup_bytes=4)
    assert warc.read_warc(spark, small).where("record_type = 'revisit'").count() == 2


def test_url_rules_and_parts(spark):
    urls = ["http://Example.ORG/es/1", "https://www.example.org/en/12?x", "https://www.example.org/en/2", "x://a.com/fr/1#f", "x://com/de/", "x://b.net/fr/",
            "nothing", None, "http://example.org", "y://notexample.org/es/", "a://b://c/d", "http://org?/es"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, queries.URL_RULES).collect()}
    assert out == {0: ("example.org", "/es/1", "example.org/es/", "block"), 1: ("www.example.org", "/en/12", "example.org/en/1", "block"),
                   2: ("www.example.org", "/en/2", "org/", "allow"), 3: ("a.com", "/fr/1", "com/fr/", "allow"), 4: ("com", "/de/", "com/de/", "block"),
                   5: ("b.net", "/fr/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.org", "", None, "allow"),
                   9: ("notexample.org", "/es/", "org/", "allow"), 10: ("b:", "//c/d", None, "allow"), 11: ("org", "", None, "allow")}


def test_url_templates_by_labels(spark):
    pages, bad = [], []
    for i in range(60):
        pages.append((i, f"http://h.net/spam/offer-{i}/buy"))
        pages.append((100 + i, f"http://h.net/news/{i}"))
        pages.append((200 + i, f"http://h.net/user/{'xyz'[i % 3] * 3}{chr(97 + i % 26)}{chr(97 + i // 26)}/page"))
    bad += [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)] + [(200 + i, 0) for i in range(30)]
    labels = spark.createDataFrame(bad, "page_id long, bad int")
    out = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), [], labels).collect()}
    assert len(out) == 180
    assert {out[i]["verdict"] for i in range(60)} == {"block"}
    assert {out[100 + i]["verdict"] for i in range(60)} | {out[200 + i]["verdict"] for i in range(60)} == {"allow"}
    assert out[0]["template"] == "spam/offer-#/buy" and out[200]["template"] == "user/*/page"


def judged_urls(spark, groups):
    """(url, pages, label or None) each, as verdict and rounded purity by url."""
    rows = [(url.format(i), label) for url, n, label in groups for i in range(n)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows) if x is not None], "page_id long, bad int")
    return {r["host"] + "/" + r["template"]: (r["verdict"], round(r["purity"], 3)) for r in url_filter.url_filter(pages, [], labels).collect()}


def test_url_branches_are_not_bridged(spark):
    good, bad = ("http://h/fr/{}", 1000, 0), ("http://h/de/{}", 1000, 1)
    apart = judged_urls(spark, [good, bad])
    assert apart["h/de/#"][0] == "block" and apart["h/fr/#"][0] == "allow"
    # One page without a label, or with too few of them, joins nothing and bridges nothing.
    assert judged_urls(spark, [good, bad, ("http://h/en/{}", 1, None)]) == {**apart, "h/en/#": ("allow", 0.5)}
    few = judged_urls(spark, [good, bad, ("http://h/en/{}", 1, 0), ("http://h/en/{}", 1, 1)])
    assert {k: v[0] for k, v in few.items()} == {"h/de/#": "block", "h/fr/#": "allow", "h/en/#": "allow"}
    # Rates that rise in small steps: the branch is tested as a whole.
    steps = [(f"http://h/{'abcdefgh'[i]}/{{}}", 40, x) for i in range(8) for x in ([0] * (7 - i) + [1] * i)]
    out = judged_urls(spark, steps)
    assert out["h/h/#"][0] == "block" and out["h/a/#"][0] == "allow"


def test_url_branches_below_the_sixth_segment(spark):
    deep = "http://h/a/b/c/d/e/f/"
    out = judged_urls(spark, [(deep + "news/{}", 40, 0), (deep + "offer/{}", 40, 1), ("http://g/" + "x/" * 60 + "{}", 3, None)])
    assert out["h/a/b/c/d/e/f/offer/#"][0] == "block" and out["h/a/b/c/d/e/f/news/#"][0] == "allow"
    assert out["g/" + "x/" * 60 + "#"][0] == "allow"
    wide = judged_urls(spark, [(f"{deep}user/{x}y/page", 4, 1) for x in "abcdefghijkl"] + [(deep + "news/{}", 40, 0)])
    assert wide["h/a/b/c/d/e/f/user/*/page"][0] == "block"


def test_url_templates_without_labels(spark):
    out = judged_urls(spark, [("http://h/de/{}", 100, 1), ("http://h/en/{}", 5, None), ("http://h/de/x/{}", 5, None),
                              ("http://g/fr/{}", 300, 0), ("http://i/en/{}", 5, None)])
    assert out["h/de/#"][0] == "block" and out["h/de/x/#"][0] == "block"  # the prefix de/ has labels
    assert out["h/en/#"][0] == "allow" and out["i/en/#"] == ("allow", round(100.5 / 401, 3))


def test_tool_calls(spark):
    calls = [(1, "a", 1, "search", '{"query": "x", "limit": 3}'), (1, "b", 2, "search", '{"limit":1,"query":{"$ref":"a"}}'),
             (1, "c", 3, "search", '{"query":{"$ref": "b"},"z":{"b":1,"a":[1,2]}}'), (1, "d", 4, "search", '{"query":{"$ref":"e"}}'),
             (1, "e", 5, "search", '{"query":{"$ref":"d"}}'), (1, "f", 6, "search", '{"query":{"$ref":"e"}}'), (1, "g", 7, "search", '{"query":{"$ref":"zz"}}'),
             (1, "h", 8, "search", '{"query":{"$ref":"g"}}'), (1, "i", 9, "search", "{broken"), (1, "j", 10, "search", None), (1, "k", 11, "search", '{"query": 5}'),
             (2, "a", 1, "other", "{}"), (2, "b", 1, "search", '{"query":"q","limit":"no"}'), (None, "a", 1, "search", '{"query":"n"}'), (2, "a", 1, "other", "{}"),
             (2, "c", 1, "search", '[1]')]
    results = [(1, "a", "r\"1"), (1, "b", None), (1, "q", "lost"), (1, "a", "second"), (None, None, "lone")] + [(1, x, "r") for x in "cdefghijk"]
    out = chat_tools.link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
                                     spark.createDataFrame(results, "conv_id long, call_id string, content string"), queries.TOOL_SCHEMAS).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in out}
    assert {k[1]: (r["level"], r["status"]) for k, r in by.items() if k[0] == 1} == {
        "a": (0, "ok"), "b": (1, "ok"), "c": (2, "ok"), "d": (None, "cycle"), "e": (None, "cycle"), "f": (None, "blocked"), "g": (None, "missing_dependency"),
        "h": (None, "blocked"), "i": (0, "invalid"), "j": (0, "invalid"), "k": (0, "invalid"), "q": (None, "orphan_result")}
    assert by[2, "a"]["problems"] == ["unknown tool"] and by[2, "a"]["n_calls"] == 2
    assert by[2, "b"]["problems"] == ["limit is not integer"] and by[2, "c"]["problems"][0] == "not a JSON object"
    assert by[1, "a"]["json"] == '{"arguments":{"limit":3,"query":"x"},"content":"r\\"1","id":"a","name":"search"}'
    assert by[1, "c"]["json"].startswith('{"arguments":{"query":{"$ref":"b"},"z":{"a":[1,2],"b":1}}')
    assert by[None, "a"]["status"] == "no_result" and by[None, None]["status"] == "orphan_result"
    assert len(out) == 12 + 3 + 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (102, 101), (200, 200)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_pipeline_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r[0] for r in brute.quality(rows) if not r[-1]}  # no host of this table is rejected
    rows = [r for r in rows if r[0] in kept]
    holders = brute.line_dedup(rows)
    out = docs
    for (name, step), check in zip(corpus_pipeline.STAGES[:-1], range(4), strict=True):
        out = spark.createDataFrame(step(spark, out, sf).toPandas(), docs.schema)
        assert out.columns == docs.columns, name
        now = {r["doc_id"]: r["text"] for r in out.collect()}
        if check == 0:
            assert set(now) == kept
        elif check == 1:
            assert {(d, brute.sha(t.encode())) for d, t in now.items()} == {(d, s) for d, _, _, s in holders}
            rows = sorted(now.items())
        elif check == 2:
            assert set(now) == {d for d, _, c in brute.jaccard(rows) if d == c}
            rows = sorted(now.items())
        else:
            assert set(now) == {d for d, *_, bad in brute.decontaminate(rows, bench) if not bad}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(now)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_the_rest_works_without_this_part(tmp_dir):
    at = os.path.join(tmp_dir, "copy")
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'prices_trend' in q and not [x for x in q if x.startswith('op')], q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={**os.environ, "PYTHONPATH": at})


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_warc", "op6_chat_tools", "op9_quality_rules", "op10_license_scan"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str)
