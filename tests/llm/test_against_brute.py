"""Operators against plain Python on the smallest documents and on a hand-made table."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from seika.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules, queries, suffix_dedup, url_filter
from seika.llm.common import prepare

from . import brute

SF = "/root/testdata/sf0.001"


def near(text, rate, rng):
    """A copy with some words changed."""
    return " ".join("zz" + str(rng.randrange(10**6)) if rng.random() < rate else w for w in text.split(" "))


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(60, 260))) for _ in range(6)]
    line = "A line that many documents hold, with forty characters and more."
    texts = [None, "", " \t\n ", "one", "One", "two words", "four words are here", "x" * 900, "x" * 399, "ab" * 700, "a\n" * 500,
             "ÄÖÜ ß " * 120, "É" + line[1:] + "\n" + line, *base]
    texts += [base[0], base[0].upper(), base[1] + " tail", "head " + base[1]]
    texts += [near(base[2], 0.02, rng) for _ in range(12)] + [near(base[3], 0.05, rng) for _ in range(6)]
    texts += [f"start {i}\n  {line.upper() if i % 2 else line}\t\nend {i}" for i in range(8)]
    passage = " ".join(word() for _ in range(90))
    texts += [" ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40)) for _ in range(5)]
    return list(enumerate(texts, 1000))


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    sf = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = odd_rows()
    frame = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    return {"sf": (sf, spark.read.parquet(f"{SF}/documents.parquet")), "odd": (odd, frame)}


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_line_dedup(tables, name):
    rows, docs = tables[name]
    out = line_dedup.line_dedup(docs, carry=["doc_id"]).selectExpr("row.doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) AS s")
    assert got(out, "doc_id", "n_lines", "n_dropped", "s") == sorted(brute.line_dedup(rows), key=str)


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_suffix_dedup(tables, name):
    rows, docs = tables[name]
    out = suffix_dedup.suffix_dedup(docs, keep_text=False)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(rows), key=str)


def test_suffix_dedup_of_cut_texts_and_many_buckets(tables, monkeypatch):
    """Small pieces: long texts are cut into overlapping parts."""
    rows, _ = tables["sf"]
    monkeypatch.setattr(suffix_dedup, "PIECE", 4000)
    import pyarrow as pa

    texts = [t for _, t in rows]
    data, offsets = suffix_dedup.texts_of(pa.array(texts))
    cut = sorted(itertools.chain.from_iterable(zip(r.tolist(), p.tolist(), k.tolist(), c.tolist(), strict=True) for r, p, k, _, c, _, _ in suffix_dedup.anchors_of(data, offsets)))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 20)
    whole = sorted(itertools.chain.from_iterable(zip(r.tolist(), p.tolist(), k.tolist(), c.tolist(), strict=True) for r, p, k, _, c, _, _ in suffix_dedup.anchors_of(data, offsets)))
    assert cut == whole


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_jaccard_join(tables, name):
    rows, docs = tables[name]
    assert got(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=str)


def test_jaccard_join_with_common_shingles_and_small_blocks(tables, monkeypatch):
    """Common shingles, salted lists, blocks and groups as at a large size."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(12):
        own = " ".join(word() for _ in range(rng.randrange(20, 60)))
        texts += [f"{common} {near(own, 0.03, rng)}" for _ in range(5)]
    rows = list(enumerate(texts))
    for k, v in {"COMMON_IN_PART": 4, "COMMON": 8, "SALTS": 3, "BLOCK": 4, "GROUP": 2, "BROADCAST_ROWS": 0}.items():
        monkeypatch.setattr(jaccard_join, k, v)
    docs = tables["odd"][1].sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows), key=str)


def benchmark_rows(spark, rows):
    texts = [t for _, t in rows if t and len(t.split()) > 40]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900 + i, " ".join(t.split()[5:30])) for i, t in enumerate(texts[:4])]
    return bench + [(950, None), (951, ""), (952, "!!"), (953, "One"), (954, "two WORDS"), (None, " ".join(texts[5].split()[3:20])), (901, "head")]


@pytest.mark.parametrize(("name", "block"), [("sf", 8 << 20), ("odd", 8 << 20), ("odd", 2000)])
def test_decontaminate(spark, tables, name, block):
    rows, docs = tables[name]
    bench = benchmark_rows(spark, rows)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    out = decontaminate.find_contamination(docs, frame, carry=["doc_id"], shard_words=3000, block_bytes=block).selectExpr(
        "row.doc_id", "n_words", "n_hit", "cast(size(items) as long) AS n",
        "sha2(array_join(array_sort(transform(items, x -> string(x))), ','), 256) AS s", "contaminated")
    assert got(out, *out.columns) == sorted(brute.decontaminate(rows, bench), key=str)


def test_excised_documents_hold_no_window(spark, tables):
    rows, docs = tables["odd"]
    bench = benchmark_rows(spark, rows)[-8:-5]
    frame = spark.createDataFrame(bench, "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.excise_documents(docs, frame).collect()}
    before = {d: k for d, _, k, *_ in brute.decontaminate(rows, bench)}
    assert any(before.values())
    assert all((out[d] == t) == (before[d] == 0) for d, t in rows)
    n = {d: len(brute.BENCH_WORD.findall(brute.lower(t or ""))) for d, t in rows}
    assert all(len(brute.BENCH_WORD.findall(brute.lower(out[d] or ""))) == n[d] - before[d] for d in out)


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_packing_round_trip(tables, name):
    rows, docs = tables[name]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    out = packing.pack_documents(docs, pool_tokens=20_000).collect()
    pieces, windows, steps = {}, {}, {}
    for r in out:
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(piece) == r["length"] > 0
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], piece))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"], r["step_id"]))
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        at = 0
        for start, piece in sorted(p):
            assert start == at
            assert piece == ids[d][at:at + len(piece)]
            at += len(piece)
        assert at == len(ids[d])
    for w in windows.values():
        at = 0
        for offset, length, tier, _ in sorted(w):
            assert offset == at
            at += length
        assert at == tier <= 4096
        assert tier & (tier - 1) == 0
        steps[w[0][3]] = steps.get(w[0][3], 0) + tier
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_packing_query_checksums(spark, tables):
    out = E.queries()["op8_packing"](spark, SF)
    full = {(r["doc_id"], r["start"]): r["ids"] for r in packing.pack_documents(tables["sf"][1]).collect()}
    for r in out.collect():
        assert r["ids_crc32"] == zlib.crc32(full[r["doc_id"], r["start"]])


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_quality_rules(tables, name):
    rows, docs = tables[name]
    out = quality_rules.quality_rules(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *out.columns) == sorted(brute.quality(rows), key=str)


def same_tree(out, expected):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in out}
    assert got == {i: e[:5] for i, e in expected.items()}
    assert all(abs(r["purity"] - expected[r["page_id"]][5]) < 1e-9 for r in out)


def test_url_filter_of_the_given_pages(spark):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    rules = [(r.verdict, r.host, r.path) for r in queries.URL_RULES]
    same_tree(E.queries()["op5_url_filter"](spark, SF).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect(),
              brute.url_tree(pages, rules))


@pytest.mark.parametrize("seed", [1, 2])
def test_url_filter_of_random_pages(spark, seed):
    rng = random.Random(seed)
    name = lambda n: rng.choice(["news", "offer", "user", "de", "fr", "a1", "É", "", "x-22"] + [f"p{chr(97 + i)}" for i in range(n)])
    urls = [None, "no host", "http://h0", "http://h0/", "http://H0/?a/b", "a://b://c/d"]
    urls += [f"http://{rng.choice(['h0', 'H1', 'h2.org', 'example.org'])}/" + "/".join([rng.choice(["news", "offer", "user", "de"]), *(name(3 * d) for d in range(rng.randrange(5)))])
             + rng.choice(["", f"/{rng.randrange(99)}", "?q=/x", "#f"]) for _ in range(1200)]
    pages = list(enumerate(urls))
    # labels follow the path's first name, with some noise; many pages have none
    labels = {i: ("/offer" in (u or "")) ^ (rng.random() < 0.04) for i, u in pages if rng.random() < 0.5}
    rules = [url_filter.Rule("block", "example.org", "/de"), url_filter.Rule("allow", "org", "/")]
    limits = dict(max_children=4, z=1.5, k=3.0, max_purity=0.7, min_labelled=4)
    out = url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string"), rules,
                                spark.createDataFrame([(i, int(b)) for i, b in labels.items()], "page_id long, bad int"), **limits).collect()
    expected = brute.url_tree(pages, [(r.verdict, r.host, r.path) for r in rules], labels, **limits)
    same_tree(out, expected)
    assert {"block", "allow"} == {e[3] for e in expected.values() if e[2] is None} and any("*" in e[4] for e in expected.values())
