"""Token alignment, personal data and divergences against plain Python; rows named by 128 bits."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seika.llm import decontaminate, divergence, pii, suffix_dedup, token_align
from seika.llm.common import prepare
from seika.llm.queries import QUERIES, tokenizer_paths

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  x", "a  b ", "foo \n bar\n\n  baz", "▁x", "a ▁b c d", "a▁b", "\U0001f917 ́a", "a\x85 b\xa0 c", "<s> <|endoftext|> </s> <unk>",
       "日本 語　テスト a 한국어 텍스트 는", "x" * 3000 + " y", "don't I'll 123 45", "a᠎ b ​ c", "\t\n ", "\xe9 \xe8 \xfc", "a b", "a b",
       "मैं यह हूँ", "a\x00b c"]


def expected_alignment(v, text):
    """(n_a, n_b, groups, links as id pairs) by encoding the whole text; None if bytes are lost."""
    a = v.a.encode(" " + text, add_special_tokens=False).ids
    b = v.b.encode(text)
    tokens = [[p.data[p.start[i]:p.start[i] + p.size[i]].tobytes() for i in ids] for p, ids in ((v.a_pool, a), (v.b_pool, b))]
    if any(b"".join(t) != (" " + text).encode() for t in tokens):
        return None
    ends = [{e: k + 1 for k, e in enumerate(accumulate(map(len, t)))} for t in tokens]
    groups, links, x, y = [], [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        i, j = ends[0][e], ends[1][e]
        groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        links.append((a[i - 1], b[j - 1]))
        x, y = i, j
    return len(a), len(b), ";".join(groups), links


@pytest.mark.parametrize("size", [2000, 1 << 20])
def test_alignment_is_that_of_whole_texts(spark, size, monkeypatch):
    monkeypatch.setattr(token_align, "SLICE", size)
    v = token_align.vocabularies(tokenizer_paths())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    sums, groups, pairs, times = token_align.align_texts(v, [t.encode() if t is not None else None for t in texts])
    for k, t in enumerate(texts):
        want = expected_alignment(v, t) if t else None
        n_a, n_b, text, links = want or (0, 0, "", [])
        assert (sums[0, k], sums[1, k], sums[2, k], groups[k].decode()) == (n_a, n_b, len(links), text), t
        mine = {(int(v.a_id[p]), int(v.b_id[p])): int(n) for p, n in zip(pairs[k], times[k], strict=True)}
        assert mine == Counter(links)


def test_gallop_finds_the_first_value_not_below():
    import numpy as np
    long = np.array([1, 3, 4, 8, 9, 20, 21, 22, 40], np.int64)
    values = np.arange(45)
    got = token_align.gallop(values, np.zeros(45, np.int64), np.full(45, 9), long)
    assert got.tolist() == np.searchsorted(long, values).tolist()
    assert token_align.gallop(values[:0], values[:0], values[:0], long).tolist() == []


def test_alignment_query(spark):
    prepare(spark)
    v = token_align.vocabularies(tokenizer_paths())
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "same id"), (3, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("pairs", F.lit(2))
    paths = tokenizer_paths()
    out = token_align.score_documents(token_align.align_documents(docs.repartition(3), paths), paths)
    got = Counter((r["row"]["doc_id"], r["n_a"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in out.collect())
    found = [(d, expected_alignment(v, t) if t else None) for d, t in rows]
    count = Counter(x for _, w in found if w for x in w[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = Counter((d, w[0], len(w[3]), sum(count[x] == best[x[1]] for x in w[3]), sum(count[x] for x in w[3]), w[2]) if w else (d, 0, 0, 0, 0, "") for d, w in found)
    assert got == want
    empty = docs.limit(0)
    assert token_align.score_documents(token_align.align_documents(empty, paths), paths).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in twice) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PII = ["a@b.c%d@e.f x@@y.z a@b a@b. a.@b.c.d-e..f \xe9@a.b", "1.2.3.4.5.6.7.8 0000001.2.3.4 256.1.1.1 1255.1.1.1 1.2.3.0000000255 1..2.3.4",
       "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111 12 \U0001f6004111111111111111", "+1 (555) 123-4567 +123 +1+2 3 4 5 6 7 8 9 +12345678901234567",
       "IBAN DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432 x DE88370400440532013000 FR1420041010050500013M02606 AND MORE",
       "call (555) 123-4567 or 555-123-4567, not 555 123 4567x; ssn 123-45-6789 " + "z" * 60 + " 123-45-6789 2001:0db8:85a3:0000:0000:8a2e:0370:7334",
       None, "", "1" * 30000 + " " + "1 " * 3000 + "a." * 3000 + "@" + "b." * 3000 + "c" + "%" * 3000, "a@b.c " * 700 + " 4111111111111111" * 300]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*PII, PII[0]])], "doc_id long, text string").withColumn("spans", F.lit(0)).withColumn("m0", F.lit(0))
    rows = pii.find_personal_data(docs).select("row.doc_id", pii.named(F.col("base")).alias("b"), pii.named(F.col("spans")).alias("s")).orderBy("doc_id").collect()
    assert [r["b"] for r in rows] == [base_spans(t) for t in [*PII, PII[0]]]
    assert rows[4]["s"] == "iban:5:32,iban:37:59"  # a changed digit and more letters fail
    assert rows[5]["s"] == "local_phone:5:19,local_phone:23:35,national_id:60:71,ipv6:145:184"  # the second number has no word near it
    left = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert left[0].startswith("[email][email] x@@y.z a@b") and left[6] is None and left[7] == ""
    assert left[4] == "IBAN [iban] und [iban] x DE88370400440532013000 FR1420041010050500013M02606 AND MORE"
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_personal_data_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_pii"](spark, SF).collect()}
    for d in docs:
        want = base_spans(d["text"])
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[d["doc_id"]]["n_phone"] == want.count("phone:")


def expected_divergence(rows, min_docs):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        share = lambda count, kept=kept: {t: 1 + 1000000000 * (count[t] + 2) // (sum(count[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        count = {s: Counter(t for _, x, terms in mine if x == s for t in terms) for s in {r[1] for r in mine}}
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        for s in p:
            parts = {"pair": {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in p if o != s},
                     "term": {t: f(p[s][t], q[t]) for t in kept if count[s][t] and p[s][t] > q[t]}}
            for part, items in parts.items():
                order = sorted(items, key=lambda x: (-items[x], x.encode()))
                out |= {(lang, s, part, x, items[x], r) for r, x in enumerate(order, 1) if part == "pair" or r <= 10}
    return out


@pytest.mark.parametrize("groups, terms, pieces", [(64, 4096, 4 << 20), (2, 3, 16)])
def test_divergence(spark, monkeypatch, groups, terms, pieces):
    """Also with cells so small that every language has many of them."""
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "PIECE", pieces)
    rows = [("en", f"s{i % 5}", f"The {'apple ' * (i % 3)}PEARÄ x{i % 4} {'ab' * (i % 7)} the") for i in range(40)]
    rows += [("en", "none", None), ("en", "blank", "1 2 3"), (None, None, "alone"), ("fr", "a", "mot"), ("fr", "b", "mot"), ("de", "x", "eins zwei")] + [("en", None, "pear the")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    got = [tuple(r) for r in divergence.divergence(docs, min_docs=3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_divergence(rows, 3)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_pairs_stand_either_way_round_in_a_cell(spark, monkeypatch):
    """A shuffle gives the groups of a cell in any order, which may differ from one term block to the next."""
    cell = divergence._cell
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "_cell", lambda t: cell(t.take(list(range(t.num_rows))[::-1 if t.column("tblock")[0].as_py() % 2 else 1])))
    rows = [("en", f"s{i % 4}", " ".join("abcdefghijklmnop"[i % 5:i % 13 + 3])) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [tuple(r) for r in divergence.divergence(docs, min_docs=3).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_divergence(rows, 3)


def test_shares_are_exact():
    import numpy as np
    n, total = np.array([0, 2, 7, 9 * 10**14, 123456789]), np.array([5, 3, 7, 9 * 10**15, 10**12])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]


def test_rows_of_one_doc_id_are_told_apart(spark, monkeypatch):
    """Equal and null doc_ids with other texts; every text joined, as for many keys, and only the marked ones."""
    shared = "".join(chr(97 + i * 7 % 26) for i in range(60)) * 9
    rows = [(5, "k" + shared[:520]), (5, "unlike " * 90), (7, shared[:520]), (None, "unlike " * 90), (None, "w " + shared[:430]), (None, None), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted(brute.suffix_dedup(rows), key=str)
    for most in (500_000, 0):
        monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", most)
        out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        rows_out = out.collect()
        assert sorted((tuple(r)[:5] for r in rows_out), key=str) == want
        assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in rows_out)


def test_decontamination_by_many_blocks_with_repeated_rows(spark):
    words = [f"w{i}" for i in range(300)]
    bench = [(i, " ".join(words[20 * i:20 * i + 15])) for i in range(12)] + [(3, "two words"), (None, " ".join(words[:14]))]
    rows = [(5, " ".join(words[:30])), (5, " ".join(words[:30])), (5, "x two words y " * 4), (None, " ".join(words[100:160])), (None, "clean text"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    seen = []
    for block in (10, 200, 1 << 20):
        out = decontaminate.find_contamination(docs, frame, carry=["doc_id"], block_bytes=block, shard_words=40)
        seen.append(sorted((str(tuple(r)) for r in out.selectExpr("row.doc_id", "n_words", "n_hit", "spans", "items", "contaminated").collect())))
    assert seen[0] == seen[1] == seen[2]
    assert len(decontaminate.stage_windows(frame, 13, 10)) > 4
