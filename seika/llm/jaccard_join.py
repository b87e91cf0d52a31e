"""N-gram Jaccard join: documents whose sets of word 5-grams are similar.

A document's set holds the 64-bit hashes of its distinct shingles, sorted. Two
sets link when 100 * |intersection| >= PERCENT * |union|.

1. Equal sets (128-bit hash of the sorted array) are one class with the smallest doc_id as
   representative; each class has a parity bitmap (bit = hash mod m) of two to four bits a shingle.
2. Similar sets share one of their |x| - ceil(0.75 |x|) + 1 first shingles in any
   common order. The order is: shingles common in the corpus last, then by hash, so
   the postings (shingle, class) of common passages stay out.
3. First round: each posting list is compared in size-banded tiles (each band of a
   factor 4/3 with itself and the next, in blocks; a short list is one tile) by its
   bitmaps, and gives a maximum spanning forest of estimated similarity, so a group of
   near copies gives as many pairs as it has members. Components are made of the pairs that link.
4. Second round, over the lists that still hold several components: the same tiles,
   all pairs of different components, so no link between components is lost.
5. In both rounds a pair is dropped if its sizes, or the bit count of the XOR of its
   bitmaps (a lower bound of the symmetric difference, so an upper one of the overlap), rule it out; what is left is decided
   by the exact intersection of the sorted arrays.

Scale: postings of 16 bytes, about a quarter of the shingles; only lists of
two classes or more go on, one for each set of members. Common shingles are found by lossy counting over all
documents; they change the order, never the result. Lists of common shingles are gathered in salted parts. Verification sends each array once for each partner group it is
compared in; a group's base array goes before its members, and large groups are split by salts. No task holds a group's arrays.

Defined cases: null or wordless text has an empty set, linked with nothing; fewer than five words are one
shingle; a null doc_id is its own row with a null component and takes no part; rows that share a doc_id but
not a text are one node, linked with whatever either is similar to.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seika.llm.common import mix64, row_slices, texts_of, word_hashes
from seika.llm.components import components
from seika.session import stage

PERCENT = 75
WORDS = 5
PIECE = 4 << 20
# Common shingles: counted COMMON_IN_PART times in one buffer of documents, COMMON in all; at most COMMON_MOST are kept.
COMMON_IN_PART, COMMON, COMMON_MOST = 8, 64, 200_000
BUFFER = 1 << 21
# Parts of a common shingle's list; classes of a block.
SALTS, BLOCK = 64, 2048
GROUP = 2000
# Lists of so few classes are compared without arrays.
FEW = 16
BROADCAST_ROWS = 200_000
_ROLL = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(WORDS)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in row_slices(offsets, PIECE):
        at = offsets[lo:hi + 1]
        words, counts = word_hashes(data[at[0]:at[-1]], at - at[0])
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            rolled = np.zeros(n, np.uint64)
            for k in range(WORDS):
                rolled = (rolled + words[k:k + n]) * _ROLL[1]
            rolled = mix64(rolled)
        else:
            rolled = np.zeros(0, np.uint64)
        first = 0
        for c in counts.tolist():
            if c >= WORDS:
                yield np.unique(rolled[first:first + c - WORDS + 1])
            elif c:
                h = np.uint64(c)
                with np.errstate(over="ignore"):
                    for w in words[first:first + c]:
                        h = (h + w) * _ROLL[2]
                yield mix64(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            first += c


def bitmap_of(s: np.ndarray) -> bytes:
    """Parity bitmap; the number of bits is the power of two from twice the set's size on, 64 to 16,384."""
    m = 1 << min(14, max(6, int(2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s >> np.uint64(11)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()


def links(na: int, nb: int, both: int) -> bool:
    return 100 * both >= PERCENT * (na + nb - both)


_SIG = "doc_id long, n long, k0 long, k1 long, bitmap binary, common long, times long"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SIG.split(", ")]
    buffer: list[np.ndarray] = []
    size = 0

    def common() -> pa.RecordBatch:
        nonlocal buffer, size
        value, times = np.unique(np.concatenate(buffer), return_counts=True)
        often = times >= COMMON_IN_PART
        n = int(often.sum())
        buffer, size = [], 0
        nothing = lambda t: pa.nulls(n, t)
        return pa.record_batch([nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.binary()),
                                pa.array(value[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names)

    for b in batches:
        n, k0, k1, bits = [], [], [], []
        for s in shingle_sets(*texts_of(b.column(1))):
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None)
            n.append(len(s))
            k0.append(digest[0])
            k1.append(digest[1])
            bits.append(bitmap_of(s) if len(s) else None)
            buffer.append(s)
            size += len(s)
        rows = b.num_rows
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(k0, pa.int64()), pa.array(k1, pa.int64()),
                               pa.array(bits, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
        if size >= BUFFER:
            yield common()
    if size:
        yield common()


def prefix_of(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles one of which a similar set must share: uncommon ones first."""
    p = len(s) - -(-PERCENT * len(s) // 100) + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    is_common = common[at] == s
    rare = s[~is_common]
    return rare[:p] if len(rare) >= p else np.concatenate((rare, s[is_common][:p - len(rare)]))


def _postings(common: np.ndarray):
    """(h, salt, k0, n): one row for each prefix shingle of each different set a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            hs, owner, size = [], [], []
            for s in shingle_sets(*texts_of(b.column(0))):
                if not len(s):
                    continue
                k0 = int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)[0])
                if k0 in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()  # a set that comes again is merely posted again
                seen.add(k0)
                p = prefix_of(s, common)
                hs.append(p)
                owner.append(np.full(len(p), k0, np.int64))
                size.append(np.full(len(p), len(s), np.int32))
            if not hs:
                continue
            h, k0, n = np.concatenate(hs), np.concatenate(owner), np.concatenate(size)
            salt = np.zeros(len(h), np.int32)
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                hot = common[at] == h
                salt[hot] = 1 + (k0[hot] % SALTS).astype(np.int32)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(salt), pa.array(k0), pa.array(n)], ["h", "salt", "k0", "n"])
    return run


_LIST = "g0 long, g1 long, band int, k0 long, n int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's postings: those whose (h, salt) holds two sets or more, all
    of salted ones. A list is named by its
    members (128 bits), as shingles of one passage have equal lists and one of them is
    enough; a salted list by its shingle."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    t = pa.Table.from_batches(read)
    del read
    h, salt, k0, n = (t.column(c).to_numpy() for c in ("h", "salt", "k0", "n"))
    del t
    # Most shingles stand alone: sort by h first and go on with the others.
    order = np.argsort(h, kind="quicksort")
    same = np.diff(h[order]) == 0
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    keep |= salt[order] > 0
    order = order[keep]
    h, salt, k0, n = h[order], salt[order], k0[order], n[order]
    if not len(h):
        return
    band = (np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int32)
    order = np.lexsort((k0, band, salt, h))
    h, salt, k0, n, band = (x[order] for x in (h, salt, k0, n, band))
    once = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(salt) != 0) | (np.diff(k0) != 0) | (np.diff(band) != 0)))
    h, salt, k0, n, band = (x[once] for x in (h, salt, k0, n, band))
    list_new = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(salt) != 0)))
    begin = np.flatnonzero(list_new)
    group = np.cumsum(list_new) - 1
    hot = salt[begin] > 0
    name = np.empty((len(begin), 2), np.int64)
    for i, seed in enumerate((np.uint64(0x51), np.uint64(0xA7))):
        name[:, i] = np.add.reduceat(mix64(mix64(k0.view(np.uint64) + seed)), begin).view(np.int64)
    name[hot, 0], name[hot, 1] = h[begin][hot], -1
    kept = np.zeros(len(begin), bool)
    kept[np.unique(name, axis=0, return_index=True)[1]] = True
    kept &= np.bincount(group) > 1
    many = (kept | hot)[group]
    out = [x[many] for x in (name[group, 0], name[group, 1], band, k0, n)]
    for lo in range(0, len(out[0]), 50_000):
        yield pa.record_batch([pa.array(x[lo:lo + 50_000]) for x in out], [x.split()[0] for x in _LIST.split(", ")])


def _forest(score: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a maximum spanning forest of the components in ``left``
    (rows) and ``right`` (columns), by Boruvka's rounds; -inf is no edge."""
    names = {c: i for i, c in enumerate(np.unique(np.concatenate((left, right))).tolist())}
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    l0, r0 = (np.array([names[c] for c in y.tolist()]) for y in (left, right))
    edges = []
    while True:
        top = np.array([root(i) for i in range(len(parent))])
        lc, rc = top[l0], top[r0]
        open_ = np.where(lc[:, None] == rc[None, :], -np.inf, score)
        best: dict[int, tuple[float, int, int]] = {}
        for axis, comp in ((1, lc), (0, rc)):
            other = open_.argmax(axis=axis)
            value = open_.max(axis=axis)
            for i in np.flatnonzero(value > -np.inf).tolist():
                j = int(other[i])
                edge = (float(value[i]), i, j) if axis else (float(value[i]), j, i)
                if edge > best.get(int(comp[i]), (-np.inf, 0, 0)):
                    best[int(comp[i])] = edge
        if not best:
            return edges
        for _, i, j in sorted(set(best.values()), reverse=True):
            a, b = root(l0[i]), root(r0[j])
            if a != b:
                parent[b] = a
                edges.append((i, j))


def _allowed_pairs(left: list, right: list, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of (rep, component, n, bitmap) rows of different components that sizes and bitmaps allow; with ``forest`` a
    maximum spanning forest of them by estimated similarity."""
    if left is right and len(left) <= FEW:
        yield from _few_pairs(left, forest)
        return
    pick = lambda rows, k: np.array([x[k] for x in rows], np.int64)
    reps, comps, sizes = ([pick(rows, k) for rows in (left, right)] for k in range(3))
    score = np.full((len(left), len(right)), -np.inf, np.float32)
    widths = [pick([(len(x[3]),) for x in rows], 0) for rows in (left, right)]
    for m in np.unique(widths[0]):
        for m2 in np.unique(widths[1]):
            i, j = np.flatnonzero(widths[0] == m), np.flatnonzero(widths[1] == m2)
            w = min(m, m2)
            fold = lambda rows, k: np.bitwise_xor.reduce(np.stack([np.frombuffer(rows[x][3], np.uint8) for x in k]).reshape(len(k), -1, w), axis=1).view(np.uint64)  # noqa: E731, B023
            a, b = fold(left, i), fold(right, j)
            step = max(1, (4 << 20) // max(1, w * len(j)))
            for lo in range(0, len(i), step):
                k = i[lo:lo + step]
                differ = np.bitwise_count(a[lo:lo + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                na, nb = sizes[0][k][:, None], sizes[1][j][None, :]
                total = na + nb
                most = np.minimum((total - differ) // 2, np.minimum(na, nb))
                ok = (100 * most >= PERCENT * (total - most)) & (comps[0][k][:, None] != comps[1][j][None, :])
                guess = -4.0 * w * np.log(np.maximum(1 - differ / (4.0 * w), 1e-3))  # of the symmetric difference
                score[np.ix_(k, j)] = np.where(ok, (total - guess) / (total + guess), -np.inf)
    edges = _forest(score, comps[0], comps[1]) if forest else zip(*(x.tolist() for x in np.nonzero(score > -np.inf)), strict=True)
    for i, j in edges:
        x, y = int(reps[0][i]), int(reps[1][j])
        yield min(x, y), max(x, y)


def _folded(bitmap: bytes, width: int) -> int:
    n, x = len(bitmap), int.from_bytes(bitmap)
    while n > width:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return x


def _few_pairs(rows: list, forest: bool) -> Iterator[tuple[int, int]]:
    """``_allowed_pairs`` of a short list with itself, without arrays."""
    edges = []
    for i, (rep, comp, n, bitmap) in enumerate(rows):
        for rep2, comp2, n2, bitmap2 in rows[:i]:
            total = n + n2
            if comp == comp2 or 100 * min(n, n2) < PERCENT * max(n, n2):
                continue
            w = min(len(bitmap), len(bitmap2))
            differ = (_folded(bitmap, w) ^ _folded(bitmap2, w)).bit_count()
            most = min((total - differ) // 2, n, n2)
            if 100 * most >= PERCENT * (total - most):
                guess = -4.0 * w * math.log(max(1 - differ / (4.0 * w), 1e-3))
                edges.append(((total - guess) / (total + guess), rep, rep2, comp, comp2))
    edges.sort(reverse=True)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    for _, rep, rep2, comp, comp2 in edges:
        if forest:
            a, b = root(comp), root(comp2)
            if a == b:
                continue
            parent[a] = b
        yield min(rep, rep2), max(rep, rep2)


def _tiles(forest: bool):
    """Pairs of each tile. Rows come sorted by tile; ``side`` 0: a block with itself, 1 and 2: the two sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def close(sides: tuple[list, list, list]) -> None:
            if sides[0]:
                found.update(_allowed_pairs(sides[0], sides[0], forest))
            elif sides[1] and sides[2]:
                found.update(_allowed_pairs(sides[1], sides[2], forest))

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = list(found)
            found.clear()
            for lo in range(0, len(pairs), 50_000):
                part = pairs[lo:lo + 50_000]
                yield pa.record_batch([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["a", "b"])

        tile, sides = None, ([], [], [])
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("g0", "g1", "tile", "side", "rep", "component", "n", "bitmap")]
            for g0, g1, t, side, rep, comp, n, bits in zip(*cols, strict=True):
                if (g0, g1, t) != tile:
                    close(sides)
                    tile, sides = (g0, g1, t), ([], [], [])
                    if len(found) > 500_000:
                        yield from flush()
                sides[side].append((rep, comp, n, bits))
        close(sides)
        yield from flush()
    return run


def _tile_pairs(labelled: DataFrame, reps: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of representatives from the lists that hold several components.
    ``labelled``: g0, g1, band, rep, n, component."""
    key = ["g0", "g1"]
    mixed = (labelled.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
             .where("lo <> hi").select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    rest = labelled.join(mixed, key).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    # A list of one block is one tile. A longer one has tiles (band, block) x (band or the next, block);
    # each row goes to the tiles of its band and of the one below.
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    b = lambda x, y, bx, by: F.concat_ws(":", x, bx, y, by)
    same = F.transform(others, lambda o: F.struct(
        b(F.col("band"), F.col("band"), F.least(F.col("block"), o), F.greatest(F.col("block"), o)).alias("tile"),
        F.when(o == F.col("block"), 0).when(o > F.col("block"), 1).otherwise(2).alias("side")))
    up = F.transform(others, lambda o: F.struct(b(F.col("band"), F.col("band") + 1, F.col("block"), o).alias("tile"), F.lit(1).alias("side")))
    down = F.transform(others, lambda o: F.struct(b(F.col("band") - 1, F.col("band"), o, F.col("block")).alias("tile"), F.lit(2).alias("side")))
    whole = F.array(F.struct(F.lit("").alias("tile"), F.lit(0).alias("side")))
    tiles = rest.withColumn("t", F.explode(F.when(F.col("blocks") == 1, whole).otherwise(F.concat(same, up, down)))).select(
        *key, "t.tile", "t.side", "rep", "component", F.col("n").cast("long").alias("n"))
    tiles = tiles.join(reps.select("rep", "bitmap"), "rep")
    return tiles.repartition(*key, "tile").sortWithinPartitions(*key, "tile", "side").mapInArrow(_tiles(forest), "a long, b long").distinct()


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each needed document's array, once for each group it is compared in."""
    for b in batches:
        want = b.column("want").to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for s, k0, rep, groups in zip(shingle_sets(*texts_of(b.column("text"))), b.column("k0").to_pylist(), b.column("rep").to_pylist(), want, strict=True):
            raw = s.tobytes()
            if int(np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64)[0]) != k0:
                continue  # another row of the same doc_id
            for g in groups:
                for c, v in zip(out, (g["base"], g["salt"], g["role"], rep, raw), strict=True):
                    c.append(v)
                if sum(map(len, out[4][-1:])) and len(out[0]) >= 256:
                    yield _sent(out)
                    out = ([], [], [], [], [])
        if out[0]:
            yield _sent(out)


def _sent(out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["base", "salt", "role", "rep", "array"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's base (role 0) comes first, then its members; exact intersections."""
    group, bases = None, []
    for b in batches:
        left, right = [], []
        for base, salt, role, rep, raw in zip(*(b.column(c).to_pylist() for c in ("base", "salt", "role", "rep", "array")), strict=True):
            if (base, salt) != group:
                group, bases = (base, salt), []
            s = np.frombuffer(raw, np.uint64)
            if role == 0:
                bases.append((rep, s))
                continue
            for other, t in bases:
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if other != rep and links(len(s), len(t), int((large[at] == small).sum())):
                    left.append(other)
                    right.append(rep)
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose exact sets link."""
    pairs = stage(pairs, "jaccard-pairs")
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    salted = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    member = salted.select(F.col("b").alias("rep"), F.struct(F.col("a").alias("base"), "salt", F.lit(1).alias("role")).alias("g"))
    base = size.select(F.col("a").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "a").select(
        "rep", F.struct(F.col("a").alias("base"), "salt", F.lit(0).alias("role")).alias("g"))
    want = (member.unionByName(base).groupBy("rep").agg(F.collect_list("g").alias("want"))
            .join(reps.select("rep", "k0"), "rep"))
    want = stage(want, "jaccard-want")
    if want.count() <= BROADCAST_ROWS and pairs.count() <= 4 * BROADCAST_ROWS:
        want = F.broadcast(want)  # at most 200,000 rows and 800,000 pairs; beyond that Spark shuffles the texts
    sent = docs.select("doc_id", "text").join(want, F.col("doc_id") == F.col("rep")).select("text", "k0", "rep", "want").mapInArrow(
        _send, "base long, salt int, role int, rep long, array binary")
    grouped = sent.repartition("base", "salt").sortWithinPartitions("base", "salt", "role")
    return grouped.mapInArrow(_verify, "a long, b long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(own.mapInArrow(_signatures, _SIG), "jaccard-sets")
    sets = found.where("common IS NULL")
    counted = (found.where("common IS NOT NULL").groupBy("common").agg(F.sum("times").alias("times"))
               .where(F.col("times") >= COMMON).orderBy(F.desc("times"), "common").limit(COMMON_MOST))
    common = np.sort(np.array([r["common"] for r in counted.select("common").collect()], np.int64).view(np.uint64))
    members = sets.where("doc_id IS NOT NULL AND n > 0")
    reps = stage(members.groupBy("k0", "k1").agg(F.min("doc_id").alias("rep"), F.first("n").cast("long").alias("n"), F.first("bitmap").alias("bitmap")), "jaccard-classes")

    posted = own.where("doc_id IS NOT NULL").select("text").mapInArrow(_postings(common), "h long, salt int, k0 long, n int")
    lists = stage(stage(posted.repartition("h", "salt").mapInArrow(_lists, _LIST), "jaccard-lists").distinct(), "jaccard-lists")
    listed = stage(lists.join(reps.select("k0", "rep"), "k0").drop("k0"), "jaccard-listed")
    pairs = _tile_pairs(listed.withColumn("component", F.col("rep")), reps, True)
    # Rows that share a doc_id but not a set: their classes belong together.
    shared = (members.select("doc_id", "k0", "k1").distinct().join(reps.select("k0", "k1", "rep"), ["k0", "k1"])
              .groupBy("doc_id").agg(F.collect_set("rep").alias("r")).where(F.size("r") > 1)
              .select(F.array_min("r").alias("a"), F.explode("r").alias("b")).where("a <> b"))
    first = stage(_verified(own, reps, pairs).distinct().unionByName(shared), "jaccard-links")
    grouped = components(first)

    # Second round: lists that still hold several components.
    labelled = (listed.join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left")
                .withColumn("component", F.coalesce("component", "rep")))
    pairs = _tile_pairs(stage(labelled, "jaccard-listed"), reps, False)
    second = stage(_verified(own, reps, pairs), "jaccard-links")
    final = components(first.unionByName(second.where("a <> b"))) if second.limit(1).count() else grouped
    classes = (reps.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
               .select(F.col("k0").alias("c0"), F.col("k1").alias("c1"), F.coalesce("component", "rep").alias("component")))
    return (sets.join(classes, (F.col("k0") == F.col("c0")) & (F.col("k1") == F.col("c1")), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; same
    columns. Rows with a null doc_id stay; of rows that share a kept doc_id all stay."""
    gone = jaccard_join(docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")


# Sets, pairs and components in SQL; quadratic in pairs that share a shingle, so for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                               ELSE array_to_string(words[i:i + 4], ' ') END) AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * both >= 75 * (x.n + y.n - both)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1) c ON c.node = documents.doc_id
"""
