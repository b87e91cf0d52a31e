"""Hierarchical multi-length packing of tokenised documents.

Windows come in context tiers (powers of two). Documents are cut into pieces of
the longest tier; what remains of each is routed to the smallest tier that holds it. Tiers are packed
from the longest down: a window starts with the longest piece of its tier, its
gap is filled with the longest pieces that fit, from its own and shorter tiers, and
what is left then by the head of a shorter document's piece, whose tail goes on in a shorter
tier. At the end of a shard the rest is split into windows of smaller powers of two, so
nothing is padded. Windows are dealt into step groups of ``step_tokens`` tokens.

Scale: no shuffle; a task packs its own documents and holds at most about ``pool_tokens`` tokens
besides one document. Sequence and step ids are made of the partition
number and a count, so a task that runs again gives the same rows. A task's rest makes
windows shorter than the longest tier, at most one of each size.

Tokens: texts are taken about ``PIECE`` bytes at a time; Arrow finds the different words (between spaces or
line feeds) among them and parts each into a stem and the punctuation behind it. Stems are encoded once per worker and
remembered (at most ``CACHE`` of them); the pre-tokenizer never joins across a space, nor a letter or digit with
punctuation behind it, so this equals encoding the whole text (tested).

Defined cases: null or empty text is the end token alone; repeated rows are packed as
often as they stand; null doc_ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seika.llm.common import row_slices, texts_of

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 16 * 4096
POOL_TOKENS = 1 << 20
CACHE = 800_000
PIECE = 8 << 20
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_id long")
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


class Encoder:
    """Token ids of texts, by a tokenizer file.

    Arrow finds the different words of some texts (what stands between spaces or line feeds) and parts
    each into a stem, in lower case if it is ASCII, and the punctuation behind it. The stems that aren't known yet are
    encoded together, joined by spaces. The first ``CACHE`` stems stay known; later ones only for their texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.end = Tokenizer.from_file(path), np.array([end_id], np.uint32)
        # The same model for words of letters, joined by spaces: no pattern has to part them.
        self.letters = Tokenizer(self.tok.model)
        self.letters.normalizer = normalizers.Lowercase()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.tails: dict[int, bytes] = {0: b""}
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def _parted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words' stems, and the punctuation cut off behind each as a number (its bytes, 0 if there is none)."""
        # Behind a letter or digit ASCII punctuation is a token of its own, whatever stands before; at the end of a
        # word nothing ("'s", a mark) can follow that would part it. Names of special tokens are left alone.
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        data, offsets = texts_of(words)
        stops, size = offsets[1:], pc.binary_length(stems).to_numpy().astype(np.int64)
        length = np.diff(offsets) - size
        plain = ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cut = plain & (length > 0) & (length <= 8) & (size > 0)
        last = data[np.where(cut, stops - length - 1, 0)] if len(data) else np.zeros(len(words), np.uint8)
        for i in np.flatnonzero(cut & (last >= 128)).tolist():
            stem = stems[i].as_py()
            cut[i] = stem[-1].isalpha() and "\u0130" not in stem and is_normalized("NFC", stem)
        cut &= (last >= 128) | _ALNUM[last]
        tail = np.zeros(len(words), np.uint64)
        for k in range(int(length[cut].max(initial=0))):
            at = np.flatnonzero(cut & (length > k))
            tail[at] |= data[stops[at] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        stems = pc.if_else(pa.array(cut), stems, words)
        lower = pc.and_(pc.string_is_ascii(stems), pa.array(plain))
        return pc.if_else(lower, pc.ascii_lower(stems), stems), tail

    def _encode_words(self, words: list[str]) -> None:
        # A word of letters is one word of the tokenizer as well, but U+0130, which is lower-cased to a letter
        # and a mark, and what NFC changes: some letters (U+0958, U+FB1D, ...) become a letter and a mark too.
        plain, other = [], []
        tokenize, known = self.tok.model.tokenize, self.known
        for w in words:
            if not w.isalpha():
                other.append(w)
            elif w.isascii():  # in lower case: nothing to normalise or split
                known[w] = array("I", [t.id for t in tokenize(w)]).tobytes()
            else:
                (plain if "\u0130" not in w and is_normalized("NFC", w) else other).append(w)
        groups = [plain[i:i + 1000] for i in range(0, len(plain), 1000)]
        for own, e in zip(groups, self.letters.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own):
                self._know(own, ids, [0, *ends.tolist()])
            else:  # the tokenizer parts or joins some of these words
                other += own
        groups = [other[i:i + 1000] for i in range(0, len(other), 1000)]
        for own, e in zip(groups, self.tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            word_at = np.cumsum([0, *(len(w) + 1 for w in own)])
            token_at = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
            self._know(own, ids, np.searchsorted(token_at, word_at).tolist())

    def _know(self, words: list[str], ids: np.ndarray, cut: list[int]) -> None:
        raw = ids.tobytes()
        self.known.update(zip(words, (raw[4 * x:4 * y] for x, y in zip(cut, cut[1:], strict=False)), strict=True))

    def _tail(self, tail: int) -> bytes:
        if tail not in self.tails:
            text = tail.to_bytes(8, "big").lstrip(b"\0").decode()
            self.tails[tail] = np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.tails[tail]

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of each of some different words."""
        stems, tails = self._parted(words)
        stems, (tails, tail_at) = stems.dictionary_encode(), np.unique(tails, return_inverse=True)
        names = _strings(stems.dictionary)
        ids = list(map(self.known.get, names))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = [names[i] for i in missing]
        self._encode_words(new)
        for i, w in zip(missing, new, strict=True):
            ids[i] = self.known[w]
        ids += map(self._tail, tails.tolist())
        for w in new[max(0, CACHE - (len(self.known) - len(new))):]:
            del self.known[w]
        halves = np.stack((stems.indices.to_numpy(), tail_at + len(names)), axis=1).ravel()
        both = _lists(np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *map(len, ids)]) // 4).take(pa.array(halves))
        return _lists(both.flatten(), both.offsets.to_numpy()[::2])

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (without nulls) and the end id."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary).take(coded.indices)
        at = ids.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        flat = ids.flatten().to_numpy()
        return [np.concatenate((flat[lo:hi], self.end)) for lo, hi in zip(at, at[1:], strict=False)]

    def __call__(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the end id; works on about ``PIECE`` bytes at a time."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        for lo, hi in row_slices(texts_of(texts)[1], PIECE):
            own = texts.slice(lo, hi - lo)
            if hi - lo == 1 and pc.binary_length(own)[0].as_py() > PIECE:  # one long text
                parts = [self._encode(pa.array([x], pa.string()))[0][:-1] for x in _pieces(own[0].as_py())]
                yield np.concatenate([*parts, self.end])
            else:
                yield from self._encode(own)


def _strings(words: pa.Array) -> list[str]:
    """The strings of an array, none of which holds a line feed."""
    data, offsets = texts_of(words)
    out = np.full(len(data) + len(words), ord("\n"), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(words)), np.diff(offsets))] = data
    return out.tobytes().decode().split("\n")[:-1]


def _lists(values: np.ndarray | pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut at a space or line feed."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            ends = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
            end = min(ends) if ends else len(text)
        yield text[at:end]
        at = end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) of one task into windows."""

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.longest, self.step_tokens = sorted(tiers), max(tiers), step_tokens
        self.pool: dict[int, list] = {}
        self.lengths = 0  # bit n: there are pieces of n tokens
        self.tokens = 0
        self.next_seq = self.next_step = task << 40
        self.open_steps: list[list[int]] = []
        self.rows: list[tuple] = []

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool.setdefault(n, []).append(piece)
        self.lengths |= 1 << n
        self.tokens += n

    def _take(self, n: int) -> tuple:
        pieces = self.pool[n]
        piece = pieces.pop()
        if not pieces:
            del self.pool[n]
            self.lengths &= ~(1 << n)
        self.tokens -= n
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.longest:
            self._close(self.longest, [(doc_id, at, ids[at:at + self.longest], n)])
            at += self.longest
        if at < n:
            self._put((doc_id, at, ids[at:].copy(), n))

    def _head(self, n: int, size: int) -> tuple:
        """The first ``size`` tokens of a piece of ``n``; the tail goes back."""
        doc_id, start, ids, total = self._take(n)
        self._put((doc_id, start + size, ids[size:], total))
        return doc_id, start, ids[:size], total

    def _window(self, size: int) -> None:
        gap, pieces = size, []
        while gap:
            fits = self.lengths & ((1 << (gap + 1)) - 1)
            if fits:
                n = fits.bit_length() - 1
                pieces.append(self._take(n))
            else:
                n = (self.lengths & -self.lengths).bit_length() - 1  # the shortest there is
                pieces.append(self._head(n, gap))
                break
            gap -= n
        self._close(size, pieces)

    def pack(self, keep: int) -> None:
        """Closes full windows, longest tier first, until about ``keep`` tokens are left to fill gaps with."""
        while self.tokens > keep and self.tokens >= self.longest:
            n = self.lengths.bit_length() - 1
            self._window(next(t for t in self.tiers if t >= n))

    def finish(self) -> None:
        while self.tokens:
            n = self.lengths.bit_length() - 1
            tier = next(t for t in self.tiers if t >= n)
            self._window(tier if tier <= self.tokens else 1 << (self.tokens.bit_length() - 1))

    def _close(self, size: int, pieces: list[tuple]) -> None:
        step = next((s for s in self.open_steps if s[1] >= size), None)
        if step is None:
            step = [self.next_step, self.step_tokens]
            self.next_step += 1
            self.open_steps.append(step)
        step[1] -= size
        if not step[1]:
            self.open_steps.remove(step)
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_seq, at, size, step[0]))
            at += len(ids)
        self.next_seq += 1

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            for lo in range(0, len(self.rows), 2048):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows[lo:lo + 2048], strict=True), _TYPES, strict=True)], _NAMES)
            self.rows = []


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PIECE`` bytes or more: the more text at once, the fewer different words to look up."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PIECE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _pack(path: str | None, end_id: int, tiers: tuple[int, ...], step_tokens: int, pool_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path("word_bpe_49k.json")
        encode = _ENCODERS.get((file, end_id)) or Encoder(file, end_id)
        _ENCODERS[file, end_id] = encode  # the worker's next task goes on with the words known
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for b in _gathered(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                packer.add(doc_id, ids)
                if packer.tokens > pool_tokens:
                    packer.pack(pool_tokens // 4)
                yield from packer.batches(2048)
        packer.finish()
        yield from packer.batches(1)
    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS,
                   step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, tier (the window's length), step_id."""
    if any(t & (t - 1) for t in tiers) or step_tokens % max(tiers):
        raise ValueError("tiers must be powers of two that divide step_tokens")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_pack(tokenizer, end_id, tuple(tiers), step_tokens, pool_tokens), SCHEMA)
