"""Evaluation texts leaking into training text.

Method: Wu-Manber multi-pattern search over word streams. Every window of ``window`` words of an
evaluation item is a pattern; a shift table over blocks of two words skips impossible positions,
buckets of the suffix block's hash select patterns, and direct comparison of all their words
confirms an occurrence. All lanes of a batch of texts move on together in numpy. The confirmed
occurrences of an item in a document are then chained in order: a document leaks an item if a
chain spans at least ``share`` of the item's words (and ``least_words``) with few changed words.

Words are runs of letters and digits in lower case without accents; punctuation, spacing, line
breaks, markup and invisible characters don't count. Words are compared by 64-bit values of all
their characters, so that two different words count as the same once in some 10^19 comparisons.
Sentences that at least ``common`` of all items share (and ``least_common`` items) are no part of an
item; they are counted over all items before these are cut into blocks, so that the answer doesn't
depend on the blocks.

Defined results: null and blank texts and items and rows without an id give nothing; items shorter than ``least_words``
can't leak; a repeated document or item counts for itself; empty tables give an empty result.
Whole texts are read. The items are a stated query set: they are gathered in blocks of
``block_items`` items, and all blocks are searched in one scan of the documents. The driver and each
worker hold one block at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GONE = re.compile("[\u00ad\u0300-\u036f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:[\s/][^<>]*)?>")
_ESCAPED = re.compile(r"\\[nrt](?![a-z]*:)")
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_CHARS = 1 << 20


def _folded(c: str) -> str:
    """A character in lower case, without accents and in its plain form; several characters for ligatures."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
    whole = unicodedata.normalize("NFKC", c).lower()
    return plain if len(plain) == 1 or len(whole) > 1 else whole


@lru_cache(maxsize=1)
def _char_values() -> tuple[np.ndarray, re.Pattern]:
    """A fixed random value of each character of the basic plane as folded, 0 for what isn't part of a word; and a pattern of the characters that fold to several or lie beyond that plane."""
    rnd = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 65536, dtype=np.uint64) | np.uint64(1)
    out, many = np.zeros(65537, np.uint64), []
    for code in range(65536):
        c = _folded(chr(code)) if not 0xD800 <= code < 0xE000 else ""
        if len(c) == 1 and c.isalnum():
            out[code] = rnd[min(ord(c), 65535)]
        elif len(c) > 1 and any(x.isalnum() for x in c):
            many.append(chr(code))
    return out, re.compile("[" + "".join(map(re.escape, many)) + "\U00010000-\U0010ffff]")


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(_BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([one, np.full(n, inverse, np.uint64)]), dtype=np.uint64)
    return up, down


def plain(text: str) -> str:
    """A text without markup tags, written-out line breaks and invisible characters."""
    if "\\" in text:
        text = _ESCAPED.sub("  ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return text
    return _char_values()[1].sub(lambda m: _folded(m[0]), _GONE.sub("", text))


Streams = tuple[np.ndarray, np.ndarray]


def word_stream(texts: list[str]) -> Streams:
    """(64-bit values of the words of all texts, index of each word's text), with a word of value 0 after each text."""
    texts = [plain(t) for t in texts]
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    values = _char_values()[0][np.minimum(codes, 65536)]
    for code in np.unique(codes[codes > 65535]).tolist():  # letters that are written beyond the basic plane alone
        if chr(code).isalnum():
            values[codes == code] = np.uint64((code * _BASE) & (2**63 - 1) | 1)
    inside = values != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]  # the last character ends no word
    up, down = _powers(1 << max(21, int(len(codes)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.cumsum(values * up[: len(values)], dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], 0).astype(np.uint64)
        words = (sums[ends - 1] - before) * down[starts]
        words ^= words >> np.uint64(31)
        words = (words * _M1) | np.uint64(1)
    closes = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    which = np.searchsorted(closes, starts)
    at = np.searchsorted(which, np.arange(len(texts)), side="right")
    return np.insert(words, at, 0), np.insert(which, at, np.arange(len(texts)))


class WuManber:
    """Search for many patterns of one length in streams of 64-bit words."""

    BLOCK = 2

    def __init__(self, patterns: np.ndarray):
        """patterns: one row of words for each pattern, all of them at least of two words and non-zero."""
        self.length = patterns.shape[1]
        self.bits = min(22, max(12, int(4 * max(1, len(patterns)) * self.length).bit_length()))
        self.shift = np.full(1 << self.bits, self.length - self.BLOCK + 1, np.uint8)
        for end in range(self.BLOCK - 1, self.length):
            slot = self._slot(self._block(patterns[:, end - 1], patterns[:, end]))
            np.minimum.at(self.shift, slot, np.uint8(self.length - 1 - end))
        suffix = self._block(patterns[:, -2], patterns[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.ids, suffix = patterns[order], order, suffix[order]
        self.buckets, self.bucket_at, self.bucket_size = np.unique(suffix, return_index=True, return_counts=True)

    @staticmethod
    def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = a * _M1 + (b ^ (b >> np.uint64(29))) * _M2
            return h ^ (h >> np.uint64(32))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((block * _M2) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, lane: int = 192) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern id) of every occurrence."""
        m, n = self.length, len(words)
        none = np.zeros(0, np.int64)
        if n < m or not len(self.ids):
            return none, none
        at = np.arange(m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        found = []
        while len(at):
            skip = self.shift[self._slot(self._block(words[at - 1], words[at]))]
            zero = skip == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(skip, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        ends = np.concatenate(found)
        block = self._block(words[ends - 1], words[ends])
        k = np.searchsorted(self.buckets, block)
        k[k == len(self.buckets)] = 0
        held = self.buckets[k] == block
        ends, k = ends[held], k[held]
        size = self.bucket_size[k]
        each = np.repeat(np.arange(len(k)), size)
        row = np.repeat(self.bucket_at[k], size) + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        first = ends[each] - (m - 1)
        for j in range(m):  # direct comparison, word by word
            same = words[first + j] == self.patterns[row, j]
            first, row = first[same], row[same]
        return first, self.ids[row]


def _sentences(passage: str) -> list[tuple[str, str]]:
    """(key, sentence) of each sentence; keys don't tell case, spacing and punctuation apart."""
    return [(" ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", s).lower())), s) for s in re.split(r"(?<=[.?!])\s+", passage.strip()) if s]


def shared_sentences(items: DataFrame, passage: str, common: float = 0.05, least_common: int = 4) -> frozenset[str]:
    """Keys of the sentences that at least common of the items (and least_common) hold.

    They are counted by Spark over all items; no more than 1 / common times the sentences of an
    item can be left, however many items there are.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": [k for p in batch[passage] for k in {k for k, _ in _sentences(p)}]}, dtype=object)

    every = items.where(F.col(passage).isNotNull()).select(passage)
    bound = max(least_common, common * every.count())
    return frozenset(r[0] for r in every.mapInPandas(keys, "key string").groupBy("key").count().where(F.col("count") >= bound).select("key").toLocalIterator())


def item_words(passages: list[str], shared: frozenset[str] = frozenset()) -> list[np.ndarray]:
    """The words of each passage without the shared sentences."""
    texts = [" ".join(s for k, s in _sentences(p) if k not in shared) for p in passages]
    words, which = word_stream(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = np.searchsorted(which, np.arange(len(texts) + 1))
    return [(w := words[at[i] : at[i + 1]])[w != 0] for i in range(len(texts))]


def _spans(k: np.ndarray, p: np.ndarray, m: int, reach: int, drift: int) -> list[tuple[int, int]]:
    """(item words from first to last, item words matched) of each chain of occurrences: k places in the text, p in the item, both ascending within runs."""
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    new = np.ones(len(k), bool)
    diagonal = k - p
    # runs of consecutive occurrences on one diagonal
    by = np.lexsort((k, diagonal))
    k, p, diagonal = k[by], p[by], diagonal[by]
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (k[1:] - k[:-1] > m)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(k)) - 1
    cover = np.add.reduceat(np.where(new, m, np.minimum(m, np.diff(k, prepend=k[0]))), at)
    runs = sorted(zip(k[at].tolist(), p[at].tolist(), k[last].tolist(), p[last].tolist(), cover.tolist(), strict=True))
    longest = max(b - a for a, _, b, _, _ in runs)
    best: list[tuple[int, int]] = []  # for each run: first item word of its chain, words matched
    out = []
    for x, (k0, p0, k1, p1, c) in enumerate(runs):
        mine = (p0, c)
        for y in range(x - 1, -1, -1):
            a0, _, a1, b1, _ = runs[y]
            if k0 - a0 > longest + reach:
                break
            dk, dp = k0 - a1, p0 - b1
            if 0 < dk <= reach and 0 < dp <= reach and abs(dk - dp) <= drift:
                total = best[y][1] + c - max(0, m - min(dk, dp))
                if total > mine[1]:
                    mine = (best[y][0], total)
        best.append(mine)
        out.append((p1 + m - mine[0], mine[1]))
    return out


class LeakSearch:
    """The search for one block of items, made on the driver and sent to the workers."""

    def __init__(self, ids: list, passages: list[str], shared: frozenset[str] = frozenset(), window: int = 4, share: float = 1 / 3, least_words: int = 10, matched: float = 0.5, reach: int = 16, drift: int = 8):
        self.window, self.share, self.least, self.matched, self.reach, self.drift = window, share, least_words, matched, reach, drift
        words = item_words(passages, shared)
        keep = [i for i, w in enumerate(words) if len(w) >= max(least_words, window)]
        self.ids = [ids[i] for i in keep]
        self.sizes = np.array([len(words[i]) for i in keep], np.int64)
        rows = [np.lib.stride_tricks.sliding_window_view(words[i], window) for i in keep]
        self.item = np.repeat(np.arange(len(keep)), self.sizes - window + 1)
        self.place = np.concatenate([np.arange(len(r)) for r in rows]) if rows else np.zeros(0, np.int64)
        self.machine = WuManber(np.concatenate(rows) if rows else np.zeros((0, window), np.uint64))
        # a chain lies within so many characters, markup and line breaks included
        self.extent = 1000 + 8 * max([len(p) for p in passages], default=0)

    def leaks(self, texts: list[str], streams: Streams | None = None) -> Iterator[tuple[int, object]]:
        """(index of the text, item id) of each leak; very long texts are searched in pieces that overlap by more than any chain."""
        long = [i for i, t in enumerate(texts) if len(t) > 4 * CHUNK_CHARS]
        if not long:
            yield from self._leaks(streams or word_stream(texts))
            return
        for i, text in enumerate(texts):
            step = max(CHUNK_CHARS, self.extent)
            pieces = [text[a : a + step + self.extent] for a in range(0, max(1, len(text)), step)] if i in long else [text]
            for item in dict.fromkeys(item for p in pieces for _, item in self._leaks(word_stream([p]))):
                yield i, item

    def _leaks(self, streams: Streams) -> Iterator[tuple[int, object]]:
        words, which = streams
        k, pattern = self.machine.search(words)
        if not len(k):
            return
        item, place, doc = self.item[pattern], self.place[pattern], which[k]
        pair = doc * len(self.ids) + item
        order = np.argsort(pair, kind="stable")
        pair, item, place, k = pair[order], item[order], place[order], k[order]
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        count = np.diff(np.append(at, len(pair)))
        need = np.maximum(self.least, np.ceil(self.share * self.sizes[item[at]] - 1e-9))
        # n occurrences match at most n times the window's words
        for a, n, least in zip(at, count, need, strict=True):
            if n * self.window < self.matched * least:
                continue
            for span, got in _spans(k[a : a + n], place[a : a + n], self.window, self.reach, self.drift):
                if span >= least and got >= max(self.least, self.matched * span):
                    yield int(pair[a] // len(self.ids)), self.ids[item[a]]
                    break


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about chars characters; a longer text is alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_items: int = 20_000, pass_chars: int = 16 << 20, **options) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item's passage or a long enough stretch of it.

    Each block is searched in about pass_chars characters of text before the next one is loaded.
    """
    kinds = {c: k for c, k in [*documents.dtypes, *items.dtypes]}
    schema = f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {kinds[item_id]}"
    sc = documents.sparkSession.sparkContext
    items = items.select(item_id, passage).where(F.col(passage).isNotNull() & F.col(item_id).isNotNull())
    shared = shared_sentences(items, passage)
    blocks, ids, passages = [], [], []
    for row in items.toLocalIterator():
        ids.append(row[0])
        passages.append(row[1])
        if len(ids) == block_items:
            blocks.append(sc.broadcast(LeakSearch(ids, passages, shared, **options)))
            ids, passages = [], []
    if ids or not blocks:
        blocks.append(sc.broadcast(LeakSearch(ids, passages, shared, **options)))

    def search(doc_ids: list, texts: list[str]) -> pd.DataFrame:
        parts = [(a, texts[a:b]) for a, b in chunks(texts)]
        # one block: its words are made chunk by chunk; several: made once and kept for all of them
        streams = [None] * len(parts) if len(blocks) == 1 else [word_stream(p) if len(p) > 1 or len(p[0]) <= 4 * CHUNK_CHARS else None for _, p in parts]
        out = []
        for block in blocks:
            machine = block.value
            out += [(doc_ids[a + i], item) for (a, p), s in zip(parts, streams, strict=True) for i, item in machine.leaks(p, s)]
            if len(blocks) > 1:
                del machine
                block.__dict__.pop("_value", None)  # a worker holds one block at a time
        return pd.DataFrame(list(dict.fromkeys(out)), columns=[doc_id, item_id]) if out else pd.DataFrame({doc_id: [], item_id: []}, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_ids, held, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch[doc_id].tolist(), batch[text].tolist(), strict=True):
                held_ids.append(i)
                held.append(t)
                size += len(t)
                if size >= pass_chars:
                    yield search(held_ids, held)
                    held_ids, held, size = [], [], 0
        if held:
            yield search(held_ids, held)

    return documents.select(doc_id, text).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).mapInPandas(run, schema)
