"""A linear-chain conditional random field over word-shape features, in numpy.

Texts are split into tokens (runs of letters, runs of digits, single other characters) and every
token gets a word type and a shape. The shape of a word tells whether a public vocabulary writes it
in small letters, with a capital only, or not at all, so that names no training row holds still look
like names. Emissions are sums of rows of weight tables at the types around the token and at hashed
windows. Training maximises the conditional likelihood by forward-backward in padded batches, with
a share of the word types hidden in each epoch; decoding is Viterbi over padded batches of
stretches. A token is left out of the stretches only where no run of tokens around it can gain over
O, transitions included, so the decoded path is the best one.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
WINDOW_BITS = 15
PAD = 4  # blank tokens before and after each text
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)

# shapes of tokens: a word is in the vocabulary, there with a capital only (PROPER), or not there (RARE)
LOWER, LOWER_RARE, TITLE, TITLE_PROPER, TITLE_RARE, INITIAL, UPPER, UPPER_RARE, MIXED, DIGIT0 = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10  # digits of length n: 9 + min(n, 11)
PUNCT0, SHAPES = 21, 21 + 27
EXTRA = 3  # windows that hold a word's end or a word beside a shape
_PUNCT = {c: i for i, c in enumerate(".,-/()@+:;'\"#<>&[]{}_=%*\n")}  # others share the last shape


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the basic plane: class (0 blank, 1 letter, 2 digit, 3 other, 4 gone), folded code, upper-case flag, punctuation shape."""
    kind, fold = np.full(65537, 3, np.uint8), np.arange(65537, dtype=np.uint32)
    upper, punct = np.zeros(65537, np.uint8), np.full(65537, PUNCT0 + len(_PUNCT), np.uint8)
    for code in range(65536):
        c = chr(code)
        cat = unicodedata.category(c)
        if c == "\n":
            continue
        if c.isspace():
            kind[code] = 0
        elif cat[0] == "L" or cat[0] == "M":
            kind[code] = 1
        elif "0" <= c <= "9":
            kind[code] = 2
        elif cat == "Cf":
            kind[code] = 4
        low = c.lower()
        fold[code] = ord(low) if len(low) == 1 else code
        upper[code] = cat in ("Lu", "Lt")
    for c, i in _PUNCT.items():
        punct[ord(c)] = PUNCT0 + i
    return kind, fold, upper, punct


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one, base = np.ones(1, np.uint64), int(_M)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


@dataclass
class Tokens:
    """Tokens of many texts with PAD blank tokens after each; start and end are places in the joined texts."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray  # with glue to the previous token in bit 6
    word: np.ndarray  # 64-bit value of the folded text
    tail: np.ndarray  # the same of its last three characters
    text: np.ndarray  # index of the text
    offsets: np.ndarray  # place of each text in the joined texts


def _held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def word_values(words: list[str]) -> np.ndarray:
    """The sorted values of words that are single tokens."""
    nothing = np.zeros(0, np.uint64)
    t = tokenize(words, (nothing, nothing))
    return np.unique(t.word[(t.text >= 0)])


def tokenize(texts: list[str], lexicon: tuple[np.ndarray, np.ndarray]) -> Tokens:
    """lexicon: sorted values of the words a public vocabulary writes in small letters, and of those it writes with a capital only."""
    kind_of, fold, upper_of, punct = _classes()
    joined = "\n".join(texts) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.cumsum(lengths) - lengths
    kind = kind_of[codes]
    if (kind == 4).any():  # invisible characters belong to the token around them
        gone = np.flatnonzero(kind == 4)
        for i in gone.tolist():
            kind[i] = kind[i - 1] if i and kind[i - 1] in (1, 2) and i + 1 < len(kind) and kind[i + 1] == kind[i - 1] else 0
    begins = kind != 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    start = np.flatnonzero(begins)
    change = np.flatnonzero(np.append((kind[1:] != kind[:-1]) | (kind[1:] == 3), True)) + 1
    end = change[np.searchsorted(change, start, side="right")]
    up, down = _powers(1 << max(21, int(len(codes)).bit_length()))
    folded = fold[codes].astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.cumsum((folded * _M2 + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)
        before = np.where(start > 0, sums[start - 1], np.uint64(0))
        word = (sums[end - 1] - before) * down[start]
        word ^= word >> np.uint64(31)
        cut = np.maximum(end - 3, start)
        tail = (sums[end - 1] - np.where(cut > 0, sums[cut - 1], np.uint64(0))) * down[cut]
        tail ^= tail >> np.uint64(29)
    caps = np.concatenate([[0], np.cumsum(upper_of[codes], dtype=np.int64)])
    size, ups, first = end - start, caps[end] - caps[start], upper_of[codes[start]]
    k = kind[start]
    shape = np.where(
        k == 1,
        np.where(ups == 0, LOWER, np.where(ups == size, np.where(size == 1, INITIAL, UPPER), np.where((ups == 1) & (first == 1), TITLE, MIXED))),
        np.where(k == 2, DIGIT0 - 1 + np.minimum(size, 11), punct[codes[start]]),
    ).astype(np.int16)
    letters = np.flatnonzero((shape == LOWER) | (shape == TITLE) | (shape == UPPER))
    new = letters[~_held(word[letters], lexicon[0])]
    proper = _held(word[new], lexicon[1])
    shape[new] = np.select([shape[new] == LOWER, shape[new] == UPPER, proper], [LOWER_RARE, UPPER_RARE, TITLE_PROPER], TITLE_RARE)
    glue = np.zeros(len(start), np.int16)
    glue[1:] = end[:-1] == start[1:]
    text = np.searchsorted(offsets, start, side="right") - 1
    glue[start == offsets[text]] = 0  # nothing stands before a text
    # blank tokens after each text keep windows apart
    at = np.repeat(np.searchsorted(text, np.arange(len(texts)), side="right"), PAD)
    blank = lambda a, v: np.insert(a, at, v)
    head = lambda a, v: np.concatenate([np.full(PAD, v, a.dtype), blank(a, v)])
    out = Tokens(head(start, 0), head(end, 0), head((shape | (glue << 6)).astype(np.int16), 0), head(word, 0), head(tail, 0), np.empty(0), offsets)
    out.text = np.concatenate([np.full(PAD, -1), np.insert(text, at, -1)])
    return out


@dataclass
class Crf:
    """A trained model; everything in it is an array, so it travels to the workers as it is."""

    labels: list[str]  # "O", "B-kind", "I-kind", ...
    lexicon: tuple[np.ndarray, np.ndarray]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted word values of the vocabulary
    types: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0), np.float32))  # offset, type, label
    windows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0), np.float32))  # window, hash, label
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    # -- features
    def features(self, t: Tokens, hide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(type of each token, hashes of the windows of each token); both hold blank tokens too. hide: words that count by their shape alone."""
        shape = t.shape & 63
        if len(self.words):
            at = np.minimum(self._slot(t.word), len(self.words) - 1)
            known = (self.words[at] == t.word) & (shape <= MIXED) & (shape > 0)
            if hide is not None:
                known &= ~hide
        else:
            at, known = np.zeros(len(shape), np.int64), np.zeros(len(shape), bool)
        kinds = np.where(known, SHAPES + at, shape).astype(np.int32)
        s = (shape + (t.shape & 64)).astype(np.uint32)
        pad = np.zeros(len(s) + 4, np.uint32)
        pad[2:-2] = s
        a, b, c, d, e = (pad[i : len(s) + i] for i in range(5))
        mask = np.uint32((1 << WINDOW_BITS) - 1)
        beside = np.zeros(len(s) + 2, np.uint32)
        beside[1:-1] = kinds
        ends = np.where(shape <= MIXED, t.tail, np.uint64(0)).astype(np.uint32)

        def squeeze(x: np.ndarray) -> np.ndarray:
            x = x * np.uint32(0x9E3779B1)
            return ((x ^ (x >> np.uint32(15))) & mask).astype(np.int32)

        with np.errstate(over="ignore"):
            return kinds, np.stack([
                squeeze(a * np.uint32(16384) + b * np.uint32(128) + c),
                squeeze(b * np.uint32(16384) + c * np.uint32(128) + d),
                squeeze(c * np.uint32(16384) + d * np.uint32(128) + e),
                squeeze((a * np.uint32(16384) + b * np.uint32(128) + c) * np.uint32(0x85EBCA6B) + d * np.uint32(128) + e),
                (c & mask).astype(np.int32),
                squeeze(ends * np.uint32(128) + c),
                squeeze(beside[:-2] * np.uint32(128) + c),
                squeeze(beside[2:] * np.uint32(128) + c + np.uint32(0x5BD1E995)),
            ])

    def _slot(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, word)

    def emissions(self, kinds: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.types[0][kinds[at + OFFSETS[0]]]
        for i, o in enumerate(OFFSETS[1:], 1):
            out += self.types[i][kinds[at + o]]
        for i in range(len(self.windows)):
            out += self.windows[i][hashes[i][at]]
        return out

    # -- training
    @staticmethod
    def train(rows: list[tuple[str, list[tuple[int, int, str]]]], labels: list[str], lexicon: tuple[np.ndarray, np.ndarray], hidden_kinds: tuple[str, ...] = ("name", "email", "identity_number"), epochs: int = 8, least_count: int = 3, rate: float = 0.12, l2: float = 2e-6, hide: float = 0.3, seed: int = 1) -> Crf:
        """rows: (text, [(start, end, kind)]). Words seen within hidden_kinds get no place among the model's words by those sightings. hide: share of the words that count by their shape alone, drawn anew each epoch."""
        model = Crf(labels, lexicon)
        t = tokenize([r[0] for r in rows], model.lexicon)
        index = {name: i for i, name in enumerate(labels)}
        gold = np.zeros(len(t.start), np.int64)
        hidden = np.zeros(len(t.start), bool)
        real = np.flatnonzero(t.text >= 0)
        for r, (_, spans) in enumerate(rows):
            for a, b, kind in spans:
                lo, hi = np.searchsorted(t.start[real], [a + t.offsets[r], b + t.offsets[r]])
                gold[real[lo:hi]] = index["I-" + kind]
                gold[real[lo]] = index["B-" + kind]
                hidden[real[lo:hi]] |= kind in hidden_kinds
        letters = (t.shape & 63 <= MIXED) & (t.text >= 0) & ~hidden
        seen, count = np.unique(t.word[letters], return_counts=True)
        model.words = seen[count >= least_count]
        size, n = len(labels), SHAPES + len(model.words)
        model.types = np.zeros((len(OFFSETS), n, size), np.float32)
        model.windows = np.zeros((5 + EXTRA, 1 << WINDOW_BITS, size), np.float32)
        model.moves = np.zeros((size, size), np.float32)
        firsts = np.searchsorted(t.text[real], np.arange(len(rows)))
        lasts = np.searchsorted(t.text[real], np.arange(len(rows)), side="right")
        squares = [np.full_like(x, 1e-3) for x in (model.types, model.windows, model.moves)]
        rng = np.random.Generator(np.random.PCG64(seed))
        lengths = lasts - firsts
        usable = np.flatnonzero(lengths > 0)
        for epoch in range(epochs):
            kinds, hashes = model.features(t, rng.random(len(t.word)) < hide)
            order = usable[np.lexsort((rng.random(len(usable)), (lengths[usable] + rng.integers(0, 12, len(usable))) // 8))]
            batches = [order[i : i + 48] for i in range(0, len(order), 48)]
            for j in rng.permutation(len(batches)):
                batch = batches[j]
                width = int(lengths[batch].max())
                grid = np.minimum(firsts[batch][:, None] + np.arange(width)[None, :], len(real) - 1)
                live = np.arange(width)[None, :] < lengths[batch][:, None]
                at = real[grid]
                model._step(at, live, gold[at], kinds, hashes, squares, rate / (1 + 0.3 * epoch), l2)
            if epoch >= epochs // 2:  # the mean of the later epochs' weights generalises better than the last
                kept = [model.types.copy(), model.windows.copy(), model.moves.copy()] if epoch == epochs // 2 else [k + w for k, w in zip(kept, (model.types, model.windows, model.moves), strict=True)]
        n = np.float32(max(1, epochs - epochs // 2))
        model.types, model.windows, model.moves = (k / n for k in kept)
        return model

    def _step(self, at, live, gold, kinds, hashes, squares, rate, l2) -> None:
        b, width = at.shape
        size = len(self.labels)
        e = self.emissions(kinds, hashes, at.ravel()).reshape(b, width, size).astype(np.float64)
        m = self.moves.astype(np.float64)
        em = np.exp(m)
        # forward and backward, scaled; a dead place passes its message on
        top = e.max(-1, keepdims=True)
        p = np.exp(e - top)
        alpha, beta = np.zeros((b, width, size)), np.ones((b, width, size))
        start = np.exp(m[0])  # a text starts after an O
        f = p[:, 0] * start
        alpha[:, 0] = f / f.sum(-1, keepdims=True)
        for i in range(1, width):
            f = (alpha[:, i - 1] @ em) * p[:, i]
            alpha[:, i] = np.where(live[:, i, None], f / f.sum(-1, keepdims=True), alpha[:, i - 1])
        for i in range(width - 2, -1, -1):
            g = (beta[:, i + 1] * p[:, i + 1]) @ em.T
            beta[:, i] = np.where(live[:, i + 1, None], g / g.sum(-1, keepdims=True), 1.0)
        q = alpha * beta
        q /= q.sum(-1, keepdims=True)
        grad = -q
        grad[np.arange(b)[:, None], np.arange(width)[None, :], gold] += 1
        grad *= live[..., None]
        pair = alpha[:, :-1, :, None] * em * (p[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((-1, -2), keepdims=True)
        both = live[:, 1:]
        moves = -(pair * both[..., None, None]).sum((0, 1))
        np.add.at(moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        moves[0] -= q[:, 0].sum(0)
        np.add.at(moves[0], gold[:, 0], 1)
        flat, rows = grad[live], at[live]
        update = lambda w, s, i, g: self._adagrad(w, s, i, g, rate, l2)
        for o, shift in enumerate(OFFSETS):
            update(self.types[o], squares[0][o], kinds[rows + shift], flat)
        for o in range(len(self.windows)):
            update(self.windows[o], squares[1][o], hashes[o][rows], flat)
        squares[2] += moves.astype(np.float32) ** 2
        self.moves += (rate * moves / np.sqrt(squares[2])).astype(np.float32)

    @staticmethod
    def _adagrad(weights, squares, rows, grad, rate, l2) -> None:
        which, inverse = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(inverse, grad[:, y], len(which)) for y in range(grad.shape[1])], 1)
        total -= l2 * weights[which]
        squares[which] += total.astype(np.float32) ** 2
        weights[which] += (rate * total / np.sqrt(squares[which])).astype(np.float32)

    # -- decoding
    def decode(self, t: Tokens) -> np.ndarray:
        """The label of each token (0 for blanks)."""
        kinds, hashes = self.features(t)
        n = len(kinds)
        out = np.zeros(n, np.int8)
        if n <= 2 * PAD:
            return out
        every = np.arange(PAD, n - PAD)
        emissions = self.emissions(kinds, hashes, every)
        # the most that any label gains over O at a token, the move to it included
        m = self.moves - self.moves[0, 0]
        real = t.text >= 0
        gain = np.full(n, -1e6)
        best = (emissions[:, 1:] + m[:, 1:].max(0)).max(1) - emissions[:, 0]
        gain[PAD:-PAD] = np.where(real[PAD:-PAD], best, -1e6)
        # the best run of tokens that holds each one must gain, with the move back to O
        total = np.cumsum(gain)
        before = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        behind = np.maximum.accumulate(total[::-1])[::-1]
        inside = (behind - before + float(m[1:, 0].max()) > -1e-3) & real
        places = np.flatnonzero(inside)
        if not len(places):
            return out
        opens = np.ones(len(places), bool)
        opens[1:] = np.diff(places) > 1
        first = np.flatnonzero(opens)
        size = np.diff(np.append(first, len(places)))
        emissions = emissions[places - PAD]
        labels = np.zeros(len(places), np.int8)
        order = np.argsort(size, kind="stable")
        done = 0
        while done < len(order):  # batches of stretches of like length
            width = int(size[order[min(len(order) - 1, done + 255)]])
            count = max(1, min(len(order) - done, 400_000 // max(1, width)))
            batch = order[done : done + count]
            done += count
            self._viterbi(emissions, labels, first[batch], size[batch])
        out[places] = labels
        return out

    def _viterbi(self, emissions: np.ndarray, labels: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        width, b, k = int(size.max()), len(first), len(self.labels)
        moves = self.moves.T.copy()  # to, from
        back = np.zeros((width, b, k), np.int8)
        score = emissions[first] + self.moves[0]
        for i in range(1, width):
            live = size > i
            rows = np.flatnonzero(live)
            s = score[rows][:, None, :] + moves[None]
            best = s.argmax(-1)
            back[i, rows] = best
            score[rows] = np.take_along_axis(s, best[..., None], -1)[..., 0] + emissions[first[rows] + i]
        y = (score + self.moves[:, 0]).argmax(-1)  # after the stretch comes an O
        rows = np.arange(b)
        for i in range(width - 1, -1, -1):
            live = rows[size > i]
            labels[first[live] + i] = y[live]
            inside = live[size[live] > i] if i else live[:0]
            if i:
                y[inside] = back[i, inside, y[inside]]

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, str]]:
        """(index of the text, start, end, kind) of each decoded entity, in order."""
        t = tokenize(texts, self.lexicon)
        y = self.decode(t)
        at = np.flatnonzero(y)
        out = []
        last = None
        for i in at.tolist():
            head, _, kind = self.labels[y[i]].partition("-")
            if last is not None and head == "I" and last[0] == i - 1 and last[4] == kind:
                last[0], last[3] = i, int(t.end[i])
            else:
                last = [i, int(t.text[i]), int(t.start[i]), int(t.end[i]), kind]
                out.append(last)
        return [(x, a - int(t.offsets[x]), b - int(t.offsets[x]), kind) for _, x, a, b, kind in out]
