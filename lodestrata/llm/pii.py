"""Personal information inside free text.

Method: a linear-chain conditional random field over word-shape features (``crf``), trained on the
driver from a small labelled table (``pii_examples``, of fixed size) and decoded by Viterbi in numpy
batches. An exact check settles the ends of each decoded span and drops what its kind can't be; it
finds nothing by itself.

Defined results: null, empty and blank texts and rows without an id give nothing; repeated rows give their spans again
(`find_pii` keeps rows distinct by id); positions count characters from 0 and never overlap; whole
texts of any length are read; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.crf import Crf, word_values
from lodestrata.llm.pii_examples import FRENCH_TITLES, KINDS, TITLES, labelled_rows
from lodestrata.llm.tokens import DEFAULT_VOCABULARY, encoding

CHUNK_CHARS, CONTEXT = 1 << 20, 1000

_AT = r"(?:\s?@\s?|&#64;|&commat;|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"[\w.+%'-]*[\w+]{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_LOCAL = re.compile(r"[\w.+%'-]+")
_AT_BEFORE = re.compile(rf"{_AT}$", re.I)
_PHONE_REST = re.compile(r"\d*(?:[./-]\d+)*")
_NUMBER_REST = re.compile(r"\w*(?:[./-]\w*\d\w*)*")
_TITLE = re.compile(rf"(?:{'|'.join(re.escape(t) for t in sorted({*TITLES, *FRENCH_TITLES} - {'M.'}, key=len, reverse=True))})\s+")
_LOGIN_AFTER = re.compile(r":[\w.~-]*/|/[\w.~-]+/")


#: Public vocabularies that tell common words from names; the files lie beside the default one.
VOCABULARIES = (DEFAULT_VOCABULARY, os.path.join(os.path.dirname(DEFAULT_VOCABULARY), "byte_bpe_multi_50k.tiktoken"))


def lexicon(paths: tuple[str, ...] = VOCABULARIES) -> tuple[np.ndarray, np.ndarray]:
    """Word values of what the vocabularies write in small letters, and of what they write with a capital only."""
    words = {w.decode("utf-8", "ignore")[1:] for p in paths for w in encoding(p).token_byte_values() if w[:1] == b" "}
    lower = {w for w in words if w.isalpha() and w.islower()}
    return word_values(sorted(lower)), word_values(sorted({w.lower() for w in words if w.istitle() and w.isalpha()} - lower))


@lru_cache(maxsize=2)
def default_model(repeats: int = 40, epochs: int = 6, vocabularies: tuple[str, ...] = VOCABULARIES) -> Crf:
    """The tagger trained from the labelled table, once a process."""
    labels = ["O"] + [f"{h}-{k}" for k in KINDS for h in "BI"]
    return Crf.train(labelled_rows(repeats), labels, lexicon(vocabularies), epochs=epochs)


def _trim(text: str, a: int, b: int, cut: str) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in cut):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in cut):
        b -= 1
    return a, b


def _mail(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The mail address that a decoded span touches."""
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+%'-"):
        a -= 1
    if not _EMAIL.match(text, a) and (m := _AT_BEFORE.search(text, max(0, a - 16), a)):  # the span began after the at sign
        a = m.start()
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+%'-"):
            a -= 1
    for m in _LOCAL.finditer(text, a, b):
        if found := _EMAIL.match(text, m.start()):
            return found.span()
    return None


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact ends of a decoded span, None if it can't be of its kind."""
    if kind == "email":
        found = _mail(text, a, b)
        if found is None:
            return None
        x, y = found
        while x < y and text[x] in ".'-%":
            x += 1
        return None if text[max(0, x - 2) : x] == "//" or _LOGIN_AFTER.match(text, y) else (x, y)
    if kind == "name":
        a, b = _trim(text, a, b, ",;:\"'()[]{}<>-*_#@/|")
        while a < b and (text[a] == "." or text[a].isspace()):
            a += 1
        if m := _TITLE.match(text, a, b):
            a = m.end()
        if b > a and text[b - 1] == "." and not re.search(r"(?:^|[\s,.])[^\W\d_]\.$", text[a:b]):
            b -= 1
        words = re.findall(r"[^\W\d_]{2,}", text[a:b])
        return (a, b) if words and any(w[0].isupper() for w in words) and not re.search(r"\d", text[a:b]) else None
    if kind == "street_address":
        a, b = _trim(text, a, b, ",;:.\"'()[]{}<>|")
        if text[a : a + 1].isalpha() and not re.search(r"\d", text[a : min(b, a + 12)]):  # a house number before the street belongs to it
            i = a
            while i > 0 and (text[i - 1].isspace() or text[i - 1] == ","):
                i -= 1
            i -= i > 1 and text[i - 1].isalpha() and text[i - 2].isdigit()
            j = i
            while j > 0 and text[j - 1].isdigit():
                j -= 1
            a = j if j < i < a and not (j > 0 and (text[j - 1].isalnum() or text[j - 1] == ".")) else a
        return (a, b) if re.search(r"\d", text[a:b]) and len(re.findall(r"[^\W\d_]{2,}", text[a:b])) >= 2 else None
    a, b = _trim(text, a, b, ",;:\"'[]{}<>|.")
    if kind == "phone":
        while a > 0 and (text[a - 1].isdigit() or text[a - 1] == "+" or (a > 1 and text[a - 1] in ".-/" and text[a - 2].isdigit() and text[a : a + 1].isdigit())):
            a -= 1
        if a > 0 and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        b = _PHONE_REST.match(text, b).end()
        while text[a:b].startswith("(") and text.count("(", a, b) > text.count(")", a, b):
            a += 1
        if b > a and text[b - 1] == ")" and "(" not in text[a:b]:
            b -= 1
        a, b = _trim(text, a, b, "-/")
        return (a, b) if 6 <= sum(c.isdigit() for c in text[a:b]) <= 17 else None
    a, b = _trim(text, a, b, "()-/")
    while a > 0 and (text[a - 1].isalnum() and text[a - 1].isascii()):
        a -= 1
    b = _NUMBER_REST.match(text, b).end()
    return (a, b) if sum(c.isdigit() for c in text[a:b]) >= 4 else None


def entities(model: Crf, texts: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(index of the text, kind, start, length) of the entities of each text, in order and without overlap."""
    found: dict[int, list[list]] = {}
    for i, a, b, kind in model.spans(texts):
        before = found.setdefault(i, [])
        number = ("phone", "identity_number")
        if before and kind in number and before[-1][2] in number and texts[i][before[-1][1] : a] in ("", " ", "-", ".", "/") and kind != before[-1][2]:
            before[-1][1], before[-1][2] = b, "identity_number"
        else:
            before.append([a, b, kind])
    for i, spans in found.items():
        done = 0
        for a, b, kind in spans:
            if (ends := settle(texts[i], a, b, kind)) and ends[0] >= done and ends[1] > ends[0]:
                done = ends[1]
                yield i, kind, ends[0], ends[1] - ends[0]


def _pieces(text: str) -> Iterator[tuple[int, int, int]]:
    """(place, first, last) of the pieces of a very long text: a piece is read from place on and keeps what begins in first to last."""
    n, first = len(text), 0
    while first < n:
        last = min(n, first + CHUNK_CHARS)
        if last < n:  # not inside a run of characters, where one can be avoided
            last = max(text.rfind("\n", first + CHUNK_CHARS // 2, last), text.rfind(" ", first + CHUNK_CHARS // 2, last)) + 1 or last
        yield max(0, first - CONTEXT), first, last
        first = last


def all_entities(model: Crf, texts: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """`entities` in chunks of bounded size; very long texts in pieces that overlap by CONTEXT characters on either side."""
    for a, b in _chunks(texts):
        if b - a > 1 or len(texts[a]) <= 2 * CHUNK_CHARS:
            for i, kind, start, n in entities(model, texts[a:b]):
                yield a + i, kind, start, n
            continue
        done = 0
        for place, first, last in _pieces(texts[a]):
            for _, kind, start, n in entities(model, [texts[a][place : last + CONTEXT]]):
                if first <= place + start < last and place + start >= done:
                    done = place + start + n
                    yield a, kind, place + start, n


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK_CHARS:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Crf | None = None) -> DataFrame:
    """(doc_id, pii_kind, start_pos, n_chars) of each entity."""
    shared = documents.sparkSession.sparkContext.broadcast(model or default_model())
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch[doc_id].tolist(), batch[text].tolist()
            rows = [(ids[i], k, s, n) for i, k, s, n in all_entities(shared.value, texts)]
            yield pd.DataFrame(rows, columns=[doc_id, "pii_kind", "start_pos", "n_chars"])

    return documents.select(doc_id, text).where(F.col(doc_id).isNotNull() & (F.length(F.trim(text)) > 0)).mapInPandas(run, f"`{doc_id}` {kind}, pii_kind string, start_pos int, n_chars int")


def redacted(model: Crf, texts: list[str | None]) -> list[str | None]:
    """The texts with typed placeholders such as [EMAIL]; null stays null."""
    spans: dict[int, list[tuple[str, int, int]]] = {}
    for i, kind, start, n in all_entities(model, [t or "" for t in texts]):
        spans.setdefault(i, []).append((kind, start, n))
    out = list(texts)
    for i, found in spans.items():
        parts, done = [], 0
        for kind, start, n in found:
            parts += [texts[i][done:start], f"[{kind.upper()}]"]
            done = start + n
        out[i] = "".join(parts) + texts[i][done:]
    return out


def redact_pii(text: Column, model: Crf | None = None) -> Column:
    """The text with typed placeholders, as a Column; null stays null."""
    trained = model or default_model()

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(redacted(trained, [None if t is None else t for t in batch]), dtype=object)

    return apply(text)
