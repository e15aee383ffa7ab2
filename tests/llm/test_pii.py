import os
import re
from collections import Counter

import numpy as np
import pytest

from conftest import rows
from held_out_pii import held_out
from lodestrata.llm import pii
from lodestrata.llm.crf import Crf, tokenize
from lodestrata.llm.pii_examples import _GIVEN, _KNOWN_GIVEN, _LAST, _PLAIN_GIVEN, _PLAIN_LAST, CARRIERS, KINDS, NEGATIVES, _Filler, labelled_rows


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


def score(model, held):
    hit, wrong, missed = Counter(), Counter(), Counter()
    got = {}
    for i, kind, a, n in pii.entities(model, [t for t, _ in held]):
        got.setdefault(i, set()).add((a, a + n, kind))
    for i, (_, spans) in enumerate(held):
        want, have = set(spans), got.get(i, set())
        for s in have:
            (hit if s in want else wrong)[s[2]] += 1
        for s in want - have:
            missed[s[2]] += 1
    return {k: (hit[k] / max(1, hit[k] + missed[k]), hit[k] / max(1, hit[k] + wrong[k])) for k in KINDS}


def test_held_out_accuracy(model):
    """Exact recall and precision of each kind on sentences, names and places that training never saw."""
    got = score(model, held_out())
    print({k: tuple(round(x, 3) for x in v) for k, v in got.items()})
    for kind, (recall, precision) in got.items():
        assert recall >= 0.9 and precision >= 0.9, (kind, recall, precision)


def test_held_out_carriers(model):
    """The same over generated rows whose carriers are in no training row: every fourth carrier is left out of training and read, among fillings of the plain sentences with another seed."""
    part = lambda lines, held: [x for i, x in enumerate(lines) if (i % 4 == 0) == held]
    rest = Crf.train(labelled_rows(40, 60, 7, part(CARRIERS, False)), model.labels, model.lexicon, epochs=6)
    got = score(rest, labelled_rows(6, 20, 99, part(CARRIERS, True)))
    print({k: tuple(round(x, 3) for x in v) for k, v in got.items()})
    for kind, (recall, precision) in got.items():
        assert recall >= 0.8 and precision >= 0.8, (kind, recall, precision)


def test_held_out_shares_nothing_with_training():
    plain = " ".join(CARRIERS + NEGATIVES).lower()
    known = set(re.findall(r"[^\W\d_]+", " ".join([*_GIVEN, *_KNOWN_GIVEN, *_PLAIN_GIVEN, *_LAST, *_PLAIN_LAST])))
    for text, spans in held_out():
        rest, done = [], 0
        for a, b, kind in spans:
            rest.append(text[done:a])
            done = b
            if kind == "name":
                assert not set(re.findall(r"[^\W\d_]{2,}", text[a:b])) & known, text[a:b]
        for part in (*rest, text[done:]):
            assert len(part.strip()) < 14 or part.strip().lower() not in plain, part


def test_training_shares_no_sentence_with_the_test_tables():
    """No stretch of 14 characters or more between slots, and no given name, occurs in the documents."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pandas as pd

    texts = [t for t in pd.read_parquet(path).text if t]
    low, words = "\n".join(texts).lower(), set(re.findall(r"[^\W\d_]+", "\n".join(texts)))
    filler = _Filler(3)
    for line in CARRIERS + NEGATIVES:
        for _ in range(5):
            for part in re.split(r"\{\w+\}|\\n|\\t", filler.expand(line)):
                assert len(part.strip()) < 14 or part.strip().lower() not in low, part
    assert not words & set(_GIVEN + _KNOWN_GIVEN)


def found(model, text):
    return [(k, text[a : a + n]) for _, k, a, n in pii.entities(model, [text])]


def test_exact_spans(model):
    for text, want in [
        ("The patch was written by Nadine Ostrowick.", [("name", "Nadine Ostrowick")]), ("Dr Nadine Ostrowick called about it ((212) 555-0155).", [("name", "Nadine Ostrowick"), ("phone", "(212) 555-0155")]),
        ("Mail to lars.k @ fjordnet.example first.", [("email", "lars.k @ fjordnet.example")]), ("Ring +44 (0)1632 960 843 if the link is down.", [("phone", "+44 (0)1632 960 843")]),
        ("The dump leaks NINO: QQ302873B of a user.", [("identity_number", "QQ302873B")]), ("They relocated to 122 Linden Drive, Apt 3,\nKettlebrune, 94899; change the records.", [("street_address", "122 Linden Drive, Apt 3,\nKettlebrune, 94899")]),
        ("Fetch git@mirror.example:user/buffer.git at 5.12.13.", []), ("The Velvet Switch docs show Silver Street as the theme, see 8.23.3.", []), ("The reply from 10.20.63.33 on port 857 took 684 ms.", []), ("", []), (" \n", []),
    ]:
        assert found(model, text) == want, text


def test_order_overlap_and_batches(model):
    texts = [t for t, _ in labelled_rows(1, 1, seed=9)][:80]
    together = {}
    for i, k, a, n in pii.entities(model, texts):
        together.setdefault(i, []).append((k, a, n))
    for i, t in enumerate(texts):
        alone = [(k, a, n) for _, k, a, n in pii.entities(model, [t])]
        assert together.get(i, []) == alone
        assert all(x[1] + x[2] <= y[1] for x, y in zip(alone, alone[1:], strict=False))


def test_very_long_text(model):
    one = "Written by Nadine Ostrowick.\n"
    filler = "the job is idle now\n" * 60_000
    text = filler[: pii.CHUNK_CHARS - 15] + "\n" + one + filler + one + filler
    got = [(k, a, n) for _, k, a, n in pii.all_entities(model, ["short", text])]
    first = pii.CHUNK_CHARS - 14
    assert got == [("name", first + 11, 16), ("name", first + len(one) + len(filler) + 11, 16)]


def test_viterbi_is_the_best_path(model):
    import itertools

    rng = np.random.default_rng(0)
    k = len(model.labels)
    e = rng.normal(0, 3, (3, k)).astype(np.float32)
    labels = np.zeros(3, np.int8)
    model._viterbi(e, labels, np.array([0]), np.array([3]))
    m = model.moves
    best = max(itertools.product(range(k), repeat=3), key=lambda y: m[0, y[0]] + sum(e[i, y[i]] for i in range(3)) + m[y[0], y[1]] + m[y[1], y[2]] + m[y[2], 0])
    assert labels.tolist() == list(best)


def test_tokens_cover_the_text():
    texts = ["Ab1-é​x\n", "", "ßx 12"]
    t = tokenize(texts, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    real = t.text >= 0
    got = [texts[i][s - t.offsets[i] : e - t.offsets[i]] for i, s, e in zip(t.text[real], t.start[real], t.end[real], strict=True)]
    assert [g for g in got if g.strip()] == ["Ab", "1", "-", "é​x", "ßx", "12"]


def test_frame_and_redaction(spark, model):
    from pyspark.sql import functions as F

    text = "Written by Nadine Ostrowick."
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0), (4, "x " * 200_000 + text, 0)], "doc_id long, text string, start_pos int")
    assert rows(pii.find_pii(df), "doc_id", "pii_kind", "start_pos", "n_chars") == [(1, "name", 11, 16), (1, "name", 11, 16), (4, "name", 400_011, 16)]
    assert pii.find_pii(df.limit(0)).count() == 0
    assert [r.t for r in df.where("doc_id < 4").select(pii.redact_pii(F.col("text")).alias("t")).collect()] == ["Written by [NAME].", "Written by [NAME].", None, ""]


def test_round_trip_over_a_table(model):
    """Over a whole table: putting the entities back for their placeholders gives the texts as they were."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pandas as pd

    texts = [t or "" for t in pd.read_parquet(path).text]
    spans = {}
    for i, kind, a, n in pii.all_entities(model, texts):
        spans.setdefault(i, []).append((a, n, f"[{kind.upper()}]"))
    assert len(spans) > 100
    for i, (before, after) in enumerate(zip(texts, pii.redacted(model, texts), strict=True)):
        back = after
        for a, n, mark in spans.get(i, []):
            assert back[a : a + len(mark)] == mark
            back = back[:a] + before[a : a + n] + back[a + len(mark) :]
        assert back == before
