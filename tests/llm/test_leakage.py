import random

import numpy as np

from conftest import rows
from lodestrata.llm import leakage as k

WORDS = "amber basalt cinder ember falcon glacier harbor heron indigo juniper kestrel lantern lichen marble meadow orchid pewter quartz".split()


def passage(rng, n=60):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)).capitalize() + "."


ASKED = "please answer with one letter only"


def setup(seed=2, n=12):
    rng = random.Random(seed)
    return rng, [passage(rng) + " Please answer with one letter only." for _ in range(n)]


def leaks(items, texts):
    s = k.LeakSearch(list(range(len(items))), items, frozenset([ASKED]))
    return sorted(set(s.leaks(texts)))


def test_whole_part_and_changed():
    rng, items = setup()
    w = items[3].split()
    noisy = list(items[5].split()[:60])
    for i in range(4, 60, 8):
        noisy[i] = "changed"
    texts = [
        "intro " + items[0] + " outro", items[1].upper().replace(" ", "\n  "), "a " + " ".join(w[10:35]) + " b", "a " + " ".join(w[10:25]) + " b", " ".join(noisy), "<p>" + items[6].replace(" ", "</b> <b>") + "</p>", items[7].replace(" ", "\\n"),
        " ".join(x for s in np.array_split(np.array(w[:60]), 6)[::-1] for x in s), "Please answer with one letter only.", " ".join(w[:9]), "", "unrelated text " * 50, items[8].replace("a", "a​"), items[0] + " " + items[9],
    ]
    assert leaks(items, texts) == [(0, 0), (1, 1), (2, 3), (4, 5), (5, 6), (6, 7), (12, 8), (13, 0), (13, 9)]


def test_very_long_text():
    _, items = setup()
    filler = "unrelated text \n" * 300_000
    step = k.CHUNK_CHARS
    texts = [filler[: step - 200] + items[2] + filler, "x", filler[: 3 * step - 17] + items[4] + filler]
    assert leaks(items, texts) == [(0, 2), (2, 4)]


def test_machine_against_brute_force():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 12, 5000).astype(np.uint64)
    words[rng.integers(0, 5000, 100)] = 0
    patterns = rng.integers(1, 12, (400, 4)).astype(np.uint64)
    patterns[5] = patterns[6]
    at, ids = k.WuManber(patterns).search(words, lane=37)
    want = sorted((i, j) for j, p in enumerate(patterns) for i in range(4997) if (words[i : i + 4] == p).all())
    assert sorted(zip(at.tolist(), ids.tolist(), strict=True)) == want and len(want) > 10


def test_word_stream():
    a, _ = k.word_stream(["Foo-bar, BAZ", "x"])
    b, which = k.word_stream(["", "foo  bar\nbaz", "FOO"])
    assert a[:3].tolist() == b[1:4].tolist() and b[-2] == a[0] and which.tolist() == [0, 1, 1, 1, 1, 2, 2] and a[3] == 0


def test_frame(spark):
    _, items = setup()
    docs = spark.createDataFrame([(1, items[0], "x"), (2, items[0], "x"), (3, None, "x"), (None, items[0], "x"), (4, "  ", "x"), (5, "y" * 300_000 + " " + items[4], "x")], "doc_id long, text string, passage string")
    ev = spark.createDataFrame([(n, p, "t") for n, p in enumerate(items)] + [(98, None, "t"), (99, "too short", "t")], "item_id long, passage string, text string")
    assert rows(k.leaked_items(docs, ev), "doc_id", "item_id") == [(1, 0), (2, 0), (5, 4)]
    for size in (1, 3, 5):
        assert rows(k.leaked_items(docs, ev, block_items=size), "doc_id", "item_id") == [(1, 0), (2, 0), (5, 4)]
    assert rows(k.leaked_items(docs, ev, block_items=5, pass_chars=10), "doc_id", "item_id") == [(1, 0), (2, 0), (5, 4)]
    assert k.leaked_items(docs, ev.limit(0)).count() == 0 and k.leaked_items(docs.limit(0), ev).count() == 0


def test_shared_sentence_in_any_blocks(spark):
    """A sentence that all items share is no leak, however the items are cut into blocks."""
    rng = random.Random(8)
    asked = "Read the following text with care and then answer the question below with one letter only, without any further words."
    ev = spark.createDataFrame([(n, passage(rng) + " " + asked) for n in range(12)], "item_id long, passage string")
    docs = spark.createDataFrame([(1, "Intro. " + asked + " Outro."), (2, ev.where("item_id = 7").first().passage)], "doc_id long, text string")
    for size in (3, 20_000):
        assert rows(k.leaked_items(docs, ev, block_items=size), "doc_id", "item_id") == [(2, 7)]
    assert k.leaked_items(docs, ev, block_items=3)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_words_beyond_the_basic_plane():
    same = lambda a, b: k.word_stream([a])[0].tolist() == k.word_stream([b])[0].tolist()
    assert same("\U0001d400mber ﬁle café", "amber file cafe\u0301") and same("x\U00020000y", "X\U00020000Y") and not same("x\U00020000y", "x y") and not same("x\U00020000y", "x\U00020001y")
    assert same("a \U0001f600 b", "a b") and same("one <img alt='" + "z" * 500 + "'> two", "one two") and same("가나", "가나") and not same("가나", "가다")
