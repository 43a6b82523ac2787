"""Leak search against a plain search of every window."""

import random

import pytest

from impactframe.llm.leakage import WuManber, leaked_items, words

DOC = "doc_id bigint, text string, item_id int"
ITEM = "item_id bigint, suite string, text string"


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        w = words(t)
        have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i, it in items:
            x = words(it)
            if any(tuple(x[k : k + size]) in have for k in range(len(x) - size + 1)):
                out.add((d, i))
    return out


def test_against_windows(spark):
    rng = random.Random(8)
    vocab = ["alpha", "Beta", "x1", "ÜBER", "straße", "ß", "the", "of"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "_", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(12)]
    docs = [(d, text(rng.randint(0, 40)) + (items[d % 12][1][10:90] if d % 3 else "")) for d in range(80)]
    d = spark.createDataFrame([(*r, 0) for r in [*docs, (None, items[0][1]), (900, None), (901, ""), docs[1]]], DOC)
    e = spark.createDataFrame([(i, "s", t) for i, t in items] + [(None, "s", "a"), (77, "s", None)], ITEM)
    for size in (2, 5, 12):
        expected = brute(docs, items, size)
        for block in (200_000, 40):  # one block, and several
            assert {(r.doc_id, r.item_id) for r in leaked_items(d, e, size, block).collect()} == expected
    assert brute(docs, items, 5)
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaked_items(d, e, 1)


def test_shift_and_counts():
    item = words("one two three four five six seven eight nine ten eleven twelve thirteen")
    table = WuManber([(1, item), (2, item)])
    assert table.search(words("zero " * 500) + item) == {1: (500, 2), 2: (500, 2)}
    assert table.search(item[:11]) == {} and table.search([]) == {}
