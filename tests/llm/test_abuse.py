"""Abuse: disguised spellings, and accuracy on labelled documents that training did not see."""

import os
from itertools import combinations

import numpy as np
import pytest

from impactframe.llm import abuse as a

SCHEMA = "doc_id bigint, text string, source string, score string"
LABEL = "doc_id bigint, annotator string, abusive int, category string"
PLAIN = ["Set {0}_flag to 7 before you close the {0}.", "The {0} team saw a null quantity in Load{0} today.", "Kill the orphaned child {0} first.", "This {0} job is slow and the report skips a day."]
NASTY = ["You stupid worthless idiot, go away with your {0}.", "Whoever wrote the {0} is a complete moron.", "I will hurt you if the {0} fails again."]
THINGS = ["ledger", "silo", "crate", "levy", "toll", "quota", "winch", "depot", "tariff", "permit", "ramp", "vessel"]


@pytest.fixture(scope="module")
def machine():
    clean = [("\n".join(p.format(x) for p in PLAIN), 0.0, 2) for x in THINGS]
    dirty = [("\n".join([*(p.format(x) for p in PLAIN), NASTY[k % 3].format(x)]), 1.0, 2) for k, x in enumerate(THINGS)]
    return a.train(clean + dirty)


@pytest.mark.parametrize("text", [
    "You stupid worthless idiot", "you st*pid w0rthless 1d10t!", "YOU STUUUUPID WORTHLESS IDIOOOOT", "you s t u p i d worthless idiot", "You stupіd wоrthlеss idiot, go",
])
def test_disguises(machine, text):
    assert machine.score(text) + a.MARGIN > 0  # beyond the boundary of this tiny machine


@pytest.mark.parametrize("text", ["Kill the orphaned child wagon first.", "The wagon team saw a null quantity in LoadWagon today.", "", "§ 12 ++"])
def test_harmless(machine, text):
    assert machine.score(text) < 0


@pytest.mark.parametrize("text", ["Kill the orphaned child wagon first", "The wagon team saw a null quantity in LoadWagon today"])
def test_word_order_counts_everywhere(machine, text):
    """No passage is settled by its single words alone, however harmless they look."""
    assert abs(machine.score(text) - machine.score(" ".join(reversed(text.split())))) > 1e-4


@pytest.mark.parametrize("word, inside", [("arschlochgesicht", "arschloch"), ("schweinehund", "schwein"), ("motherfucker", "fucker"), ("fucker", "motherfucker")])
def test_compounds_match(word, inside):
    at, sim = a.WordKernel([inside, "ledger"]).matches(word)
    assert list(at) == [0] and sim[0] > 0.15


def test_word_similarity_against_brute_force():
    def kernel(v, w, k):
        gaps = lambda c: c[-1] - c[0] + 1 - k
        return sum(a.CHAR_DECAY ** (gaps(x) + gaps(y)) for x in combinations(range(len(v)), k) for y in combinations(range(len(w)), k) if all(v[i] == w[j] for i, j in zip(x, y)))

    words = ["idiot", "idiotic", "ledger", "motherf", "banana", "moron"]
    for w in ["idioot", "xidiotx", "bananas", "gredle"]:
        want = [sum(s * kernel(v, w, k) / (kernel(v, v, k) * kernel(w, w, k)) ** 0.5 for k, s in ((1, 0.2), (2, 0.3), (3, 0.5))) for v in words]
        assert abs(a.WordKernel(words).similarity(w) - want).max() < 1e-9
    assert len(a.WordKernel(words).matches("idiot" * 500)[0]) >= 0


def test_index_equals_recursion(machine):
    kernel = a.PassageKernel(machine.landmarks)
    texts = [t.format(x) for t in NASTY + PLAIN for x in ("barge", "idiot")] + ["", "xyzzy", "you stupid the you will the idiot " * 6]
    batch = [a.tokens(t) for t in texts]
    ids = [np.array([kernel.words.number(x) for x in w], np.int64) for w in batch]
    plain = np.array([kernel._normal(kernel._kernels(w)[:, None], kernel.self_norms(i, np.array([len(i)])))[0] for w, i in zip(batch, ids)])
    assert abs(kernel.features(batch) - plain).max() < 1e-5
    kernel.fold(machine.weights)
    assert abs(kernel.weighted(batch) - plain @ machine.weights).max() < 1e-4


def test_self_norms_against_recursion():
    words = [["a", "b", "a", "c"], ["a", "b", "c"], [], ["x"] * 7, ["q", "q", "r"]]
    kernel = a.PassageKernel([w for w in words if w])
    own = [kernel._kernels(w)[:, [w for w in words if w].index(w)] if w else np.zeros(3) for w in words]
    ids = np.array([kernel.words.number(x) for w in words for x in w], np.int64)
    assert abs(kernel.self_norms(ids, np.array([len(w) for w in words])) - np.array(own).T).max() < 1e-4


def test_abuse_late_in_a_long_passage_is_learned():
    long = lambda x: " ".join(p.format(x).strip(".") for p in PLAIN * 3)
    clean = [(long(x), 0.0, 2) for x in THINGS]
    dirty = [(long(x) + " you stupid worthless idiot", 1.0, 2) for x in THINGS]
    assert len(a.tokens(clean[0][0])) > a.WINDOW + 10
    learned = a.train(clean + dirty)
    assert any("idiot" in words for words in learned.landmarks)
    assert learned.score(long("barge") + " you stupid worthless idiot") > learned.score(long("barge")) + 0.1


def test_tokens():
    assert a.tokens("Ｉdiot `code_x` T_CRATE a b c d 7 m0r0n!!") == ["idiot", "§", "§", "abcd", "§", "moron"]
    assert a.passages("a b. c d!! e\nf? G") == ["a b.", "c d!! e", "f?", "G"] and a.passages(None) == []


def test_missing_classes():
    assert a.train([]) is None and a.train([("fine", 0.0, 1)]) is None


def test_table(spark, machine):
    docs = [(1, "Fine.\n" + NASTY[1].format("barge"), "s", "x"), (2, PLAIN[0].format("barge"), None, "x"), (3, None, "s", "x"), (4, "", "s", "x"), (None, "q", "s", "x"), (5, "word " * 20_000, "s", "x")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in a.score_documents(df, None, machine).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].score > 0 and got[2].score < 0 and got[3].score is None and got[5].score < 0
    rates = {r.source: (r.docs, r.abusive) for r in a.abuse_rates(a.score_documents(df, None, machine)).collect()}
    assert rates == {"s": (4, 1), None: (1, 0)}
    labels = spark.createDataFrame([(1, "r", 1, None), (1, "q", 0, None), (2, "r", None, None), (None, "r", 1, None)], LABEL)
    assert a.labelled_texts(df, labels) == []
    assert a.score_documents(df.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_held_out_accuracy(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    rows = a.labelled_texts(read("documents"), read("content_label"))
    machine = a.train([r for k, r in enumerate(rows) if k % 4])
    held = [r for k, r in enumerate(rows) if not k % 4 and r[2] >= 2 and r[1] in (0.0, 1.0)]  # raters who agree
    right = sum((max(map(machine.score, a.passages(t)), default=-1) > 0) == (r > 0.5) for t, r, _ in held)
    assert right / len(held) > 0.88
