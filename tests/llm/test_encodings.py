"""Garbled text: exact round trips of planted misreadings, and the edges."""

import numpy as np
import pytest

from impactframe.llm import encodings as e

SCHEMA = "origin string, record_key string, source string, text string, prior int, o string"
CLEAN = ["prüfen Währung löschen", "función código período", "вернуть ошибка значение", "重新计算税额 更新库存余额", "été élevé dépôt", "© £ Â ½ → ±5%", "SITUAÇÃO ÂMBITO não"]
PLANTED = {
    "utf-8 as western": lambda t: t.encode("utf-8").decode("latin-1"),
    "utf-8 as western twice": lambda t: t.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
    "utf-8 as cp437": lambda t: t.encode("utf-8").decode("cp437"),
    "utf-8 as cp850": lambda t: t.encode("utf-8").decode("cp850"),
}


def records(spark):
    rows = []
    for i in range(60):
        for j, text in enumerate(CLEAN):
            rows.append(("source_file", f"clean{i}-{j}", f"repo{i % 3}", f"-- {text}\nx := {i};\n", 1, "o"))
    for n, (name, spoil) in enumerate(PLANTED.items()):
        for j, text in enumerate(CLEAN[:5]):
            rows.append(("source_file", f"bad{n}-{j}", "repo1", spoil(f"-- {text}\n"), 1, "o"))
    rows.append(("content_snapshot", "swap", "repo1", "def prüfen():\n    return 'ok' # Währung\n".encode("utf-16-le").decode("utf-16-be"), 1, "o"))
    rows.append(("content_snapshot", "zeros", None, "def prüfen():\n".encode("utf-16-le").decode("latin-1"), 1, "o"))
    rows.append(("content_snapshot", "lost", "repo2", "pr�fen W�hrung", 1, "o"))
    rows += [("source_file", "null", "r", None, 1, "o"), ("source_file", "empty", "r", "", 1, "o"), ("source_file", "ascii", "r", "x" * 200_000, 1, "o")]
    return spark.createDataFrame(rows, SCHEMA)


def test_planted_records_are_found_and_restored(spark):
    found = {r.record_key: r for r in e.garbled_records(records(spark)).collect()}
    expected = {f"bad{n}-{j}" for n in range(len(PLANTED)) for j in range(5)} | {"swap", "zeros", "lost"}
    assert set(found) == expected
    right = sum(found[f"bad{n}-{j}"].repaired == f"-- {CLEAN[j]}\n" for n in range(len(PLANTED)) for j in range(5))
    assert right >= 18
    assert found["swap"].repaired.startswith("def prüfen():") and found["zeros"].repaired == "def prüfen():\n"
    assert found["lost"].lost_words == 2


def test_nothing_foreign_and_no_rows(spark):
    ascii_ = spark.createDataFrame([("source_file", "a", "r", "plain", 1, "o")], SCHEMA)
    assert e.garbled_records(ascii_).count() == 0
    assert e.garbled_records(ascii_.limit(0)).count() == 0


@pytest.mark.parametrize("chain", [c for c in e.CHAINS if c[1] and len(c[1]) == 1], ids=lambda c: c[0])
def test_every_chain_undoes_itself(chain):
    (wrong, right), = chain[1]
    for text in ("año", "żółw", "вернуть", "税额", "ağırlık", "更新"):
        data = e._to_bytes(text, right) if right in ("western", *e._SINGLE) else None
        try:
            data = data or text.encode({"western": "cp1252"}.get(right, right))
            spoiled = e._to_text(data, wrong) if wrong == "western" else data.decode(wrong)
        except UnicodeError:
            continue
        if e._to_bytes(spoiled, wrong) == data:
            assert e.undo(spoiled, chain[1]) == text
            return


def test_words():
    plain, text = "x été, y", 'a "été b" \0x\0y z'
    assert [plain[a:b] for a, b in e.words_of(plain)] == ["été"]
    assert e.words_of("plain") == [] and len(e.words_of(text)) == 1


def test_scores_do_not_depend_on_the_other_texts():
    texts = ["été à", "→ Δ", "税额", "x"]
    model = e.CharacterModel(*e.CharacterModel.counts({t: 3.0 for t in texts}))
    alone = [model.score([t])[0] for t in texts]
    assert list(model.score(texts)) == pytest.approx(alone) and list(model.score(texts[::-1])) == pytest.approx(alone[::-1])


def test_records_are_judged_alike_in_any_batch():
    records = [["été", "prÃ¼fen"], [], ["→"], ["LÃ¶sung", "税额", "é"]]
    whole = e.Batch(records)
    model = e.CharacterModel(*e.CharacterModel.counts(whole.first_credits()))
    prior = lambda n: np.tile(e.START, (n, 1))
    post, joint = whole.judge(model, prior(4), np.array([1, 4, 1, 2, 1, 1]))
    at = 0
    for i, (words, counts) in enumerate(zip(records, ([1, 4], [], [1], [2, 1, 1]))):
        p, j = e.Batch([words]).judge(model, prior(1), np.array(counts))
        assert p[0] == pytest.approx(post[i]) and j == pytest.approx(joint[at : at + len(words)])
        at += len(words)


def test_many_sources_join_their_priors_salted(spark, monkeypatch):
    rows = records(spark).select("origin", "source", "record_key")
    priors = spark.createDataFrame([("source_file", "repo1", [0.5]), ("source_file", None, [0.25])], "origin string, source string, prior array<double>")
    want = sorted((r.record_key, r.prior) for r in e._with_prior(rows, priors).collect())
    monkeypatch.setattr(e, "FEW_SOURCES", 0)
    got = e._with_prior(rows, priors)
    assert sorted((r.record_key, r.prior) for r in got.collect()) == want and set(got.columns) == {"origin", "source", "record_key", "prior"}
