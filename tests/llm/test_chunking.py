"""Splitting: limits, coverage, overlap and locality."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from impactframe.llm.chunking import oversized, split, split_changes

SCHEMA = "fchange_id bigint, diff string, logical_units double, piece string, units double"


def checked(text, units, max_chars, max_units, overlap):
    pieces = split(text, units, max_chars, max_units, overlap)
    end = 0
    for k, (a, b) in enumerate(pieces):
        assert a < b <= len(text) and b - a <= max_chars and a <= end
        assert end - a <= overlap and (k == 0 or a > pieces[k - 1][0])
        if units and b - a > 1:
            assert units * (b - a) / len(text) <= max_units + 1e-9
        end = b
    assert end == len(text)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r@é𝒳", max_size=400), st.one_of(st.none(), st.floats(0, 500)), st.integers(4, 90), st.integers(0, 30))
def test_pieces_keep_the_limits(text, units, max_chars, overlap):
    checked(text, units, max_chars, 20.0, overlap)


def body(lines, seed=1):
    rng = random.Random(seed)
    return "".join(f"    v_{rng.choice('abcdef')}{rng.randint(0, 99)} := NVL(x, {rng.randint(0, 9)});\n" for _ in range(lines))


def test_cuts_lie_at_line_starts():
    text = body(900)
    pieces = checked(text, None, 4000, 120.0, 200)
    assert len(pieces) > 5 and all(text[b - 1] == "\n" for _, b in pieces)
    assert all(text[a - 1] == "\n" for a, _ in pieces[1:])


def test_an_edit_alters_only_neighbours():
    text = body(3000)
    edited = text[:30_000] + "    inserted := 1;\n" + text[30_000:]
    old = {text[a:b] for a, b in split(text)}
    new = [edited[a:b] for a, b in split(edited)]
    assert sum(p not in old for p in new) <= 4


def literals(n, seed=2):
    rng = random.Random(seed)
    return ", ".join(f"'item{rng.randint(0, 10**6)}'" for _ in range(n))


def test_long_lines_are_cut_at_their_inner_boundaries():
    pieces = checked(literals(1500), None, 4000, 120.0, 200)
    assert len(pieces) > 4 and all(literals(1500)[b - 1] == "," for _, b in pieces[:-1])
    assert all(literals(1500)[a - 1] == "," for a, _ in pieces[1:])
    prose = "这是一段没有换行的长文，里面有逗号。" * 700
    assert all(prose[b - 1] == "。" for _, b in checked(prose, None, 4000, 120.0, 200)[:-1])


def test_an_edit_in_a_long_line_alters_only_neighbours():
    for text in (literals(3000), "".join(random.Random(3).choices("abcdefghij", k=40_000))):
        old = {text[a:b] for a, b in split(text)}
        edited = text[:9_000] + "xyz" + text[9_000:]
        assert sum(edited[a:b] not in old for a, b in split(edited)) <= 4


def test_an_early_line_start_is_used_where_it_is_the_only_boundary():
    text = "a" * 900 + "\n" + "b" * 6000
    assert checked(text, None, 4000, 120.0, 200)[0] == (0, 901)


def test_long_line_and_carriage_returns():
    checked("x" * 20_000, None, 4000, 120.0, 200)
    text = "ab\r\n" * 3000
    assert all(not (text[b - 1] == "\r" and text[b : b + 1] == "\n") for _, b in checked(text, 300.0, 4000, 120.0, 200))


def test_table(spark):
    rows = [
        (1, body(200), 10.0), (1, body(200), 10.0), (2, "short", 500.0), (3, "short", 5.0), (4, None, 130.0), (5, "", 130.0), (6, None, None),
        (None, body(200), 1.0), (7, "x" * 4000, 120.0), (8, "x" * 4001, None), (9, "é" * 4000, 120.0), (10, body(5), float("nan")),
    ]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA)
    assert {r.fchange_id for r in oversized(df).collect()} == {1, 2, 4, 5, 8, 10}
    out = split_changes(df).collect()
    assert {r.fchange_id for r in out} == {1, 2, 4, 5, 8, 10}
    assert [(r.piece_no, r.piece) for r in out if r.fchange_id == 4] == [(0, None)]
    ones = sorted((r for r in out if r.fchange_id == 1), key=lambda r: r.piece_no)
    assert [r.piece_no for r in ones] == list(range(1, len(ones) + 1)) and ones[0].piece == body(200)[: ones[0].end_char]
    assert max(r.units for r in out if r.fchange_id == 2) <= 120
    assert split_changes(df.limit(0)).count() == 0
