"""Mixing: shares, caps, determinism, edges."""

import os

import pytest
from pyspark.sql import functions as F

from impactframe.llm import mixing

TOKENS = "doc_id bigint, text string, source string, tokens string, salt int"
TARGET = "source string, target_share double, max_repeats int, copies int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"word number {i} " * (1 + i % 7), "big", "t", 1) for i in range(3000)]
    rows += [(10_000 + i, f"small text {i}", "small", "t", 1) for i in range(40)] + [(20_000 + i, "same text", "dup", "t", 1) for i in range(50)]
    rows += [(30_000, None, "big", "t", 1), (30_001, "", "big", "t", 1), (None, "no id", "big", "t", 1), (30_002, "lost", None, "t", 1), (30_003, "x", "other", "t", 1)]
    return spark.createDataFrame(rows, TOKENS)


def target(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], TARGET)


def test_shares_are_reached_within_caps(spark, corpus):
    t = target(spark, [("big", 0.6, None), ("small", 0.4, 3), ("absent", 0.0, 2)])
    mix = mixing.mix_sources(corpus, t)
    used = {r.source: r for r in mixing.mixture_shares(mix, t).collect()}
    assert abs(used["big"].actual_share - 0.6) < 0.01 and abs(used["small"].actual_share - 0.4) < 0.01
    assert used["small"].most_repeats == 3 and used["absent"].tokens_used == 0
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mix_sources(corpus.repartition(3), t).collect()))
    assert mix.where("doc_id is null or copies < 1").count() == 0


def test_a_given_total_is_met_as_far_as_caps_allow(spark, corpus):
    t = target(spark, [("big", 0.5, None), ("small", 0.5, 1)])
    mix = mixing.mix_sources(corpus, t, total_tokens=40_000)
    by = {r.source: r for r in mixing.mixture_shares(mix, t).collect()}
    assert abs(by["big"].tokens_used - 20_000) < 60 and by["small"].docs_used == 40 and by["small"].most_repeats == 1


def test_repeated_texts_share_one_weight(spark, corpus):
    t = target(spark, [("dup", 1.0, 1)])
    mix = mixing.mix_sources(corpus, t)
    assert mix.agg(F.sum("copies")).first()[0] == 1


def test_edges(spark, corpus):
    assert mixing.mix_sources(corpus.limit(0), target(spark, [("big", 1.0, 1)])).count() == 0
    assert mixing.mix_sources(corpus, target(spark, [])).count() == 0
    none = mixing.mix_sources(corpus, target(spark, [("big", 1.0, 0), (None, 0.5, 1)]))
    assert none.count() == 0


def test_a_cap_of_zero_leaves_the_other_sources_alone(spark, corpus):
    for cap in (0, -1):
        mix = mixing.mix_sources(corpus, target(spark, [("big", 0.5, cap), ("small", 0.5, 2)]))
        assert {r.source for r in mix.select("source").distinct().collect()} == {"small"}


def test_what_caps_leave_goes_to_sources_with_room(spark, corpus):
    t = target(spark, [("big", 0.4, 2), ("small", 0.5, 1), ("dup", 0.05, 1), ("absent", 0.05, None)])
    sizes = mixing.weighted_sizes(corpus)
    mix = mixing.mix_sources(corpus, t, total_tokens=20_000, sizes=sizes, fill=True)
    by = {r.source: r for r in mixing.mixture_shares(mix, t, sizes).collect()}
    assert abs(sum(r.tokens_used for r in by.values()) - 20_000) < 60 and by["big"].most_repeats <= 2
    assert by["small"].docs_used == 40 and by["small"].unused_tokens == 0 and by["absent"].available_tokens == 0
    assert by["dup"].docs_used == 1 and by["dup"].unused_tokens == by["dup"].available_tokens - by["dup"].tokens_used
    t2 = target(spark, [("big", 0.1, 2), ("small", 0.1, 20), ("dup", 0.8, 1)])
    two = {r.source: r.tokens_used for r in mixing.mixture_shares(mixing.mix_sources(corpus, t2, total_tokens=4_000, sizes=sizes, fill=True), t2).collect()}
    assert abs(two["big"] - two["small"]) < 60 and abs(sum(two.values()) - 4_000) < 60
    more = mixing.mix_sources(corpus, t, total_tokens=10**9, sizes=sizes, fill=True)
    assert more.groupBy("source").agg(F.max("copies").alias("m")).where("source = 'big' and m = 2").count() == 1


@pytest.mark.parametrize("hot, few", [(1, 100), (20, 0), (100, 100)])
def test_hot_texts_count_alike(spark, corpus, monkeypatch, hot, few):
    want = {tuple(r) for r in mixing.weighted_sizes(corpus).select("doc_id", "source", "same").collect()}
    monkeypatch.setattr(mixing, "HOT", hot)
    monkeypatch.setattr(mixing, "FEW", few)
    assert {tuple(r) for r in mixing.weighted_sizes(corpus).select("doc_id", "source", "same").collect()} == want
    assert (20_000, "dup", 50) in want and (30_000, "big", 1) in want


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="vocabularies are not here")
def test_both_files_of_a_vocabulary_count_alike():
    blanks = [" " * 5_000, "x" + "\n" * 3_000 + "y", "a \t" * 10 + " " * 2_500 + "zed", " " * 2_100 + "\n" + " 1", "　" * 2_050 + "字", "q" + " " * 2_000 + "." + "\t" * 2_001]
    texts = ["", "it's 12 o'clock", "<|endoftext|> a", "año 税额 🚚\r\n", "a" * 50_000, *blanks, " ".join(blanks), " " * 1_000_000]
    ranks, json = mixing.counter("/opt/tokenizers/byte_bpe_50k.tiktoken"), mixing.counter("/opt/tokenizers/byte_bpe_50k.json")
    assert ranks(texts) == json(texts)
