"""Queries of the problems on code and text, each beside the SQL that states it where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactframe.llm import abuse, chunking, encodings, leakage, mixing, validity
from impactframe.session import stage, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_repaired(spark, sf).select("origin", "record_key").distinct()


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    records = encodings.source_records(table(spark, sf, "source_file"), table(spark, sf, "content_snapshot"))
    return encodings.garbled_records(records)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_files(spark, sf).where("verdict <> 'valid'").select("source_id").distinct()


def p4_files(spark: SparkSession, sf: str) -> DataFrame:
    return validity.check_sources(table(spark, sf, "source_file"))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return validity.invalid_rates(p4_files(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).select("fchange_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_changes(table(spark, sf, "function_change"))


def p5_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the pieces of every diff: they join to the whole text again and keep every limit."""
    pieces = p5_pieces(spark, sf)
    rest = F.expr("substr(piece, shared_chars + 1)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", rest.alias("t")))), lambda p: p["t"]), "")
    found = pieces.groupBy("fchange_id", "diff_key", "whole_units").agg(
        joined.alias("text"),
        F.min(F.coalesce(F.length("piece"), F.lit(0)) <= chunking.MAX_CHARS).alias("within_chars"),
        F.min(F.coalesce((F.col("units") <= chunking.MAX_UNITS + 1e-9) | (F.length("piece") <= 1) | F.col("piece").isNull(), F.lit(True))).alias("within_units"),
        F.min((F.col("shared_chars") >= 0) & (F.col("shared_chars") <= chunking.OVERLAP)).alias("within_overlap"),
        (F.max("piece_no") == F.sum((F.col("piece_no") > 0).cast("int"))).alias("numbered"),
    )
    whole = F.coalesce(F.md5("text") == F.col("diff_key"), F.col("text") == "")
    return found.select("fchange_id", "diff_key", F.col("whole_units").alias("logical_units"), whole.alias("whole"), "within_chars", "within_units", "within_overlap", "numbered")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_report(spark, sf).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def _p7(spark: SparkSession, sf: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mixture, sizes); whole: as large as the corpus."""
    sizes = stage(mixing.weighted_sizes(table(spark, sf, "documents")), "p7-sizes")
    total = float(sizes.agg(F.sum("tokens")).first()[0] or 0) if whole else None
    targets = table(spark, sf, "mix_target")
    return mixing.mix_sources(table(spark, sf, "documents"), targets, total_tokens=total, sizes=sizes, fill=whole), sizes


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _p7(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixture, sizes = _p7(spark, sf)
    return mixing.mixture_shares(mixture, table(spark, sf, "mix_target"), sizes)


def p7_full(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture as large as the corpus: what caps keep from their sources goes to those with room."""
    mixture, sizes = _p7(spark, sf, whole=True)
    return mixing.mixture_shares(mixture, table(spark, sf, "mix_target"), sizes)


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the mixture, per target source: caps are kept, the documents are its own and not null, and its
    tokens miss its share of the total by no more than its longest document."""
    mixture, sizes = _p7(spark, sf)
    target = table(spark, sf, "mix_target").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    longest = sizes.groupBy("source").agg(F.max("tokens").alias("longest"))
    plan = mixing.budgets(sizes, table(spark, sf, "mix_target")).select("source", F.when(F.coalesce("mass", F.lit(0.0)) > 0, F.col("wished")).otherwise(0.0).alias("budget"))
    own = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.col("source").alias("own"))
    used = mixture.join(own, "doc_id", "left").groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most"), F.max((~F.col("own").eqNullSafe(F.col("source"))).cast("int")).alias("strange"),
        (F.count("*") - F.countDistinct("doc_id")).alias("twice"),
    )
    all_ = target.join(plan, "source").join(longest, "source", "left").join(used, "source", "left")
    near = F.abs(F.coalesce("used", F.lit(0)) - F.col("budget")) <= F.coalesce("longest", F.lit(0))
    return all_.select(
        "source", F.coalesce(F.col("most") <= F.col("cap"), F.lit(True)).alias("within_cap"), near.alias("within_share"),
        (F.coalesce("strange", F.lit(0)) == 0).alias("own_texts"), (F.coalesce("twice", F.lit(0)) == 0).alias("listed_once"),
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_scores(spark, sf).where("score > 0").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf, "documents"), table(spark, sf, "content_label"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.abuse_rates(p8_scores(spark, sf))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_repaired, p4_found, p4_files, p4_rates, p5_found, p5_pieces, p5_checks, p6_found, p6_report, p7_mix, p7_shares, p7_full, p7_checks, p8_found, p8_scores, p8_rates)
}
SQL = {
    "p5_found": "SELECT DISTINCT fchange_id FROM function_change WHERE length(diff) > 4000 OR logical_units > 120",
    "p5_checks": """
SELECT DISTINCT fchange_id, md5(diff) AS diff_key, logical_units, TRUE AS whole, TRUE AS within_chars, TRUE AS within_units, TRUE AS within_overlap,
  TRUE AS numbered FROM function_change WHERE length(diff) > 4000 OR logical_units > 120""",
    "p7_checks": """
SELECT DISTINCT source, TRUE AS within_cap, TRUE AS within_share, TRUE AS own_texts, TRUE AS listed_once FROM mix_target WHERE source IS NOT NULL""",
    "p6_report": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dw AS (SELECT doc_id, unnest(range(0, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d WHERE len(w) >= 12),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT doc_id, item_id, min(pos)::INT AS first_word, count(*)::INT AS n_windows FROM dw JOIN iw USING (g) GROUP BY doc_id, item_id""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d WHERE len(w) >= 12),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
}
