"""Mixing sources to target weights (problem 7).

The budget of a source is its target share of the total size, in tokens of a public tokenizer. Documents first get
certain whole copies; what is left of the budget is filled by Pareto order sampling: documents are ranked by random
odds divided by inclusion odds. Expected copies are proportional to 1/m for a text that occurs m times in its source,
so a repeated text is not favoured, and no document is used more than max_repeats times.

The rank at which a source's budget ends is found from a histogram of fixed size; only the one bin that the budget
cuts is put in order, so no source is gathered or sorted as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.session import cut, spread

#: Vocabulary of a public byte-level BPE: a file of ranks, or a tokenizer's JSON file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's texts are cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = re.compile(r"\s{2000,}")
#: Bins of the rank histogram of a source.
BINS = 65_536
SALTS = 32
#: Copies from which a text is hot, and hot texts up to which they are broadcast, counted first.
HOT, FEW = 100_000, 100_000


def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts; strings of special tokens are ordinary text."""
    if not tokenizer.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        total = at = 0
        for m in _BLANKS.finditer(text):  # a long run of blanks is one piece, but for its last one where text follows
            end = m.end() - (m.end() < len(text))
            total += len(bpe.encode_ordinary(text[at : m.start()])) + len(bpe._encode_single_piece(text[m.start() : end]))
            at = end
        return total + len(bpe.encode_ordinary(text[at:] if at else text))

    return lambda texts: [count(t) for t in texts]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_key, tokens): size of each document; a null text has 0 tokens."""

    @F.pandas_udf("bigint")
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer)
        for batch in texts:
            filled = [t or "" for t in batch]
            yield pd.Series([n for i in range(0, len(filled), 256) for n in count(filled[i : i + 256])], dtype="int64")

    return spread(documents.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.xxhash64("text", F.length("text")).alias("text_key"), size(F.col("text")).alias("tokens")
    )


def budgets(sizes: DataFrame, mix_target: DataFrame, total_tokens: float | None = None, fill: bool = False) -> DataFrame:
    """One row per target source: its available mass, cap, budget and expected copies of a text that occurs once.

    total_tokens null: the largest total at which every source that has text can reach its share within its cap.
    Sources are matched by name; a source without text cannot contribute and gets budget 0. Shares of repeated target
    rows add up, of their caps the smallest counts. fill: what caps leave of a given total goes to the sources with room,
    in proportion to their shares, as far as any has room.
    """
    target = (
        mix_target.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    mass = sizes.groupBy("source").agg(
        F.sum("tokens").alias("available_tokens"),
        F.sum("weighted").alias("mass"),
        F.count("*").alias("docs"),
    )
    joined = target.join(mass, "source", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    able = (F.col("mass") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    reach = F.when(able, F.col("mass") * F.col("max_repeats") / F.col("target_share"))
    if total_tokens is None:
        limit = F.min(reach).over(Window.partitionBy())  # one row per target source
        everything = F.sum("available_tokens").over(Window.partitionBy())
        total = F.coalesce(limit, everything.cast("double"))
    else:
        total = F.lit(float(total_tokens))
    cap = F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf")))
    wish = F.col("target_share") * total
    if fill and total_tokens is not None:
        # in the order of room per share, sources fill up; what is left over the shares of the rest is the common level
        room = F.when((F.col("mass") > 0) & (F.col("target_share") > 0) & (cap > 0), F.col("mass") * cap).otherwise(F.lit(0.0))
        ratio = F.when(F.col("room") > 0, F.col("room") / F.col("target_share")).otherwise(F.lit(0.0))
        joined = joined.withColumn("room", room).withColumn("ratio", ratio)
        order = Window.partitionBy().orderBy("ratio", "source")  # one row per target source
        full, open_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        share = F.when(F.col("room") > 0, F.col("target_share")).otherwise(F.lit(0.0))
        level = (F.lit(float(total_tokens)) - F.coalesce(F.sum("room").over(full), F.lit(0.0))) / F.nullif(F.sum(share).over(open_), F.lit(0.0))
        joined = joined.withColumn("level", F.when(level <= F.col("ratio"), level))
        first = F.min(F.when(F.col("level").isNotNull(), F.struct("ratio", "source", "level"))).over(Window.partitionBy())
        level = F.coalesce(first["level"], F.lit(float("inf")))
        wish = F.least(F.col("target_share") * level, F.col("room"))
        joined = joined.withColumn("wish", wish)
        wish = F.col("wish")
    return joined.withColumn("wished", wish).withColumn(
        "copies", F.when(F.col("mass") > 0, F.least(wish / F.col("mass"), cap)).otherwise(F.lit(0.0))
    )


def _uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the document alone, so a repeated task draws the same."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_key")), 11).cast("double")
    return (bits + 0.5) / float(1 << 53)


def mix_sources(
    documents: DataFrame, mix_target: DataFrame, total_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER,
    sizes: DataFrame | None = None, fill: bool = False,
) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each used document appears in the mixture; for the total see budgets.

    Documents without doc_id, without a source named in mix_target, or without tokens are not used. Copies never
    exceed the source's max_repeats (null: no cap); a max_repeats of 0 or less uses none. A source ends at most one
    document away from its budget. Repeated rows are drawn each on their own.
    """
    sized = sizes if sizes is not None else weighted_sizes(documents, tokenizer)
    plan = budgets(sized, mix_target, total_tokens, fill).select("source", "copies", "wished", "mass", "max_repeats")
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    expected = F.col("copies") / F.col("same")
    docs = (
        sized.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tokens") > 0))
        .withColumn("salt", F.pmod(F.col("doc_id"), F.lit(SALTS)).cast("int"))
        .join(plan, ["source", "salt"])
        .where(F.col("copies") > 0)
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
    )
    u = _uniform(seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # odds / (1 + odds) keeps the order and lies in (0, 1), so bins of equal width serve every source
    ranked = docs.withColumn("odds", F.when(F.col("p") > 0, odds)).withColumn("rank", F.col("odds") / (1 + F.col("odds")))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    certain = ranked.groupBy("source").agg(
        F.sum(F.col("whole") * F.col("tokens")).alias("placed"),
        F.first("copies").alias("copies"), F.first("mass").alias("mass"),
    )
    rest = certain.select("source", (F.col("copies") * F.col("mass") - F.col("placed")).alias("rest"))
    bins = ranked.where(F.col("p") > 0).groupBy("source", "bin").agg(F.sum("tokens").alias("t"))
    filled = F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    edge = (
        bins.withColumn("filled", filled).join(rest, "source")
        .where((F.col("filled") >= F.col("rest")) & (F.col("filled") - F.col("t") < F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("rest") - (F.col("filled") - F.col("t"))).alias("room"))).alias("e"))
        .select("source", F.col("e.bin").alias("edge"), F.col("e.room").alias("room"))
    )
    edge = edge.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = ranked.join(edge, ["source", "salt"], "left")
    upto = F.sum("tokens").over(
        Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    at_edge = marked.where(F.col("bin") == F.col("edge")).withColumn("upto", upto)
    # the document that crosses the budget is taken where that brings the total nearer
    extra = F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("room"), 1).otherwise(0)
    inside = marked.where(F.col("bin").isNull() | F.col("edge").isNull() | (F.col("bin") != F.col("edge")))
    drawn = F.when(F.col("bin").isNotNull() & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), 1).otherwise(0)
    columns = ["doc_id", "source", "tokens", "max_repeats"]
    taken = inside.select(*columns, (F.col("whole") + drawn).alias("copies")).unionByName(
        at_edge.select(*columns, (F.col("whole") + extra).alias("copies"))
    )
    capped = F.least(F.col("copies"), F.coalesce("max_repeats", F.col("copies"))).cast("int")
    return taken.select("doc_id", "source", "tokens", capped.alias("copies")).where("copies > 0")


def weighted_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts with `same`, how often a text occurs in its source, and `weighted` = tokens / same.

    Counts combine on the map side. Texts that occur more than HOT times are few, at most a HOT-th of the rows: their
    counts are broadcast once counted, so no task gets all copies of one; the rest meet their counts in a plain join.
    """
    sized = cut(token_counts(documents, tokenizer))
    keys = ["source", "text_key"]
    again = cut(sized.groupBy(*keys).agg(F.count("*").alias("same")).where("same > 1"))
    hot = again.where(F.col("same") > HOT)
    often = hot.withColumnRenamed("same", "often")
    o = often.select(F.col("source").alias("o_source"), F.col("text_key").alias("o_key"), "often")
    few = F.broadcast(o) if o.count() <= FEW else o
    joined = sized.join(few, sized.source.eqNullSafe(F.col("o_source")) & (sized.text_key == F.col("o_key")), "left").drop("o_source", "o_key")
    spread = F.when(F.col("often").isNull(), F.col("text_key")).otherwise(F.xxhash64("doc_id", "text_key"))  # hot rows need no partner
    cold = again.where(F.col("same") <= HOT).select(F.coalesce("source", F.lit("\0")).alias("c_source"), F.col("text_key").alias("c_key"), "same")
    joined = joined.withColumn("c_key", spread).withColumn("c_source", F.coalesce("source", F.lit("\0"))).join(cold, ["c_source", "c_key"], "left")
    same = F.coalesce("often", F.when(F.col("often").isNull(), F.col("same")), F.lit(1))
    return joined.withColumn("same", same).drop("often", "c_key", "c_source").withColumn("weighted", F.col("tokens") / F.col("same"))


def mixture_shares(mixture: DataFrame, mix_target: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(source, target_share, actual_share, docs_used, tokens_used, most_repeats) of a mixture, one row per target source.

    With sizes also available_tokens, the tokens of the source, and unused_tokens, those of documents left out.
    """
    target = (
        mix_target.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"))
    )
    used = mixture.groupBy("source").agg(
        F.count("*").alias("docs_used"),
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"),
        F.max("copies").alias("most_repeats"),
        F.sum("tokens").alias("once"),
    )
    joined = target.join(used, "source", "left").na.fill(0, ["docs_used", "tokens_used", "most_repeats", "once"])
    total = F.sum("tokens_used").over(Window.partitionBy())  # one row per target source
    share = F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0))
    shown = ["source", "target_share", "actual_share", "docs_used", "tokens_used", "most_repeats"]
    if sizes is not None:
        there = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
        joined = joined.join(there, "source", "left").na.fill(0, ["available_tokens"])
        joined = joined.withColumn("unused_tokens", F.col("available_tokens") - F.col("once"))
        shown += ["available_tokens", "unused_tokens"]
    return joined.withColumn("actual_share", share).select(*shown)
