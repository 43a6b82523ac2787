"""Processing only new or changed records (problem 2).

A record is a file change; its *version* is the content (change_set_id, path, status, both hashes). Each run of
the consumer covers a stretch of a root's chain of revisions. A change set is a transaction: it is open beyond the start
of the last succeeded run that covers it. What the next run must process is found in three steps. A narrow scan (keys and
landing times alone) keeps the rows beyond that point; with the mark of an earlier call it starts at the oldest
transaction open then, as a filter pushed to the file scan. The wide columns are reread for the change ids so found and
no others. Their key-and-version pairs are anti-joined with the ledger of what the runs have processed.

Chains are ranked by pointer doubling and stretches are matched through dyadic blocks, so a root with a third of all
rows is never gathered in one task and no run is paired with every change set of its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactframe.session import cut

CONTENT = ("change_set_id", "path", "status", "baseline_sha256", "working_sha256")
#: Chains longer than 2**MAX_DOUBLINGS are not ranked further; also the guard against cyclic chains.
MAX_DOUBLINGS = 40
#: Change ids (one number each) up to which the open ones are broadcast, counted first; beyond, both sides are exchanged.
FEW_IDS = 1_000_000


def version_of(*columns: str) -> Column:
    """16-byte hash over columns in which null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def contents(file_change: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per (change_id, version) with the earliest landing of that content, null where none is known.

    Rows without change_id, and those of other change ids than `ids` where given, are left out. Repeated rows collapse.
    Contents become versions before any exchange.
    """
    rows = file_change.where(F.col("change_id").isNotNull()).select(
        "change_id", version_of(*CONTENT).alias("version"), "landed_at", "root_id", "change_set_id"
    )
    if ids is not None:
        rows = rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "change_id", "left_semi")
    return (
        rows.groupBy("change_id", "version")
        .agg(
            F.min("landed_at").alias("landed"),
            F.min("root_id").alias("root_id"),
            F.min("change_set_id").alias("change_set_id"),
        )
    )


def current_contents(found: DataFrame) -> DataFrame:
    """Of several contents of a change the one that landed last, before it those of unknown landing; ties go to the larger
    version hash."""
    best = F.max(F.struct("landed", "version", "root_id", "change_set_id")).alias("b")
    return found.groupBy("change_id").agg(best).select("change_id", "b.*")


def chain_positions(change_set: DataFrame, start: str = "initial") -> DataFrame:
    """(root_id, revision, pos): steps from the root's start revision along baseline -> working links.

    Pointer doubling: after round k every revision knows its 2**k-th ancestor, so a chain of n change sets takes
    about log2(n) joins. Revisions that do not hang on the start, or lie in a cycle, are left out. Where a working
    revision names several baselines the smallest counts.
    """
    links = (
        change_set.where(
            F.col("root_id").isNotNull() & F.col("working_revision").isNotNull() & F.col("baseline_revision").isNotNull()
        )
        .where(F.col("working_revision") != start)
        .groupBy("root_id", F.col("working_revision").alias("revision"))
        .agg(F.min("baseline_revision").alias("up"))
        .withColumn("pos", F.lit(1).cast("bigint"))
    )
    links = cut(links)
    total = links.count()
    for k in range(MAX_DOUBLINGS):
        if 1 << k > 2 * total or links.where(F.col("up") != start).isEmpty():  # what is open beyond that lies in a cycle
            break
        above = links.select("root_id", F.col("revision").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"))
        links = links.join(above, ["root_id", "up"], "left").select(
            "root_id",
            "revision",
            F.when(F.col("up") == start, F.lit(start)).otherwise(F.col("up2")).alias("up"),
            F.when(F.col("up") == start, F.col("pos")).otherwise(F.col("pos") + F.col("pos2")).alias("pos"),
        )
        links = cut(links)
    return links.where(F.col("up") == start).select("root_id", "revision", "pos")


def _blocks(lo: Column, hi: Column) -> Column:
    """Dyadic blocks (level, index) that together cover the integers lo+1 .. hi (segment-tree decomposition)."""
    empty = F.array().cast("array<struct<level:int,block:bigint>>")

    def step(acc: Column, k: Column) -> Column:
        left, right = acc["l"], acc["r"]
        add_l = (left < right) & (left % 2 == 1)
        left2 = F.when(add_l, left + 1).otherwise(left)
        add_r = (left2 < right) & (right % 2 == 1)
        right2 = F.when(add_r, right - 1).otherwise(right)
        node = lambda at: F.array(F.struct(k.cast("int").alias("level"), at.cast("bigint").alias("block")))
        out = F.concat(
            acc["out"], F.when(add_l, node(left)).otherwise(empty), F.when(add_r, node(right2)).otherwise(empty)
        )
        return F.struct(
            F.floor(left2 / 2).cast("bigint").alias("l"), F.floor(right2 / 2).cast("bigint").alias("r"), out.alias("out")
        )

    init = F.struct((lo + 1).cast("bigint").alias("l"), (hi + 1).cast("bigint").alias("r"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DOUBLINGS)), init, step, lambda acc: acc["out"])


def covered_until(change_set: DataFrame, positions: DataFrame, runs: DataFrame) -> DataFrame:
    """(root_id, change_set_id, covered): the latest start of a succeeded run whose stretch holds the change set.

    A run covers positions above its baseline up to its working revision. `covered` is null where no run does.
    """
    at = positions.select("root_id", F.col("revision").alias("working_revision"), "pos")
    placed = (
        change_set.select("root_id", "change_set_id", "working_revision").distinct()
        .join(at, ["root_id", "working_revision"], "left")
        .select("root_id", "change_set_id", "pos")
    )
    good = runs.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull()).select(
        "root_id", "baseline_revision", "working_revision", "started_at"
    )
    low = positions.select("root_id", F.col("revision").alias("baseline_revision"), F.col("pos").alias("lo"))
    high = at.withColumnRenamed("pos", "hi")
    spans = (
        good.join(low, ["root_id", "baseline_revision"], "left")
        .withColumn("lo", F.when(F.col("baseline_revision") == "initial", F.lit(0)).otherwise(F.col("lo")))
        .join(high, ["root_id", "working_revision"])
        .where(F.col("lo") < F.col("hi"))
        .groupBy("root_id", "lo", "hi")
        .agg(F.max("started_at").alias("started"))
    )
    blocks = (
        spans.withColumn("b", F.explode(_blocks(F.col("lo"), F.col("hi"))))
        .groupBy("root_id", "b.level", "b.block")
        .agg(F.max("started").alias("started"))
    )
    blocks = cut(blocks)
    levels = blocks.select("level").distinct().orderBy("level").limit(MAX_DOUBLINGS + 1).collect()  # at most 41 values
    wanted = [r[0] for r in levels]
    if not wanted:
        return placed.select("root_id", "change_set_id", F.lit(None).cast("timestamp").alias("covered"))
    up = F.array(*[
        F.struct(F.lit(k).alias("level"), F.shiftright(F.col("pos"), k).cast("bigint").alias("block")) for k in wanted
    ])
    hits = (
        placed.where(F.col("pos").isNotNull())
        .withColumn("b", F.explode(up))
        .select("root_id", "change_set_id", "b.level", "b.block")
        .join(blocks, ["root_id", "level", "block"])
        .groupBy("root_id", "change_set_id")
        .agg(F.max("started").alias("covered"))
    )
    return placed.select("root_id", "change_set_id").join(hits, ["root_id", "change_set_id"], "left").groupBy(
        "root_id", "change_set_id"
    ).agg(F.max("covered").alias("covered"))


def open_rows(file_change: DataFrame, cover: DataFrame, since: int | None = None) -> DataFrame:
    """(change_id, landed_at) of the rows that no run is known to have processed: beyond the last start that covers their
    change set, of an uncovered or unknown one, or without a landing time. Keys and times alone are read.

    since (in microseconds): nothing that landed before is open; a filter on landed_at, pushed to the scan.
    """
    rows = file_change.where(F.col("change_id").isNotNull()).select("root_id", "change_set_id", "change_id", "landed_at")
    if since is not None:
        rows = rows.where((F.col("landed_at") >= F.timestamp_micros(F.lit(since).cast("bigint"))) | F.col("landed_at").isNull())
    closed = cover.where(F.col("covered").isNotNull())
    marked = rows.join(closed, ["root_id", "change_set_id"], "left")
    return marked.where("covered is null or landed_at is null or landed_at > covered").select("change_id", "landed_at")


def pending_changes(change_set: DataFrame, file_change: DataFrame, doc_run: DataFrame, mark: DataFrame | None = None) -> DataFrame:
    """(root_id, change_id, version, change_set_id, landed): every file change the next run still has to process.

    Done is a change whose counting content landed no later than the start of a succeeded run that covers its change
    set. mark: what `mark_of` gave for an earlier call, to read from the oldest transaction open then; it is dropped where
    a run it counted on was withdrawn. Nulls: rows without change_id are left out; a change without landing time, or whose
    root or change set is unknown, is pending. Empty tables give no rows (no changes) or all changes (no runs). Extra
    columns are ignored.
    """
    cover = cut(covered_until(change_set, chain_positions(change_set), doc_run))
    since = None if mark is None else _floor(mark, doc_run)
    ids = cut(open_rows(file_change, cover, since).select("change_id").distinct())
    least, most = ids.agg(F.min("change_id"), F.max("change_id")).first()
    wide = file_change.where(F.lit(False) if least is None else F.col("change_id").between(least, most))  # pushed to the scan
    found = contents(wide, ids)
    known = cut(found.join(cover, ["root_id", "change_set_id"], "left"))
    ledger = known.where(F.col("landed") <= F.col("covered")).select("change_id", "version")
    return current_contents(known).join(ledger, ["change_id", "version"], "left_anti").select(
        "root_id", "change_id", F.lower(F.hex("version")).alias("version"), "change_set_id", "landed"
    )


_RUN = ("run_id", "root_id", "baseline_revision", "working_revision", "started_at")


def _succeeded(doc_run: DataFrame) -> DataFrame:
    return doc_run.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull()).select(*_RUN).distinct()


def mark_of(pending: DataFrame, file_change: DataFrame, doc_run: DataFrame) -> DataFrame:
    """(run columns, floor): the succeeded runs that `pending` rests on and the oldest landing it left open.

    To be written once the run that processes `pending` has succeeded, or at any earlier time: a mark that is too old
    only means more reading. With nothing open the floor is the newest landing; without runs there is no mark. It holds as
    long as change sets and changes are only added, the latter with later landing times than the floor.
    """
    floor = pending.agg(F.min(F.unix_micros("landed"))).first()[0]
    if floor is None:
        floor = file_change.agg(F.max(F.unix_micros("landed_at"))).first()[0]
    return _succeeded(doc_run).withColumn("floor", F.timestamp_micros(F.lit(floor).cast("bigint")))


def _floor(mark: DataFrame, doc_run: DataFrame) -> int | None:
    """The mark's floor, null where there is none or a run it counts on has been withdrawn or altered since."""
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _RUN]
    if not mark.alias("m").join(_succeeded(doc_run).alias("r"), on, "left_anti").isEmpty():
        return None
    row = mark.select(F.unix_micros("floor").alias("floor")).first()
    return row.floor if row else None
