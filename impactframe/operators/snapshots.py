"""What changed between full snapshots (problem 3), and comparison of two snapshots.

Every key is windowed by its snapshot index: a lagged hash reveals a modification, a gap in the index a removal and
a later addition. The window is partitioned by (root, path), so a root with a third of the rows spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.session import cut

#: Rows of the snapshot list (four numbers each) up to which it is broadcast, counted first; beyond, its join is salted.
LISTED = 1_000_000
#: Copies of the snapshot list in the salted join, so that a hot root spreads.
SALTS = 16


def posix_path(path: Column) -> Column:
    """Normalised project-relative POSIX path: backslashes, doubled and `.` parts, `..` and a leading root removed."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    clean = F.filter(parts, lambda p: (p != "") & (p != "."))
    plain = F.array_join(clean, "/")
    climbed = F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    return F.when(F.array_contains(clean, ".."), F.array_join(climbed, "/")).otherwise(plain)


def hex_value(digest: Column) -> Column:
    """Text that is equal for equal hexadecimal numbers: letter case, 0x, blanks and leading zeros do not count."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), "^0x", "")
    return F.regexp_replace(bare, "^0+(?=.)", "")


def packed_hash(digest: Column) -> Column:
    """struct(bytes, digits) in half the size of `hex_value`, with its equality and order; other text keeps its own bytes."""
    text = hex_value(digest)
    even = F.rpad(text, 2 * F.ceil(F.length(text) / 2).cast("int"), F.lit("0"))
    hexed = text.rlike("^[0-9a-f]+$")
    return F.struct(
        F.when(hexed, F.unhex(even)).otherwise(F.encode(text, "UTF-8")).alias("bytes"),
        F.when(hexed, F.length(text)).otherwise(-F.length(text)).alias("digits"),
    )


def _snapshot_list(rows: DataFrame) -> DataFrame:
    """(root_id, snapshot_no, idx, next_no) of every delivered snapshot."""
    order = Window.partitionBy("root_id").orderBy("snapshot_no")
    return rows.select("root_id", "snapshot_no").distinct().select(
        "root_id", "snapshot_no", F.row_number().over(order).alias("idx"), F.lead("snapshot_no").over(order).alias("next_no")
    )


def snapshot_differences(file_state: DataFrame) -> DataFrame:
    """(root_id, snapshot_no, path, status): differences of each snapshot from the root's preceding delivered one.

    Of several rows for a path in a snapshot the latest delivered_at counts (then the larger hash; a null delivered_at
    is oldest). A path is present where file_exists is true; null counts as absent. Two null hashes are equal, a null
    and another are not. Rows without root_id, snapshot_no or path are left out. A root's first snapshot gives nothing.

    The states are exchanged once, by (root_id, path), which serves both the choice of the latest row and the window.
    """
    keyed = file_state.where(F.col("root_id").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("path").isNotNull())
    states = (
        keyed.select(
            "root_id",
            posix_path(F.col("path")).alias("path"),
            "snapshot_no",
            F.struct("delivered_at", F.coalesce("file_exists", F.lit(False)).alias("here"), packed_hash(F.col("sha256")).alias("hash")).alias("s"),
        )
        .repartition("root_id", "path")
        .groupBy("root_id", "path", "snapshot_no")
        .agg(F.max("s").alias("s"))
        .where("s.here")
        .select("root_id", "path", "snapshot_no", F.col("s.hash").alias("hash"))
    )
    listed = cut(_snapshot_list(keyed))
    if listed.count() <= LISTED:
        indexed = states.join(F.broadcast(listed), ["root_id", "snapshot_no"])
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
        indexed = states.withColumn("salt", salt).join(salted, ["root_id", "snapshot_no", "salt"])
    by_key = Window.partitionBy("root_id", "path").orderBy("snapshot_no")
    lagged = indexed.select(
        "root_id", "path", "snapshot_no", "idx", "next_no", "hash",
        F.lag("idx").over(by_key).alias("before"),
        F.lag("hash").over(by_key).alias("was"),
        F.lead("idx").over(by_key).alias("after"),
    )
    came = (F.col("idx") > 1) & (F.col("before").isNull() | (F.col("before") < F.col("idx") - 1))
    edited = (F.col("before") == F.col("idx") - 1) & ~F.col("hash").eqNullSafe(F.col("was"))
    gone = F.col("next_no").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1))
    event = lambda no, status: F.struct(F.col(no).alias("snapshot_no"), F.lit(status).alias("status"))
    events = F.array_compact(
        F.array(
            F.when(came, event("snapshot_no", "added")).when(edited, event("snapshot_no", "modified")),
            F.when(gone, event("next_no", "deleted")),
        )
    )
    return lagged.select("root_id", "path", F.explode(events).alias("e")).select(
        "root_id", "e.snapshot_no", "path", "e.status"
    )
