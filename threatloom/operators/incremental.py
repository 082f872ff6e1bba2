"""What is new since a feed's last kept index snapshot.

A feed may hold a large share of all rows, so no step gathers a feed: previous rows are found with a
window per key and day plus one over the days, and the replay of a history is an associative scan over blocks of
BLOCK snapshots, which knows no feeds at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.expressions import empty_array, let
from threatloom.operators.joins import may_be_among
from threatloom.operators.numbering import number_rows
from threatloom.session import checkpointed

#: Snapshots of one block of a replay, and blocks or nodes under one node of the tree above them.
BLOCK, FAN = 256, 32
_STEPS = "struct<oldest:timestamp,exit:timestamp>"


def previous_value(df: DataFrame, keys: list[str], order: str, bucket: Column, name: str) -> DataFrame:
    """Add ``name``: the ``order`` value of the row before, among rows with equal keys.

    ``bucket`` must not decrease with ``order``. The window sees one bucket at a time; the last value of
    each bucket is handed to the next bucket that has rows.
    """
    rows = df.withColumn("_bucket", bucket)
    within = Window.partitionBy(*keys, "_bucket").orderBy(order)
    ends = rows.groupBy(*keys, "_bucket").agg(F.max(order).alias("_end"))
    handed = ends.select(
        *keys, "_bucket", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_handed")
    )
    found = rows.withColumn(name, F.lag(order).over(within)).join(handed, [*keys, "_bucket"], "left")
    return found.withColumn(name, F.coalesce(name, "_handed")).drop("_bucket", "_handed")


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Add ``previous_at`` and ``previous_sha256_hex``: the snapshot before, of the same source and kind; null for the first.

    Snapshots of one time stand in the order of their digests.
    """
    rows = snapshots.withColumn("_at", F.struct("collected_at", "sha256_hex"))
    found = previous_value(rows, ["source_name", "snapshot_kind"], "_at", F.to_date("collected_at"), "_previous")
    before = {"previous_at": F.col("_previous.collected_at"), "previous_sha256_hex": F.col("_previous.sha256_hex")}
    return found.withColumns(before).drop("_at", "_previous")


def diff_entries(current: DataFrame, previous: DataFrame, digests: bool = False) -> DataFrame:
    """Entries of ``current`` whose URL the snapshot named by their ``previous_at`` does not list.

    With ``digests`` that snapshot is named by ``previous_sha256_hex`` as well, for sources with several of one time.
    Without a previous snapshot everything is new. The join key holds the URL, so no source is a hot key.
    """
    named = {"collected_at": "previous_at"} | ({"sha256_hex": "previous_sha256_hex"} if digests else {})
    listed = previous.select("source_name", *(F.col(a).alias(b) for a, b in named.items()), "publication_url")
    return current.join(listed, ["source_name", *named.values(), "publication_url"], "left_anti")


def _is_new(last_seen: Column, baseline: Column) -> Column:
    return baseline.isNull() | last_seen.isNull() | (last_seen < baseline)


def _first_steps(snaps: Column) -> Column:
    """Snapshots older, by ``oldest``, than all before them: the only ones that a block's first step can land on."""
    older = lambda low, s: low.isNotNull() & (s["oldest"].isNull() | (s["oldest"] < low))
    return F.aggregate(
        snaps,
        empty_array("struct<place:bigint,collected_at:timestamp,oldest:timestamp>"),
        lambda found, s: F.when(
            (F.size(found) == 0) | let(F.element_at(found, -1)["oldest"], lambda low: older(low, s)), F.concat(found, F.array(s))
        ).otherwise(found),
    )


def _advance(baseline: Column, snap: Column) -> Column:
    return F.when(_is_new(snap["oldest"], baseline), snap["collected_at"]).otherwise(baseline)


def _block_steps(snaps: Column) -> Column:
    """A block as a step function of the baseline that it is entered with.

    Entered with b it leaves with the ``exit`` of the first step whose ``oldest`` is before b (null is before all),
    and with b itself if there is none. A baseline is older than the block, so steps that are not cannot be the first.
    """

    def with_exit(step: Column) -> Column:
        rest = F.filter(snaps, lambda s: s["place"] > step["place"])
        last = F.aggregate(rest, step["collected_at"], _advance)
        return F.struct(step["oldest"].alias("oldest"), last.alias("exit"))

    own_run = lambda s: s["oldest"].isNull() | (s["oldest"] < F.element_at(snaps, 1)["collected_at"])
    return _merged(F.transform(F.filter(_first_steps(snaps), own_run), with_exit))


def _merged(steps: Column) -> Column:
    """Of neighbours with one exit the oldest says it all."""
    after = lambda i: F.get(steps, i + 1)["exit"]
    return F.filter(steps, lambda s, i: after(i).isNull() | (after(i) != s["exit"]))


def _leave(steps: Column, baseline: Column) -> Column:
    return F.coalesce(F.get(F.filter(steps, lambda s: _is_new(s["oldest"], baseline)), F.lit(0))["exit"], baseline)


def _composed(children: Column) -> Column:
    """The step function of blocks or nodes that follow each other."""

    def then(steps: Column, child: Column) -> Column:
        through = F.transform(steps, lambda s: F.struct(s["oldest"].alias("oldest"), _leave(child["steps"], s["exit"]).alias("exit")))
        low = F.get(steps, F.size(steps) - 1)["oldest"]
        later = F.filter(child["steps"], lambda s: (F.size(steps) == 0) | (low.isNotNull() & (s["oldest"].isNull() | (s["oldest"] < low))))
        return _merged(F.concat(through, later))

    return F.aggregate(children, empty_array(_STEPS), then)


def _entered(blocks: DataFrame) -> DataFrame:
    """(node, entry_at) of blocks (node, steps): baselines that blocks are entered with, by a reduction tree and back down."""
    level, count, tree = blocks.select("node", "steps"), blocks.count(), []
    while count > 1:
        nodes = level.groupBy(F.expr(f"node div {FAN}").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "steps"))).alias("children"))
        tree.append(checkpointed(nodes.select(F.col("parent").alias("node"), "children", _composed(F.col("children")).alias("steps"))))
        level, count = tree[-1].select("node", "steps"), -(-count // FAN)
    entered = level.select("node", F.lit(None).cast("timestamp").alias("entry_at"))
    for nodes in reversed(tree):

        def through(state: Column, child: Column) -> Column:
            here = F.struct(child["node"].alias("node"), state["baseline"].alias("entry_at"))
            return F.struct(_leave(child["steps"], state["baseline"]).alias("baseline"), F.concat(state["rows"], F.array(here)).alias("rows"))

        start = F.struct(F.col("entry_at").alias("baseline"), empty_array("struct<node:bigint,entry_at:timestamp>").alias("rows"))
        rows = F.aggregate("children", start, through, lambda state: state["rows"])
        entered = nodes.select("node", "children").join(entered, "node").select(F.inline(rows))
    return entered


def replay_history(entries: DataFrame, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Replay index snapshots in time order, dropping those that bring nothing new.

    ``entries`` holds (source_name, collected_at, publication_url), one row per listed URL. A dropped
    snapshot never becomes the baseline. Returns (snapshots, entries): snapshots with ``baseline_at`` and
    ``kept``, and the entries with ``baseline_at``, ``kept`` and ``is_new``.

    A snapshot at b brings something new over baseline k exactly when one of its URLs was last seen before
    k: all snapshots between them were dropped, so they list nothing that k does not. Per snapshot one value
    is enough, the oldest "last seen" of its URLs, and the baselines are a chain over these values.

    All snapshots are numbered in the order of (source, time) and cut into blocks of BLOCK. A block is a step function of the
    baseline; such functions are composed in a tree, and the baselines that blocks are entered with come back down
    it. A source's first snapshot is new over anything, so the chain starts afresh there by itself: how many snapshots a source has
    in all, or on a day, makes no difference.
    """
    key = ["source_name", "collected_at"]
    day = F.to_date("collected_at") if bucket is None else bucket
    seen = previous_value(entries, ["source_name", "publication_url"], "collected_at", day, "last_seen")
    snapshots = seen.groupBy(*key).agg(
        # Null, the oldest of all, when a URL is seen for the first time.
        F.when(~F.bool_or(F.col("last_seen").isNull()), F.min("last_seen")).alias("oldest")
    )
    placed = number_rows(snapshots, key, "place").withColumn("node", F.expr(f"place div {BLOCK}"))
    snap = F.struct("place", "source_name", "collected_at", "oldest")
    blocks = placed.groupBy("node").agg(F.sort_array(F.collect_list(snap)).alias("snaps"))
    narrow = F.transform("snaps", lambda s: F.struct(*[s[name].alias(name) for name in ("place", "collected_at", "oldest")]))
    steps = let(narrow, _block_steps)
    blocks = checkpointed(blocks.withColumn("steps", steps))

    # A source's first snapshot has no baseline; whose baseline a block is entered with, the block before tells.
    before = blocks.select((F.col("node") + 1).alias("node"), F.element_at("snaps", -1)["source_name"].alias("source_before"))

    def within_block(state: Column, snap: Column) -> Column:
        own = F.when(state["source_name"].eqNullSafe(snap["source_name"]), state["baseline"])
        row = F.struct(
            snap["source_name"].alias("source_name"), snap["collected_at"].alias("collected_at"), own.alias("baseline_at"),
            _is_new(snap["oldest"], own).alias("kept"),
        )
        return F.struct(
            snap["source_name"].alias("source_name"), _advance(own, snap).alias("baseline"), F.concat(state["rows"], F.array(row)).alias("rows")
        )

    row_type = "struct<source_name:string,collected_at:timestamp,baseline_at:timestamp,kept:boolean>"
    opened = F.struct(F.col("source_before").alias("source_name"), F.col("entry_at").alias("baseline"), empty_array(row_type).alias("rows"))
    rows = F.aggregate("snaps", opened, within_block, lambda state: state["rows"])
    replayed = blocks.join(_entered(blocks), "node").join(before, "node", "left").select(F.inline(rows))
    judged = (
        seen.join(replayed, key)
        .withColumn("is_new", F.col("kept") & _is_new(F.col("last_seen"), F.col("baseline_at")))
        .drop("last_seen")
    )
    return replayed, judged


def compact_snapshots(snapshots: DataFrame, replayed: DataFrame) -> DataFrame:
    """Stored index snapshots without those a replay found redundant."""
    redundant = replayed.filter(~F.col("kept")).select("source_name", "collected_at")
    return snapshots.join(redundant, ["source_name", "collected_at"], "left_anti")


def match_entries(new_entries: DataFrame, landed: DataFrame) -> DataFrame:
    """New entries with one landed page of their URL; the page's own columns come along.

    A sketch of the new URLs drops other pages where they are read, so their bodies are in no shuffle. Of the pages of a URL the last
    by ``landed_at`` counts, if there is such a column; ties go to the largest hash of the row. It is chosen on these two values;
    bodies are joined to the chosen ones last.
    """
    wanted = checkpointed(new_entries.select(F.col("publication_url").alias("url")).filter("url is not null").distinct())
    own = [F.col(name) for name in landed.columns if name != "url"]
    pages = may_be_among(landed.withColumn("_hash", F.xxhash64(*own)), "url", wanted)
    order = F.struct(*[F.col(name) for name in landed.columns if name == "landed_at"], F.col("_hash"))
    chosen = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.max(order)["_hash"].alias("_hash"))
    # The hash covers the whole row, so rows equal in it are repeats.
    bodies = pages.join(chosen, ["url", "_hash"], "left_semi").dropDuplicates(["url", "_hash"]).drop("_hash")
    return new_entries.join(bodies, new_entries["publication_url"] == bodies["url"])


def missing_entries(new_entries: DataFrame, landed: DataFrame) -> DataFrame:
    """New entries whose page did not land."""
    return new_entries.join(landed, new_entries["publication_url"] == landed["url"], "left_anti")
