"""Stored runs, the run history, the status document and deletion from the snapshot store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from threatloom.plans import run_store
from threatloom.sources import run_history, snapshots

T0 = dt.datetime(2024, 5, 1, 6)


class Stopped(Exception):
    pass


class StoppingStore(run_store.RunStore):
    """Ends after a stage was committed."""

    after = ""

    def commit(self, run, stage, schema=""):
        super().commit(run, stage, schema)
        if stage == self.after:
            raise Stopped


def _page(links):
    return "<main>" + "".join(f'<h3><a href="https://r.example.com/{x}/1/">Post {x}</a></h3>' for x in links) + "</main>"


def _tables(spark):
    feeds = spark.createDataFrame([("A", "https://r.example.com/all/", "sl", True), ("B", "https://r.example.com/all/", "sl", True)], "name string, index_url string, profile string, enabled boolean")
    days = [("A", 0, "ab"), ("A", 1, "a"), ("A", 2, "ac"), ("A", 3, "b"), ("B", 0, "a"), ("B", 3, "ad")]
    rows = [(s, "https://r.example.com/all/", _page(links).encode(), "utf-8", T0 + dt.timedelta(days=n)) for s, n, links in days]
    rows.append(("B", "https://r.example.com/all/", b"  ", "utf-8", T0 + dt.timedelta(days=1)))
    index = spark.createDataFrame(rows, "source_name string, url string, content binary, encoding string, collected_at timestamp")
    body = lambda x: f'<main><article><h1>Post {x}</h1><div class="post-content"><h2>Indicators of Compromise</h2><p>{ord(x)}.8.8.8</p></div></article></main>'
    pages = spark.createDataFrame([(f"https://r.example.com/{x}/1/", body(x).encode(), None) for x in "abc"], "url string, content binary, encoding string")
    return feeds, index, pages


def _shown(rows):
    return sorted((r.source_name, r.generated_at, r.snapshot_deleted, r.new_index_entries, r.fetched_entries, r.parsed_entries, r.stix_object_count, r.succeeded, r.snapshot_locator, r.stix_bundle_locator) for r in rows)


def _key(row):
    return tuple(str(x) for x in row)


def test_runs_go_on_after_a_stop_and_start_from_stored_baselines(spark, tmp_path):
    feeds, index, pages = _tables(spark)
    early = F.col("collected_at") < F.lit(T0 + dt.timedelta(days=2))
    one = run_store.RunStore(spark, str(tmp_path / "one"))
    whole = run_store.run_and_store(one, "all", feeds, index, pages)
    store = StoppingStore(spark, str(tmp_path / "two"))
    for store.after in ("replay", "objects", "bundle files"):
        with pytest.raises(Stopped):
            run_store.run_and_store(store, "1", feeds, index.where(early), pages)
    written = {f.stat().st_mtime_ns for f in (tmp_path / "two/tables/replay/run=1").iterdir()}
    store.after = ""
    run_store.run_and_store(store, "1", feeds, index.where(early), pages)
    assert written == {f.stat().st_mtime_ns for f in (tmp_path / "two/tables/replay/run=1").iterdir()}  # read, not made again
    second = run_store.run_and_store(store, "2", feeds, index.where(~early), pages)
    history = run_history.load_runs(spark, f"{store.folder}/history").collect()
    want = run_history.load_runs(spark, f"{one.folder}/history").collect()
    assert len(want) == 7 and sorted(map(_key, _shown(history))) == sorted(map(_key, _shown(want)))
    kept = lambda folder: sorted((r.source_name, r.collected_at) for r in snapshots.load_snapshots(spark, f"{folder}/snapshots").collect())
    assert kept(one.folder) == kept(store.folder) == [("A", T0 + dt.timedelta(days=n)) for n in (0, 2, 3)] + [("B", T0 + dt.timedelta(days=n)) for n in (0, 3)]
    assert {r.stage for r in whole.failures.collect()} == {"fetch_index", "fetch_entry"}
    assert second.rules.count() > 0 and whole.rules.count() >= second.rules.count()
    # A third run with an older snapshot: it fails, and the baseline stays.
    late = index.where("source_name = 'A'").limit(1).withColumn("collected_at", F.lit(T0 - dt.timedelta(days=9)))
    third = run_store.run_and_store(store, "3", feeds, late, pages)
    assert [r.stage for r in third.failures.collect()] == ["diff_index"] and third.results.count() == 0


def test_history_merges_and_status_document(spark, tmp_path):
    schema = (
        "source_name string, source_url string, succeeded boolean, error_message string, snapshot_locator string, snapshot_deleted boolean, total_index_entries int, "
        "new_index_entries int, fetched_entries int, parsed_entries int, stix_bundle_locator string, stix_object_count int, generated_at timestamp"
    )
    row = lambda name, day, ok, n: (name, "u", ok, None if ok else 'a "b"', "s", False, n, n, n, n, None, n, T0 + dt.timedelta(days=day))
    first = spark.createDataFrame([row("A", 0, True, 1), row("B", 0, False, 2), row("A", 1, True, 3)], schema)
    again = spark.createDataFrame([row("B", 0, True, 5), row("C", 0, True, 6), row("C", 0, True, 6)], schema)
    path = str(tmp_path / "history")
    for results in (first, first, again, again):
        run_history.merge_runs(results, path)
    stored = run_history.load_runs(spark, path)
    assert sorted((r.source_name, r.total_index_entries) for r in stored.collect()) == [("A", 1), ("A", 3), ("B", 5), ("C", 6)]
    run_history.write_status(first.where("total_index_entries < 3"), str(tmp_path / "status"), config_path="c.json")
    lines = "".join(f.read_text("utf-8") for f in sorted((tmp_path / "status").glob("part-*")))
    document = json.loads(lines)
    assert (document["config_path"], document["total_sources"], document["succeeded_sources"], document["failed_sources"]) == ("c.json", 2, 1, 1)
    assert [s["source_name"] for s in document["sources"]] == ["A", "B"] and document["sources"][1]["error_message"] == 'a "b"'
    assert document["sources"][0]["stix_bundle_locator"] is None
    run_history.write_status(first.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text("utf-8") for f in sorted((tmp_path / "none").glob("part-*"))))["sources"] == []


def test_deletion_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, "index", T0 + dt.timedelta(days=n), f"{n}", b"x") for s in "ABC" for n in range(3)]
    schema = "source_name string, snapshot_kind string, collected_at timestamp, sha256_hex string, data binary"
    snapshots.write_snapshots(spark.createDataFrame(rows, schema), path)
    files = lambda s: {f.name for f in (tmp_path / f"store/source_key={s}").rglob("part-*")}
    before = {s: files(s) for s in "ABC"}
    gone = spark.createDataFrame([(*r[:3],) for r in rows if r[0] == "C" or (r[0] == "A" and r[3] == "1")], "source_name string, snapshot_kind string, collected_at timestamp")
    snapshots.delete_snapshots(gone, path)
    left = sorted((r.source_name, r.sha256_hex) for r in snapshots.load_snapshots(spark, path).collect())
    assert left == [("A", "0"), ("A", "2"), ("B", "0"), ("B", "1"), ("B", "2")]
    assert files("B") == before["B"] and not files("A") & before["A"] and not files("C")
    after = files("A")
    snapshots.delete_snapshots(gone, path)
    assert files("A") == after and snapshots.load_snapshots(spark, path).count() == 5


def test_small_rows_of_many_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = [(f"S{n}", "index", T0 + dt.timedelta(days=n), f"{n}", b"x") for n in range(64)]
    schema = "source_name string, snapshot_kind string, collected_at timestamp, sha256_hex string, data binary"
    snapshots.write_snapshots(spark.createDataFrame(rows, schema), str(tmp_path / "store"))
    tasks = lambda folder: {f.name[:10] for f in (tmp_path / folder).rglob("part-*.parquet")}
    assert snapshots.load_snapshots(spark, str(tmp_path / "store")).count() == 64 and len(tasks("store")) > 1
    runs = spark.createDataFrame([(r[0], r[2], 1) for r in rows], "source_name string, generated_at timestamp, n int")
    run_history.merge_runs(runs, str(tmp_path / "history"))
    assert run_history.load_runs(spark, str(tmp_path / "history")).count() == 64 and len(tasks("history")) > 1
