"""Plans that must not depend on Spark's guesses of sizes: rows made from small tables may be many."""

import datetime as dt
import re
import time

from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.identifiers import packed_id, unpacked_id
from threatloom.operators import stix as S
from threatloom.operators import suricata as R
from threatloom.operators.joins import TASK_ROWS, spread
from threatloom.operators.numbering import number_rows
from threatloom.plans import full_run
from threatloom.queries import stix_queries as Q
from threatloom.session import checkpointed
from threatloom.sources import bundles

T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def objects_of(spark, rows=40):
    iocs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.col("id").cast("string"), F.lit(end)).alias("value")) for kind, end in (("domain", ".net"), ("md5", "x"))])
    entries = spark.range(rows).select(
        F.lit("Feed").alias("source_name"), F.lit("https://f.example.org/1").alias("source_url"), F.lit("t").alias("title"), F.lit("c").alias("content"),
        F.lit(T0).alias("collected_at"), F.col("id").alias("entry_ord"), iocs.alias("iocs"),
    )
    return R.object_fields(S.bundle_objects(checkpointed(S.with_observables(entries))))


def test_rule_rows_send_nothing_to_the_driver(spark):
    rows = R.rule_rows(objects_of(spark), ["source_name"])
    assert "Broadcast" not in plan(rows)
    assert rows.count() == 40


def test_tasks_do_not_grow_with_the_rows(spark):
    rows = spark.range(0, 1_000_000, 1, numPartitions=9)  # more splits than cores, as a large file has
    tasks = spread(rows).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(tasks) == 1_000_000 and max(tasks) <= 1.1 * TASK_ROWS


def test_shuffles_start_from_more_partitions_with_more_rows(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(name)
    try:
        ids = lambda rows: plan(spread(spark.range(0, rows, 1, numPartitions=9)).groupBy((F.col("id") * 7).alias("key")).count())
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        assert re.search(rf"hashpartitioning\(\S+, {usual}\)", ids(1_000))
        assert re.search(r"hashpartitioning\(\S+, 40\)", ids(1_000_000))
        assert re.search(r"hashpartitioning\(\S+, 40\)", ids(1_000))  # never lowered
    finally:
        spark.conf.unset(name)


def test_ids_are_packed_one_to_one(spark):
    uuid = "0123abcd-4567-5ef0-89ab-cdef01234567"
    ids = [f"url--{uuid}", f"--{uuid}", uuid, f"url--{uuid.upper()}", f"url--{uuid}\n", f"url--{uuid}--{uuid}", f"url-{uuid}", f"é--{uuid}", "", "x1", "--", None, "\x01", "url--" + "0" * 36]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "n int, id string").withColumn("packed", packed_id(F.col("id")))
    found = rows.select("id", "packed", unpacked_id(F.col("packed")).alias("back")).collect()
    assert [r.back for r in found] == [r.id for r in found]
    assert len({r.packed and bytes(r.packed) for r in found}) == len(ids)
    assert len(found[0].packed) == 1 + 16 + len("url--")


def test_readers_of_reports_build_no_observables(spark):
    entries = Q.stix_entries(spark, "/root/testdata/sf0.001")
    assert "checkpoint" not in entries._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" not in entries._jdf.queryExecution().optimizedPlan().toString()
    refs = R.reports_by_ref(R.object_fields(S.bundle_objects(entries)), ["source_name"])
    assert "Join" not in plan(refs) and "hashpartitioning" not in plan(refs)


def test_rules_read_objects_and_references_once(spark):
    text = plan(R.rule_rows(objects_of(spark), ["source_name"]))
    assert text.count("Join") == text.count("ShuffledHashJoin") == 2  # content to places, references to indicators
    assert "SortMergeJoin" not in text and "ObjectHashAggregate" not in text


def test_rules_of_shared_indicators_and_odd_objects(spark):
    schema = "source_name string, type string, id string, value string, object_refs array<string>, external_references array<struct<url:string>>"
    many = [("A", "report", f"report--{i}", None, ["hot", "x1", "other"], [(f" https://r/{i} ",), (" ",), (None,)]) for i in range(3000)]
    rows = many + [
        ("A", "ipv4-addr", "hot", "1.1.1.1", None, None), ("A", "domain-name", "x1", " a.b ", None, None), ("A", "domain-name", "x2", "  ", None, None),
        ("A", "domain-name", "alone", "c.d", None, None), ("A", "url", "other", "https://u", None, None), ("B", "ipv4-addr", "hot", "1.1.1.1", None, None),
        ("B", "report", "report--b", None, ["hot"], [(" ",)]), ("B", "report", "report--c", None, None, None),
    ]
    found = {tuple(r) for r in R.rule_rows(spark.createDataFrame(rows, schema), ["source_name"]).collect()}
    none = V.NO_REFERENCE_URL
    want = {(kind, value, f"https://r/{i}") for i in range(3000) for kind, value in (("ipv4", "1.1.1.1"), ("domain", "a.b"))}
    assert found == want | {("domain", "c.d", none), ("ipv4", "1.1.1.1", none)}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle")}


def freed(spark, before):
    """No shuffle files are left but those of before; they are deleted in the background."""
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return True
        time.sleep(0.2)
    return False


def test_stored_results_leave_no_shuffles(spark, tmp_path):
    objects = S.bundle_objects(Q.stix_entries(spark, "/root/testdata/sf0.001"))
    before = shuffle_files(spark)
    bundles.write_bundles(objects, str(tmp_path / "bundles"))
    assert freed(spark, before)
    assert bundles.read_bundle_lines(spark, str(tmp_path / "bundles")).count() == objects.count()
    before = shuffle_files(spark)
    numbered = number_rows(spark.range(0, 5000, 1, numPartitions=5), ["id"], "n")
    assert freed(spark, before)
    assert numbered.filter("id <> n").isEmpty()


def test_shared_stages_of_a_run_leave_no_shuffles_and_entries_are_not_stored(spark):
    before = shuffle_files(spark)
    table = full_run.in_memory("replay", lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("key")).count())
    assert freed(spark, before)
    assert table.count() == 7
    made = spark.range(3)
    assert full_run.in_memory("entries", lambda: made) is made
