"""Input of the run queries."""

from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.queries import corpora as C
from threatloom.queries import run_queries as R

SF_DIR = "/root/testdata/sf0.001"


def test_entry_pages_are_built_in_their_row_without_a_join(spark):
    pages = R.entry_pages(spark, SF_DIR)
    assert "Join" not in pages._jdf.queryExecution().optimizedPlan().toString()
    joined = None
    for profile in (V.S1, V.SL, V.PP):
        orders = R._orders(spark, SF_DIR).filter(F.expr(R._PROFILE.format("c")) == profile)
        part = orders.select("k", C.fill(R._LINKS[profile][0]).alias("url")).join(C.entry_pages(spark, SF_DIR, profile).select("k", "html"), "k")
        joined = part if joined is None else joined.unionByName(part)
    bodies = joined.filter("k % 17 <> 0 and k % 19 <> 0 and k % 29 <> 0").select("url", F.encode("html", "UTF-8").alias("content"))
    found = pages.select("url", "content").filter("length(content) > 100")
    assert found.count() == bodies.count() > 0
    assert found.exceptAll(bodies).isEmpty()
