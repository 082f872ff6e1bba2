"""Hand-worked pages, histories and runs."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions import rules
from threatloom.operators import entry as E
from threatloom.operators import html as H
from threatloom.operators import incremental as I
from threatloom.operators import index as X
from threatloom.operators import stix as S
from threatloom.operators import suricata as R
from threatloom.operators.joins import may_be_among
from threatloom.operators.numbering import number_rows
from threatloom.plans.full_run import run_feeds
from threatloom.sources import bundles, registry, snapshots
from threatloom.sources import rules as rule_files
from threatloom.streaming import new_entries as N

T0 = dt.datetime(2024, 1, 1)


def entry_iocs(spark, html, profile):
    pages = spark.createDataFrame([("https://x.org/p", html, "Index title")], "source_url string, html string, index_title string")
    row = E.parse_entries(pages, profile).collect()[0]
    return row, [(i.kind, i.value) for i in row.iocs or []]


# ---------------------------------------------------------------- rules


KEPT = [
    ("ipv4", "9.9.9.9"), ("ipv4", "64.233.160.1"), ("ipv4_port", "185.12.64.1:8443"), ("ipv4", "192.0.0.9"), ("domain", "a1-b2.shop"),
    ("domain", "m.kernel-mirror.net"), ("url", "https://cdn.a1-b2.shop/x.bin"), ("url", "http://64.233.160.1:81/q"), ("ipv4", "224.0.0.1"),
    ("ipv4", "010.0.0.1"), ("md5", "anything"), ("tox id", "localhost"),
]
DROPPED = [
    *[("ipv4", a) for a in ("0.1.2.3", "10.77.0.9", "100.100.100.100", "127.8.8.8", "169.254.200.1", "172.31.255.1", "192.168.250.3", "198.18.3.3", "240.1.2.3")],
    ("ipv4_port", "10.1.1.1:8080"),
    *[("domain", d) for d in ("nodots", "nas.local", "two words.net", "site.net/login", "joe@site.net", "10.9.8.7", "trailing-.net", "localhost")],
    *[("url", u) for u in ("http://localhost/x", "ftp://nas.local/f", "https://172.20.1.1/", "http://10.9.8.7:8/", "http://nodots:99/", "just words", "http://[::1]/x")],
]


def test_rule_vectors(spark):
    df = spark.createDataFrame(KEPT + DROPPED, "kind string, value string")
    assert [(r.kind, r.value) for r in rules.filter_iocs(df).collect()] == KEPT
    assert rules.explain_drops(df).count() == len(DROPPED)
    only_domain = rules.filter_iocs(df, {"invalid_domain": rules.rule_domain})
    assert only_domain.count() == len(KEPT + DROPPED) - 8


# ---------------------------------------------------------------- pages


def test_tree_shape(spark):
    html = (
        "<!DOCTYPE html><div class='a  b'>x<br>y<p>one<p>two</div></i>&amp;&eacute;&#8217;&#146;&nosuch;"
        "<script>var t='</p>';</script><template>hid</template><ul><li/><li>z</ul><!-- c --><a href>q"
    )
    df = spark.createDataFrame([(1, html)], "k int, html string")
    rows = [(r.id, r.last, r.parent, r.tag, r.classes, r.text) for r in H.html_nodes(df, "k", "html").orderBy("id").collect()]
    assert rows == [
        (1, 4, 0, "div", "a b", "x y one two"),
        (2, 2, 1, "br", None, ""),
        (3, 4, 1, "p", None, "one two"),
        (4, 4, 3, "p", None, "two"),
        (5, 5, 0, "script", None, ""),
        (6, 6, 0, "template", None, ""),
        (7, 9, 0, "ul", None, "z"),
        (8, 8, 7, "li", None, ""),
        (9, 9, 7, "li", None, "z"),
        (10, 10, 0, "a", None, "q"),
    ]
    parsed = H.parse_html(df, "html").collect()[0]
    assert "&é’’&nosuch" in parsed.texts


SL_INDEX = """<html><body><main>
<h3><a href="https://research.example/night-heron/70001/">Night heron</a></h3>
<h3><a href="/tidal-lock/70002/">Tidal lock</a></h3>
<h3><a href="/all/">Everything</a></h3></main></body></html>"""


def test_index_pages(spark):
    def links(url, html, profile):
        pages = spark.createDataFrame([(url, html)], "source_url string, html string")
        return [(r.ord, r.title, r.publication_url) for r in X.index_entries(pages, profile).orderBy("ord").collect()]

    assert links("https://research.example/all/", SL_INDEX, V.SL) == [
        (1, "Night heron", "https://research.example/night-heron/70001/"),
        (2, "Tidal lock", "https://research.example/tidal-lock/70002/"),
    ]
    blog = f"https://{V.PP_HOST}/us/blog/threat-insight"
    html = f"""<main><article><h2><a href="/us/blog/threat-insight/holiday-lures">Holiday lures</a></h2></article>
    <article><h2><a href="{blog}/polyglot">Polyglot</a></h2></article><a href="/us/blog/threat-insight">Threat Insight</a></main>"""
    assert links(blog, html, V.PP) == [(1, "Holiday lures", f"{blog}/holiday-lures"), (2, "Polyglot", f"{blog}/polyglot")]
    html = '<article class="entry-content"><h2><a href="/post/101">Заголовок статьи</a></h2><h3>IPv4</h3></article>'
    assert links("http://bulletins.example/test", html, V.S1) == [(1, "Заголовок статьи", "http://bulletins.example/post/101")]
    assert links("http://bulletins.example/test", "<p>nothing</p>", V.S1) == []


def test_sl_entry(spark):
    md5, sha256 = hashlib.md5(b"heron").hexdigest(), hashlib.sha256(b"heron").hexdigest()
    html = f"""<main><article><h1>Night heron</h1><div class="post-content"><p>Birds of the night.</p>
    <h2>Appendix I – Indicators of Compromise</h2><h3>File Hashes</h3><ul><li>{md5}</li><li>{sha256}</li></ul>
    <h3>Domains and IPs</h3><ul><li>cache.night-heron[.]su</li><li>45.9.148[.]7</li></ul>
    <h3>URLs</h3><ul><li>https[:]//night-heron[.]su/stage2</li></ul><h2>Appendix II</h2><p>9.9.9.9</p></div></article></main>"""
    row, iocs = entry_iocs(spark, html, V.SL)
    assert iocs == [
        ("md5", md5), ("sha256", sha256), ("domain", "cache.night-heron.su"), ("ipv4", "45.9.148.7"), ("url", "https://night-heron.su/stage2"),
    ]
    # The container has no h1 of its own, so the title is the one of the index page.
    assert row.title == "Index title" and row.content.startswith("Birds of the night.\nAppendix I")


def test_pp_entries(spark):
    sha = hashlib.sha256(b"two faces").hexdigest()
    html = f"""<main><article><h1>Two faces</h1><h3>Indicators of compromise</h3><table>
    <tr><th>Indicator</th><th>Type</th><th>Context</th></tr>
    <tr><td>ledger-parts[.]net</td><td>Domain</td><td>First stage</td></tr>
    <tr><td>45.9.148[.]21</td><td>IP</td><td>First stage</td></tr>
    <tr><td>{sha}</td><td>SHA256</td><td>invoice.zip</td></tr>
    <tr><td>clipboardshop.com</td><td>Domain</td><td>Panel</td></tr></table><h2>Rules</h2><p>9.9.9.9</p></article></main>"""
    row, iocs = entry_iocs(spark, html, V.PP)
    # A hint may come from the indicator cell itself: "clipboardshop" names ipv4, and the domain is lost.
    assert iocs == [("domain", "ledger-parts.net"), ("ipv4", "45.9.148.21"), ("sha256", sha)]
    assert row.title == "Two faces"
    html = """<article><div class="blog-content__body"><h3>Scope</h3><table>
    <tr><td><b>Indicator</b></td><td>Description</td></tr>
    <tr><td>box7@night-heron[.]su</td><td>Mailbox</td></tr>
    <tr><td>45[.]9[.]148[.]22:4443</td><td>Backdoor server</td></tr>
    <tr><td>hxxps://get[.]night-heron[.]su/b[.]exe</td><td>URL of a binary</td></tr>
    <tr><td>kit.night-heron[.]su</td><td>Domain of the kit</td></tr></table></div></article>"""
    _, iocs = entry_iocs(spark, html, V.PP)
    assert iocs == [("ipv4", "45.9.148.22"), ("url", "https://get.night-heron.su/b.exe"), ("domain", "kit.night-heron.su")]


S1_ENTRY = """<main><article><h1>Группа X</h1><div class="entry-content"><p>Текст</p>
<h2>Индикаторы компрометации</h2>{before}<div class="tabcontent">
<h3>IPv4</h3><ul><li>8.8.4.4</li><li>10.0.0.5</li></ul>
<h3>IPv4 Port Combinations</h3><ul><li>1.1.1.1:8443</li></ul>
<h3>Onion Domains</h3><ul><li>abc.onion</li><li>evil[.]com</li></ul>
<h3>Tox ID</h3><ul><li>ABCDEF0123</li></ul>
<h3>MD5</h3><ul><li>доступно только авторизованным пользователям</li></ul>
</div><h2>Комментарии</h2><p>8.8.8.8</p></div></article></main>"""


def s1_entries(spark):
    pages = spark.createDataFrame([("https://x.org/p", S1_ENTRY.format(before=""), "t")], "source_url string, html string, index_title string")
    parsed = E.parse_entries(pages, V.S1).withColumn("source_name", F.lit("Bulletins")).withColumn("entry_ord", F.lit(1).cast("long"))
    dated = parsed.withColumn("collected_at", F.lit("2024-01-01 10:00:00.25").cast("timestamp"))
    return S.with_observables(rules.filter_entry_iocs(dated))


def test_s1_entry(spark):
    row, iocs = entry_iocs(spark, S1_ENTRY.format(before=""), V.S1)
    assert row.title == "Группа X"
    assert iocs == [
        ("ipv4", "8.8.4.4"), ("ipv4", "10.0.0.5"), ("ipv4_port", "1.1.1.1:8443"), ("domain", "abc.onion"), ("domain", "evil[.]com"),
        ("tox id", "ABCDEF0123"),
    ]
    # Text or a comment between heading and tab hides the tab's children; the tab is then no heading and sets no kind.
    assert entry_iocs(spark, S1_ENTRY.format(before="<!-- c -->"), V.S1)[1] == []
    assert entry_iocs(spark, "<main><p>no article</p></main>", V.S1)[0].error == "no content found"


def test_bundle_and_rules(spark, tmp_path):
    entries = s1_entries(spark)
    objects = S.bundle_objects(entries)
    assert sorted(r.type for r in objects.collect()) == [
        "domain-name", "identity", "ipv4-addr", "ipv4-addr", "network-traffic", "report", "x-ti-tox-id",
    ]
    bundles.write_bundles(objects, str(tmp_path / "bundles"))
    files = sorted((tmp_path / "bundles").rglob("part-*"))
    document = json.loads("".join(f.read_text("utf-8") for f in files))
    assert document["type"] == "bundle" and [o["type"] for o in document["objects"]] == [
        "identity", "ipv4-addr", "ipv4-addr", "network-traffic", "domain-name", "x-ti-tox-id", "report",
    ]
    report = document["objects"][-1]
    assert report["created"] == "2024-01-01T10:00:00.250Z" and report["published"] == "2024-01-01T10:00:00.25Z"
    assert report["object_refs"] == [o["id"] for o in document["objects"][1:6]]
    (tmp_path / "whole.json").write_text(json.dumps(document, indent=4, ensure_ascii=False), "utf-8")
    (tmp_path / "other.json").write_text('{"type": "report"}')
    whole, rejects = bundles.read_bundles(spark, str(tmp_path / "*.json"))
    assert whole.count() == 7 and rejects.count() == 1
    wanted = [("domain", "abc.onion", 7000000), ("ipv4", "1.1.1.1", 7000001), ("ipv4", "8.8.4.4", 7000002)]
    stored = R.object_fields(bundles.read_bundle_lines(spark, str(tmp_path / "bundles")))
    for rows in (R.rule_rows(stored, ["bundle_id"]), R.rule_rows(R.object_fields(whole), ["bundle_id"]), R.rule_rows_of_entries(entries)):
        numbered = R.render_rules(R.assign_sids(rows)).orderBy("sid").collect()
        assert [(r.ioc_type, r.indicator, r.sid) for r in numbered] == wanted
    assert numbered[1].rule.startswith('alert ip any any <> 1.1.1.1 any (msg:"TI IOC IPv4: 1.1.1.1";')
    rule_files.write_rules(R.render_rules(R.assign_sids(rows)), str(tmp_path / "rules"))
    assert rule_files.read_rules(spark, str(tmp_path / "rules")).count() == 3


def test_numbering_is_dense_and_sorted(spark):
    values = [(f"{random.Random(i).random():.12f}",) for i in range(5000)]
    numbered = number_rows(spark.createDataFrame(values, "v string").repartition(7), ["v"], "n", 10)
    assert [(r.n, r.v) for r in numbered.orderBy("n").collect()] == list(enumerate(sorted(v for v, in values), 10))


# ---------------------------------------------------------------- histories


def brute_replay(history):
    """(snapshot rows, new rows) by plain folding per source."""
    rows, new = set(), set()
    for source in {s for s, _ in history}:
        baseline = None
        for at in sorted(t for s, t in history if s == source):
            urls = history[source, at]
            fresh = urls if baseline is None else urls - history[source, baseline]
            rows.add((source, at, baseline, bool(fresh)))
            if fresh:
                new |= {(source, at, u) for u in fresh}
                baseline = at
    return rows, new


def random_history(seed, sources=3, snapshots=60, urls=7):
    rng = random.Random(seed)
    history = {}
    for s in range(sources):
        for n in range(snapshots):
            at = T0 + dt.timedelta(hours=n * rng.choice([1, 5, 11]), minutes=n)
            history[f"s{s}", at] = {f"u{rng.randrange(urls)}" for _ in range(rng.randrange(1, 5))}
    return history


def history_rows(spark, history):
    rows = [(s, t, u) for (s, t), urls in history.items() for u in urls]
    return spark.createDataFrame(rows, "source_name string, collected_at timestamp, publication_url string")


def test_replay_worked_example(spark):
    days = [{"a", "b"}, {"a"}, {"a", "b"}, {"b", "c"}, {"a"}]
    history = {("A", T0 + dt.timedelta(hours=6 * i)): urls for i, urls in enumerate(days)}
    replayed, judged = I.replay_history(history_rows(spark, history))
    assert [r.kept for r in replayed.orderBy("collected_at").collect()] == [True, False, False, True, True]
    new = {(r.collected_at, r.publication_url) for r in judged.filter("is_new").collect()}
    assert new == {(T0, "a"), (T0, "b"), (T0 + dt.timedelta(hours=18), "c"), (T0 + dt.timedelta(hours=24), "a")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_folding(spark, seed):
    history = random_history(seed)
    replayed, judged = I.replay_history(history_rows(spark, history))
    rows, new = brute_replay(history)
    assert {tuple(r) for r in replayed.select("source_name", "collected_at", "baseline_at", "kept").collect()} == rows
    listed = judged.filter("is_new").select("source_name", "collected_at", "publication_url")
    assert {tuple(r) for r in listed.collect()} == new


@pytest.mark.parametrize("block, fan", [(1, 2), (7, 3)])
def test_replay_over_many_blocks(spark, monkeypatch, block, fan):
    """Trees of several levels, with sources that begin and end anywhere in a block."""
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "FAN", fan)
    history = random_history(6, sources=4, snapshots=30, urls=5)
    rows, _ = brute_replay(history)
    replayed, _ = I.replay_history(history_rows(spark, history))
    assert {tuple(r) for r in replayed.select("source_name", "collected_at", "baseline_at", "kept").collect()} == rows


def test_replay_of_ten_thousand_days_of_one_source(spark):
    rng = random.Random(8)
    history = {("one", T0 + dt.timedelta(days=n)): {f"u{u}" for u in rng.sample(range(9), rng.randint(1, 3))} for n in range(10_000)}
    rows, new = brute_replay(history)
    replayed, judged = I.replay_history(history_rows(spark, history))
    assert {tuple(r) for r in replayed.select("source_name", "collected_at", "baseline_at", "kept").collect()} == rows
    assert judged.where("is_new").count() == len(new)


def test_stream_equals_replay(spark, tmp_path):
    history = random_history(9, snapshots=12, urls=5)
    times = sorted({t for _, t in history})
    landing = tmp_path / "landing"
    for n in range(4):
        part = {k: v for k, v in history.items() if times.index(k[1]) * 4 // len(times) == n}
        history_rows(spark, part).coalesce(1).write.mode("append").parquet(str(landing))
        stream = spark.readStream.schema("source_name string, collected_at timestamp, publication_url string").parquet(str(landing))
        N.stream_new_entries(stream, str(tmp_path / "out")).awaitTermination()
    out = str(tmp_path / "out")
    assert {tuple(r) for r in N.read_new_entries(spark, out).collect()} == brute_replay(history)[1]
    assert N.read_changes(spark, out).where("change < 0").count() == 0  # all came in time
    # What one source lists was seen by it long ago: its first entries are withdrawn, and the others' state isn't written again.
    first = min(t for s, t in history if s == "s1")
    late = {("s1", first - dt.timedelta(days=1)): history["s1", first] | {"u9"}}
    history_rows(spark, late).coalesce(1).write.mode("append").parquet(str(landing))
    stream = spark.readStream.schema("source_name string, collected_at timestamp, publication_url string").parquet(str(landing))
    N.stream_new_entries(stream, out).awaitTermination()
    history |= late
    rows, new = brute_replay(history)
    assert {tuple(r) for r in N.read_new_entries(spark, out).collect()} == new
    assert {tuple(r) for r in N.read_snapshots(spark, out).collect()} == {(s, t, kept) for s, t, _, kept in rows}
    withdrawn = N.read_changes(spark, out).where("change < 0").collect()
    assert {(r.collected_at, r.publication_url) for r in withdrawn} == {(first, u) for u in history["s1", first]}
    assert {r.source_name for r in spark.read.parquet(f"{out}/kept").where("batch = 4").collect()} == {"s1"}


@pytest.mark.parametrize("seed", [4, 5])
def test_shuffled_stream_equals_replay(spark, tmp_path, seed):
    history = random_history(seed, sources=2, snapshots=14, urls=4)
    keys = sorted(history)
    random.Random(seed).shuffle(keys)
    for n in range(3):
        history_rows(spark, {k: history[k] for k in keys[n::3]}).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("source_name string, collected_at timestamp, publication_url string").parquet(str(tmp_path / "in/*"))
        N.stream_new_entries(stream, str(tmp_path / "out")).awaitTermination()
    assert {tuple(r) for r in N.read_new_entries(spark, str(tmp_path / "out")).collect()} == brute_replay(history)[1]


def test_one_page_per_url(spark):
    new = spark.createDataFrame([("A", "u1"), ("A", "u2"), ("B", "u1")], "source_name string, publication_url string")
    pages = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2), ("u1", "new", 2), ("u3", "x", 1)], "url string, content string, landed_at int")
    assert sorted((r.source_name, r.publication_url, r.content) for r in I.match_entries(new, pages).collect()) == [("A", "u1", "new"), ("B", "u1", "new")]


# ---------------------------------------------------------------- registry, snapshots, runs


def test_registry(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"name": "A", "index_url": "https://a.org", "profile": "s1"}]')
    (tmp_path / "object.json").write_text(
        json.dumps({"sources": [{"name": " ", "index_url": "ftp://b", "enabled": False}, {"name": "C", "index_url": "http://c.org", "profile": "zz"}]}, indent=2)
    )
    (tmp_path / "broken.json").write_text('{"feeds": []}')
    rows = registry.validate_sources(registry.read_sources(spark, str(tmp_path))).collect()
    by_name = {(r.name or "-").strip(): r for r in rows}
    assert by_name["A"].enabled and not by_name["A"].issues
    assert [i.split()[0] for i in by_name[""].issues] == ["name", "profile", "index_url"] and not by_name[""].enabled
    assert by_name["C"].issues == ["unknown profile zz"] and by_name["C"].row_no == 2
    assert by_name["-"].issues == ["no list of sources"]


def test_snapshot_round_trip(spark, tmp_path):
    at = dt.datetime(2024, 3, 1, 6, 0, 0, 5)
    page = ("Blog One", "https://x.org/a", "héllo".encode(), None, at)
    fetched = spark.createDataFrame([page], "source_name string, url string, content binary, encoding string, collected_at timestamp")
    landed, _ = snapshots.land_pages(fetched, "index")
    document = json.loads(snapshots.encode_snapshots(landed).collect()[0].value)
    assert document["collected_at"] == "2024-03-01T06:00:00.000005+00:00" and document["schema_version"] == 2
    old = {k: v for k, v in document.items() if k != "snapshot_kind"} | {"sha256_hex": "0"}
    (tmp_path / "a.snapshot.json").write_text(json.dumps(document, indent=2, sort_keys=True))
    (tmp_path / "b.snapshot.json").write_text(json.dumps(old, indent=2))
    (tmp_path / "c.snapshot.json").write_text("{broken")
    read, bad = snapshots.read_snapshots(spark, str(tmp_path), one_per_file=True)
    rows = read.collect()
    assert {(r.snapshot_kind, bytes(r.data), r.collected_at, r.sha_mismatch) for r in rows} == {
        ("index", "héllo".encode(), at, False), ("index", "héllo".encode(), at, True),
    }
    assert bad.count() == 1


def test_run_with_failures_and_rerun(spark):
    feeds = spark.createDataFrame(
        [("Good", "https://b.org/ioc/", "s1", True), ("Blank", "https://c.org/", "s1", True), ("Off", "https://d.org/", "s1", False)],
        "name string, index_url string, profile string, enabled boolean",
    )
    listing = '<main><article><h2><a href="/post/1">One</a></h2><h2><a href="/post/2">Two</a></h2></article></main>'
    pages = [
        ("Good", "https://b.org/ioc/", listing.encode(), None, T0),
        ("Good", "https://b.org/ioc/", listing.encode(), None, T0 + dt.timedelta(hours=6)),
        ("Blank", "https://c.org/", b" \n", None, T0),
        ("Off", "https://d.org/", listing.encode(), None, T0),
    ]
    schema = "source_name string, url string, content binary, encoding string, collected_at timestamp"
    entry_pages = spark.createDataFrame(
        [("https://b.org/post/1", S1_ENTRY.format(before="").encode(), None)], "url string, content binary, encoding string"
    )
    run = run_feeds(feeds, spark.createDataFrame(pages, schema), entry_pages)
    rows = {(r.source_name, r.generated_at): r for r in run.results.collect()}
    first, second, blank = rows["Good", T0], rows["Good", T0 + dt.timedelta(hours=6)], rows["Blank", T0]
    assert len(rows) == 3
    assert (first.total_index_entries, first.new_index_entries, first.fetched_entries, first.parsed_entries) == (2, 2, 1, 1)
    assert first.stix_object_count == 7 and first.stix_bundle_locator.startswith("bundle--") and not first.snapshot_deleted
    assert (second.new_index_entries, second.snapshot_deleted, second.stix_object_count) == (0, True, 0)
    assert not blank.succeeded and blank.error_message == "empty response body"
    assert {(f.stage, f.key) for f in run.failures.collect()} == {
        ("fetch_index", "https://c.org/"), ("fetch_entry", "https://b.org/post/2"),
    }
    assert run.kept_snapshots.count() == 1


def test_checkpoint_folder_comes_from_the_session():
    from threatloom import session

    class Stub:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return "s3://shared/checkpoints" if key == "spark.checkpoint.dir" else default

    assert session.checkpoint_folder(Stub) == "s3://shared/checkpoints"


def test_empty_registry_is_no_error(spark):
    from threatloom.sources.registry import parse_registry

    documents = spark.createDataFrame([("list", "[]"), ("object", '{"sources": []}'), ("neither", "{}")], "name string, value string")
    rows = parse_registry(documents.withColumnRenamed("name", "file")).collect()
    assert [(r.file, r.load_error) for r in rows] == [("neither", "no list of sources")]


def test_sketch_keeps_every_wanted_key(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("body").alias("content"))
    for count in (0, 1, 3_000):
        wanted = spark.range(count).select(F.concat(F.lit("u"), F.col("id") * 5).alias("x"))
        kept = may_be_among(keys, "url", wanted)
        assert kept.columns == keys.columns
        assert wanted.join(kept, wanted.x == kept.url, "left_semi").count() == count
        assert kept.count() <= count + 1_000  # of 20,000, one in 32


def test_undated_and_repeated_pages(spark):
    new = spark.createDataFrame([("A", "u1"), ("B", "u1"), ("A", None)], "source_name string, publication_url string")
    rows = [("u1", 1, "old"), ("u1", 3, "last"), ("u1", 3, "last"), ("u1", None, "undated"), ("u2", 9, "x"), (None, 9, "y")]
    landed = spark.createDataFrame(rows, "url string, landed_at int, content string")
    matched = I.match_entries(new, landed)
    assert sorted((r.source_name, r.landed_at, r.content) for r in matched.collect()) == [("A", 3, "last"), ("B", 3, "last")]
    assert I.match_entries(new.limit(0), landed).count() == I.match_entries(new, landed.limit(0)).count() == 0
