"""Credential linking, structure repair, ranked search and the classifier's fit against brute force and their DuckDB twins."""

import collections
import hashlib
import heapq
import math
import random
import re

import duckdb
import numpy as np
import pytest

from threatloom.llm import credentials, quality_classifier, queries, ranked_search, structure_repair


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def _against_twin(spark, name, folder, **tables):
    """Rows of a registered query, after they have been held against its twin."""
    connection = duckdb.connect()
    for table, df in tables.items():
        df.repartition(3).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    cursor = connection.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    rows = got.select(*names).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(cursor.fetchall())
    return rows


BITS = [
    "password = 'hunter2abc'", "Token:", "SECRET=ab", "secret=token:abcdefgh", "api_key: \"x.y/z=+\"", "ſecret = abcdefgh", "AKIA" + "A1" * 9, "AKIAAKIAABC",
    "deadbeef" * 4, "é", "𝒳", "\n\n", "\n \t\n", "\n", " ", "user: bob", "client_id=Zed_99", "login :  x", "aB3dE5fG7hI9jK1lM3nO5pQ", "toKen = abcdefgh",
    "https://x.example/p?q=aB3dE5fG7hI9jK1lM3nO5pQ", "db.example.com:5432", "word " * 30, "lorem ipsum " * 40, "A" * 25, "passwd==abcdefgh", "aB3dE5fG7hI9jK1lM3nO5pQ==",
]
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def _base(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m)]
    return ",".join(x[2] for x in sorted(found))


def test_credentials(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(BITS) + rng.choice(["", " ", "  ", ",", "x"]) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, None), (7, rows[8][1]), (601, ""), (602, "x" * 300_000)]
    # A long text with many parts, none of which may make pairs with all others.
    rows.append((603, " ".join(f"user=u{i:04} aB3dE5fG7hI9jK1lM3n{i:04}" for i in range(3000))))
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k1 string, kind int")
    got = _against_twin(spark, "op11_credential_linking", tmp_path, documents=df)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == collections.Counter((i, hashlib.sha256(_base(t).encode()).hexdigest()) for i, t in rows)
    assert next(r for r in got if r.doc_id == 603).spans.count(",") == 5999
    assert credentials.find_secrets(df.limit(0), ("k1",)).count() == 0


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("user: bob and aB3dE5fG7hI9jK1lM3nO5", ["identifier", "key"]),
        ("user: bob\n\naB3dE5fG7hI9jK1lM3nO5", []),  # another scope
        ("user: bob" + " x" * 300 + " aB3dE5fG7hI9jK1lM3nO5", []),  # out of reach
        ("see https://a.example/b for aB3dE5fG7hI9jK1lM3nO5", ["key"]),  # an endpoint takes an identifier as well
        ("https://a.example/b user=bob password=hunter22", ["endpoint", "identifier", "assign"]),
        ("https://a.example/b and nothing else", []),
        ("aB3dE5fG7hI9jK1lM3nO5", []),
        ("user=bob https://a.example/aB3dE5fG7hI9jK1lM3nO5", []),  # part of the URL
    ],
)
def test_weak_parts_need_complements(spark, text, kinds):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = credentials.find_secrets(df).collect()
    assert [s.kind for s in row.spans] == kinds


def _cheapest(kinds):
    """(cost, least string) over all edit strings, by a search through (cost, string) in order."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    other = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, "")]
    while heap:
        cost, string, i, state = heapq.heappop(heap)
        if i == len(kinds) and state in ("", "a"):
            return cost, string
        if cost + 2 <= 3 * len(kinds):
            heapq.heappush(heap, (cost + 2, string + "I", i, other[state]))
        if i < len(kinds):
            initial, goes, cut = kinds[i]
            heapq.heappush(heap, (cost + 3, string + "D", i + 1, state))
            if not goes:
                heapq.heappush(heap, (cost + 2 + cut, string + "R", i + 1, other[state]))
                if (state, initial) in follow:
                    heapq.heappush(heap, (cost + cut, string + "K", i + 1, follow[state, initial]))


def test_decoder_in_one_run_and_in_parts():
    rng, part = random.Random(1), structure_repair.Part
    for _ in range(700):
        drawn = [(rng.choice("sua-" if rng.random() < 0.5 else "ua"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 6))]
        kinds = [(i, g, t and not g) for i, g, t in drawn]
        rows = [(k, i.replace("-", "x"), "t", "blank" if g else "truncated" if t else "") for k, (i, g, t) in enumerate(kinds)]
        want = _cheapest(kinds)
        found = list(structure_repair.edits(rows, part()))
        assert (found[-1][-1], "".join(e[0] for e in found)) == want
        cut, closing = rng.randint(0, len(rows)), np.array(part().to_go)
        to_go = tuple(int(x) for x in (structure_repair.matrix(kinds[cut:]) + closing).min(axis=1))
        first = list(structure_repair.edits(rows[:cut], part(to_go=to_go, last=False)))
        state = structure_repair.START
        for edit, _, role, _, _ in first:
            state = structure_repair._NEXT[state, role[:1]] if edit == "K" else structure_repair._OTHER[state] if edit in ("I", "R") else state
        second = list(structure_repair.edits(rows[cut:], part(entry=state)))
        assert (first[-1][-1] + second[-1][-1], "".join(e[0] for e in first + second)) == want


def test_decoder_holds_only_what_is_unresolved():
    rng, decoder, out = random.Random(3), structure_repair.Decoder(), 0
    for _ in range(50_000):
        out += len(decoder.step((rng.choice("sua-uaua"), rng.random() < 0.1, False)))
    assert out > 49_900 and decoder.most_held < 200


def test_repair_of_long_and_odd_conversations(spark, tmp_path, request):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
    words = ["Hello there.", "no end", "Why?", " ", "", None, "same text!", "\n\n", "é."]
    rows = [(1, t, rng.choice(roles), rng.choice(words) if rng.random() < 0.3 else f"text {t}.", t) for t in range(400)]  # one conversation with most rows
    for conv in range(2, 40):
        rows += [(conv, t, rng.choice(roles), rng.choice(words), 0) for t in range(rng.randint(1, 6))]
    rows += [(None, t, "user", "x.", 0) for t in (3, 1, None)] + [(50, None, "user", "a.", 0), (50, None, "assistant", "b.", 0), (50, 7, "user", "a.", 0)]
    rows += [(51, 5, "user", "same.", 0)] * 5 + [(52, 0, "user", "dropped?", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, number int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or all of it fits one partition
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    got = _against_twin(spark, "op12_coalescing_viterbi_repair", tmp_path, conversations=df)
    assert len(got) == len({r[0] for r in rows})
    # The general form: its rows, in order, are the audit and the repaired text, also over partitions.
    parts = structure_repair._parts(structure_repair.in_order(structure_repair.damaged(df)))
    assert any(conv == 1 for _, conv in parts)
    found = collections.defaultdict(list)
    for r in structure_repair.repair(structure_repair.damaged(df)).orderBy("part", "place").collect():
        found[r.conv_id].append(r)
    for row in got:
        assert "".join(r.edit for r in found[row.conv_id]) == row.audit
        text = "\n".join(f"{r.role}:{r.text}" for r in found[row.conv_id] if r.text is not None)
        assert hashlib.sha256(text.encode()).hexdigest() == row.repaired_sha256
    assert structure_repair.repaired_conversations(df.limit(0)).count() == 0


def _ranked(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    read = [(i, collections.Counter(words(t))) for i, t in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    n, length = len(read), sum(x[2] for x in read)
    holding = collections.Counter(w for _, c, _ in read for w in c)
    result = []
    for item, text in items:
        asked, scores = collections.Counter(words(text)), []
        for i, c, size in read:
            m = 25 + (75 * size * n) // length
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, k in asked.items() if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        result += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return collections.Counter(result)


def test_ranked_search(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"{rng.choice(['W', 'w', 'é', '9'])}{min(int(rng.expovariate(0.05)), 200)}"
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(700)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (700, None), (701, ""), (702, "..."), (703, " ".join(word() for _ in range(30_000)))]
    docs += [(800 + i, docs[20][1]) for i in range(15)]  # ties
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(25)] + [(3, docs[20][1]), (30, None), (31, ""), (32, "unseen words"), (None, "w1 w2 w2")]
    documents = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = _against_twin(spark, "op13_norm_bucket_search", tmp_path, documents=documents, benchmark=benchmark)
    want = _ranked(docs, items)
    assert collections.Counter(map(tuple, got)) == collections.Counter({k: n for k, n in want.items()})
    in_blocks = ranked_search.search(documents.repartition(5), benchmark, block_chars=300)
    assert collections.Counter(map(tuple, in_blocks.collect())) == want
    assert ranked_search.search(documents.limit(0), benchmark).count() == ranked_search.search(documents, benchmark.limit(0)).count() == 0


def test_search_prunes():
    rng = np.random.default_rng(0)
    items = ranked_search.read_items([" ".join(f"t{x}" for x in rng.integers(0, 400, 12)) for _ in range(20)])
    corpus = ranked_search.Corpus(1000, 50_000, np.full(len(items.vocabulary), 3000))
    found = ranked_search.Search(items, corpus)
    for _ in range(20):
        rows = np.sort(rng.integers(0, 512, 3000))
        keys = np.unique(rows * len(items.vocabulary) + rng.integers(0, len(items.vocabulary), 3000))
        rows, terms = keys // len(items.vocabulary), keys % len(items.vocabulary)
        found.add(rows, terms, rng.integers(1, 10_000, len(rows)) // (1 + rows % 50), np.arange(512))
    assert found.skipped_buckets > found.buckets / 4 and found.scored < 20 * 512 * 20 / 4


def test_classifier_fit_against_its_likelihood():
    """The gradient by finite differences of the log likelihood, and a fit that no small step improves."""
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 300)
    held = [np.flatnonzero(rng.random(8) < (0.6 - 0.2 * g)).astype(np.int16) for g in grades]
    x = np.zeros((300, 8))
    for i, places in enumerate(held):
        x[i, places] = 1

    def loss(weights, thresholds):
        return np.log(quality_classifier.cumulative(x @ weights, thresholds, grades)[2]).sum() - quality_classifier.RIDGE / 2 * (weights**2).sum()

    weights, thresholds = quality_classifier.fit(held, grades, 8, rounds=3000)
    assert (weights <= 0).all() and (np.diff(thresholds) >= 0).all() and weights.min() < -0.1
    best = loss(weights, thresholds)
    for k in range(8):
        for step in (-0.02, 0.02):
            moved = weights.copy()
            moved[k] = min(0, moved[k] + step)
            assert loss(moved, thresholds) <= best + 1e-3
    for k in range(2):
        for step in (-0.02, 0.02):
            moved = thresholds.copy()
            moved[k] += step
            assert loss(weights, np.sort(moved)) <= best + 1e-3
    at = np.full(8, -0.3)
    low, high, _ = quality_classifier.cumulative(x @ at, thresholds, grades)
    slope = x.T @ (1 - low - high) - quality_classifier.RIDGE * at
    for k in range(8):
        step = np.eye(8)[k] * 1e-5
        assert abs((loss(at + step, thresholds) - loss(at - step, thresholds)) / 2e-5 - slope[k]) < 1e-4


def test_training_rows_do_not_grow_with_texts(spark):
    """What reaches the training task are chosen features: the same bytes for a text and for a thousand times as much of it."""
    text = lambda i: " ".join(f"{'bad' if i % 3 == 0 else 'fine'}{k}" for k in range(20))
    rows = [(text(i), (i % 3 == 0) * 0 + (i % 3 > 0) * (i % 3)) for i in range(90)]
    sizes = []
    for times in (1, 1000):
        df = spark.createDataFrame([((t + " ") * times, g) for t, g in rows], "text string, grade int")
        names, of_grade = quality_classifier.choose(df, most=16)
        assert len(names) == 16 and of_grade.sum() == 90
        sizes.append(max(len(r.held) for r in df.mapInArrow(quality_classifier._reduced(names), "grade int, held binary").collect()))
    assert sizes[0] == sizes[1] <= 2 * 16


def test_twins_on_documents(spark, tmp_path):
    """Queries on windows, metrics and links against their twins, on texts with repeats, odd white space and nothing in them."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)] + ["A", "é", "#!", "\u00a0x", "B.C", "𝒳"]
    long = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(6)]
    texts = [None, "", " \n\t", "one", "A b", "# * $ | <", "a\n" * 30, "LOUD " * 20]
    for _ in range(60):
        own = rng.choice(long).split(" ")
        at = rng.randint(0, 60)
        own[at : at + rng.randint(0, 30)] = [rng.choice(words) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += [texts[9], texts[9].upper(), long[0] + " " + long[0]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, w string")
    items = [(1, long[0][:120]), (2, "one"), (3, None), (10, long[1][40:160]), (4, long[0][:120]), (5, " ")]
    items = spark.createDataFrame(items, "item_id long, text string")
    repeats = _against_twin(spark, "op4_substring_dedup", tmp_path / "a", documents=df)
    assert 0 < sum(r.n_removed > 0 for r in repeats) < len(texts)
    kept = [r.kept for r in _against_twin(spark, "op7_rule_cascade", tmp_path / "b", documents=df)]
    assert True in kept and False in kept
    hits = _against_twin(spark, "op8_fm_decontamination", tmp_path / "c", documents=df, benchmark=items)
    assert {r.n_items for r in hits} >= {0, 1, 2}
    linked = _against_twin(spark, "op10_prefix_tree_join", tmp_path / "d", documents=df)
    assert 10 < len({r.component_id for r in linked}) < len(texts)
