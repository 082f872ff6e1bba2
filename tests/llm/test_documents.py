"""Operators on documents against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import (
    decontamination,
    ngram_join,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
)
from threatloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, keys string, holder long, maybe boolean, `class` long, bucket int, spans string, kept string, shard int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["alpha", "Beta", "gämma", "delta,", "x", "été", "日本", "run"]) + str(rng.randrange(60)) for _ in range(n))
    base = [prose(80) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, "ONE two\nthree"), (7, prose(4000))]
    for i in range(10, 60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            words[rng.randrange(len(words))] = prose(1)
        at = rng.randrange(len(words))
        rows.append((i, " ".join(words[:at]) + " " + prose(rng.randrange(30)) + "\n" + " ".join(words[at:])))
    rows += [(60, prose(30) + " " + base[0] + " " + base[0]), (12, rows[9][1]), (61, rows[9][1]), (62, rows[9][1])]
    return rows


TEXTS = _texts()


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, True, 2, 3, "s", "x", 9) for i, t in TEXTS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text, lower=False):
    text = text or ""
    return SPACED.findall(text.translate(LOWER) if lower else text)


def test_repeated_passages(docs, nothing):
    seen, expected = {}, []
    for i, text in sorted(TEXTS, key=lambda r: r[0]):
        words, own = _words(text), set()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if seen.setdefault(window, i) < i or window in own:
                gone[p : p + 20] = [True] * 20
            own.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        expected.append((i, len(words), sum(gone), kept))
    rows = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == sorted(expected)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed for r in rows)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_without_id_are_judged_alone(spark):
    text = " ".join(map(str, range(30)))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(None, text), (None, f"{text} {text}"), (5, text)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows.collect()) == [(0, 30, 0), (0, 60, 30), (5, 30, 0)]


@pytest.mark.parametrize("chunk_tokens", [ngram_join.CHUNK_TOKENS, 300])
def test_similar_documents(docs, nothing, chunk_tokens):
    sets = {}
    for i, text in TEXTS:
        words = _words(text, lower=True)
        sets[i] = {tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    expected = sorted((i, len(sets[i]), find(i)) for i, _ in TEXTS)
    got = sorted(map(tuple, ngram_join.near_duplicates(docs, chunk_tokens=chunk_tokens).collect()))
    assert got == expected
    assert len({c for _, _, c in got}) < len(sets)
    if chunk_tokens == ngram_join.CHUNK_TOKENS:
        assert ngram_join.near_duplicates(nothing).count() == 0


def test_benchmark_passages(spark, docs, nothing):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: words.findall((t or "").translate(LOWER))
    long_one = TEXTS[8][1]
    items = [(1, long_one), (2, "one"), (2, "one"), (None, "two three"), (3, None), (4, " ".join(long_one.split()[5:30]))]
    held = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for p in range(len(w) - min(10, len(w)) + 1) if w else ():
            held[tuple(w[p : p + min(10, len(w))])].add(item)
    expected = []
    for i, text in TEXTS:
        w, found = split(text), set()
        hit = [False] * len(w)
        for n in {len(k) for k in held}:
            for p in range(len(w) - n + 1):
                if (items_ := held.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    found |= items_ - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        expected.append((i, len(w), sum(hit), sorted(found), digest))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.scan_benchmark(docs, benchmark).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.items_sha256) for r in rows) == sorted(expected)
    again = decontamination.scan_benchmark(docs.select("doc_id", F.col("text")).withColumn("text", F.col("text")), benchmark)
    cleaned = again.select("doc_id", F.col("clean_text").alias("text"))
    assert all((b.clean_text or "") == (a.text or "") for a, b in [(r, r) for r in again.collect()] if b.n_hit == 0)
    assert cleaned.count() == len(TEXTS)
    assert decontamination.scan_benchmark(nothing, benchmark).count() == 0
    assert decontamination.scan_benchmark(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_packing_is_complete_and_dense(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = collections.Counter()
    for i, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            expected[i, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    rows = packing.pack(docs, tokenizer_path(), limit=256).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        slots.sort()
        assert [o for o, _ in slots] == [sum(n for _, n in slots[:k]) for k in range(len(slots))] and sum(n for _, n in slots) <= 256
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(6.3, 1, 20000).astype(int), 1, 4096), minlength=4097)
    groups = packing.plan(counts)
    bound = -(-int((counts * np.arange(4097)).sum()) // 4096)
    assert sum(g.count for g in groups) <= 1.01 * bound + 1


def test_non_negative_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((8, 14)), rng.random(8)
    x = packing.non_negative_least_squares(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gradient < 1e-7).all() and abs(gradient @ x) < 1e-7


def test_shards(spark, docs, nothing):
    rows = sharding.shard(docs, shards=5).collect()
    texts = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    by, homes = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        by[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and all(len(s) == 1 for s in homes.values())
    assert sharding.shard(nothing).count() == 0


def test_cuts_are_the_smallest_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rng = random.Random(1)
    rows = sorted((rng.getrandbits(64) - (1 << 63), rng.randint(16, 900)) for _ in range(150))
    cuts = sharding.cut_points(spark.createDataFrame(rows, "hash long, bytes long"), 7)
    loads = collections.Counter()
    for place, size in rows:
        loads[sum(place >= cut for cut in cuts)] += size

    def fits(capacity):
        shards, room = 1, capacity
        for _, size in rows:
            shards, room = (shards, room - size) if size <= room else (shards + 1, capacity - size)
        return shards <= 7

    assert max(loads.values()) == next(c for c in range(max(s for _, s in rows), sum(s for _, s in rows)) if fits(c))


def test_rule_metrics(docs, nothing):
    expected = []
    for i, text in TEXTS:
        text, words = text or "", _words(text)
        lines = [line for line in text.split("\n") if SPACED.search(line)]
        grams = collections.Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
        held = {q for p in range(len(words) - 4) if grams[tuple(words[p : p + 5])] > 1 for q in range(p, p + 5)}
        failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        expected.append((i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(held), failed))
    rows = quality_rules.judge(docs).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rows) == sorted(expected)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.judge(nothing).count() == 0


def test_rules_stand_by_rejections_per_cost_of_what_is_left():
    # "b" rejects nothing that "a" lets through, "d" is dear; "c" and "e" reject nothing, the cheaper one is first.
    verdicts = {(True, True, False, False, False): 9, (True, False, False, False, False): 1, (False, False, False, True, False): 3, (False,) * 5: 80}
    assert quality_rules.by_rejections(verdicts, {"a": 1.0, "b": 1.0, "c": 2.0, "d": 4.0, "e": 0.5}) == ["a", "d", "e", "b", "c"]
    assert quality_rules.by_rejections({}, {"z": 1.0, "y": 1.0}) == ["y", "z"]


def test_cascade_does_not_depend_on_the_order(docs):
    rules = quality_rules.default_rules()
    metrics = quality_rules.with_metrics(docs)
    names = list(rules)
    both = metrics.select(quality_rules.cascade(rules, names).isNull().alias("a"), quality_rules.cascade(rules, names[::-1]).isNull().alias("b"))
    assert both.where("a != b").count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _spans(text):
    found = []
    for kind, shape in BASE.items():
        for m in shape.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            passes = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                      "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if passes:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_on_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1290.@+- ()%_é255") for _ in range(rng.randint(0, 40)))
        assert [(a, b, k) for a, b, k, passes in pii.base_matches(text) if passes] == _spans(text)


def test_personal_data(spark, nothing):
    filler = "ünder the " * 30
    texts = [None, "", filler, "1" * 2_000, f"{filler}mail a.b@c.example.com or +1 (663) 555-6869", "card 4242 4242 4242 4242, host 10.0.0.1 10.0.0.999"]
    texts += [f'note {i} token = "{hashlib.sha256(bytes([i])).hexdigest()[:40]}" end' for i in range(40)] + ["mail x@y.org"] * 30
    df = spark.createDataFrame([(i, t, "c", "m") for i, t in enumerate(texts)], "doc_id long, text string, spans string, masked string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, text in enumerate(texts):
        base = _spans(text or "")
        listed = [x for x in rows[i].spans.split(",") if x]
        assert [x for x in listed if x.split(":")[0] in BASE] == [f"{k}:{a}:{b}" for a, b, k in base]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
    assert "secret:" in rows[10].spans and "[SECRET]" in rows[10].masked and rows[2].spans == ""
    assert pii.find_personal_data(nothing).count() == 0


def test_ordinal_classifier_on_held_out_documents(spark, nothing):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_classifier.classify(docs, labels.where("doc_id % 3 != 0")).select("doc_id", "expected_grade", "tail_probability", "kept")
    held = scored.join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {(r.quality, r.toxic): r.kept for r in held.collect()}
    assert kept[1, 0] > 0.95 and kept[1, 1] < 0.3 and kept[0, 0] < 0.2
    assert scored.where("not (expected_grade between 0 and 2) or tail_probability > expected_grade").count() == 0
    assert quality_classifier.classify(nothing, labels).count() == 0
    assert quality_classifier.classify(docs.limit(3), labels.limit(0)).where("kept").count() == 3


def test_a_long_secret_is_one_span():
    value = "aB3" * 400
    text = f"token = {value} end"
    assert pii.proposals(text, []) == [(8, 8 + len(value), "secret")]
    assert pii.masked(text, pii.proposals(text, [])) == "token = [SECRET] end"


def test_kept_of_the_rules(spark):
    texts = [t for _, t in TEXTS] + [
        "ab # " * 3 + " ".join(f"w{i}" for i in range(20)), "## $$ %% " + " ".join(f"w{i}" for i in range(20)), " ".join(f"WORD{i}" for i in range(20)),
        " ".join(f"w{i}!?" for i in range(20)), " ".join("x" * 40 + str(i) for i in range(20)), " ".join("abcdefghijklmnopqrst"),
        "\n".join(["same line"] * 9 + [f"w{i} v{i}" for i in range(30)]), "\n".join([*[f"w{i}" for i in range(40)], *["end"] * 45]), " ".join("abc"[i * i % 3] for i in range(60)),
        " ".join(f"{'abcd'[i * i * i % 4]}{i % 3}" for i in range(300)), "a b " * 30, "\n".join(x for i in range(12) for x in ("z", f"a{i} b{i}", "z", "z")),
    ]
    expected = {}
    for i, text in enumerate(texts):
        text, words = text or "", _words(text)
        chars, n = sum(map(len, words)), len(words)
        lines = [line for line in text.split("\n") if SPACED.search(line)]
        grams = collections.Counter(tuple(words[p : p + 5]) for p in range(n - 4))
        held = {q for p in range(n - 4) if grams[tuple(words[p : p + 5])] > 1 for q in range(p, p + 5)}
        fails = [
            n < 10 or 100 * len(held) > 20 * n, 100 * sum(c in "#*$%&|<>" for c in text) > 10 * chars, 2 * sum("A" <= c <= "Z" for c in text) > chars,
            100 * sum(c in "!?" for c in text) > 10 * chars, chars > 25 * n or chars < 2 * n, 100 * (len(lines) - len(set(lines))) > 50 * len(lines),
            n >= 50 and 10 * len(set(words)) < n,
        ]
        expected[i] = not any(fails)
    rows = quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == expected
    assert {r.rejected_by for r in rows} >= {None, "symbols", "capitals", "marks", "word_length"}
