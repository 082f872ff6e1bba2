"""The stages of the pipeline against brute force, on rows with nulls, repeated ids and an empty table."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from threatloom.llm import decontamination, quality_classifier
from threatloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, other int"


def _text(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


LEAK = _text("leak", 12)
ROWS = [
    (9, _text("a")), (12, _text("b")), (12, _text("a") + " z"), (12, _text("b")), (13, _text("B")), (14, _text("c") + " " + LEAK), (15, LEAK),
    (16, None), (16, ""), (16, None), (17, "mail a.b@example.com " + _text("d")), (None, _text("a")), (None, None), (18, _text("e", 3)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    path = tmp_path_factory.mktemp("tables")
    _docs(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")  # all are kept
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _docs(spark, rows):
    full = [(i, t, f"l{k % 2}", f"s{k}", None if t is None else len(t), k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def _counted(rows):
    return collections.Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows)


def _rows(places, rows=ROWS):
    return collections.Counter((rows[k][0], rows[k][1], f"l{k % 2}", f"s{k}", None if rows[k][1] is None else len(rows[k][1])) for k in places)


def test_quality(spark, folder):
    assert _counted(corpus_pipeline.quality(spark, _docs(spark, ROWS), folder).collect()) == _rows(range(len(ROWS)))
    given = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{given}/{name}.parquet") for name in ("documents", "labels"))
    found = quality_classifier.classify(docs, labels, keep=corpus_pipeline.OTHERS).collect()
    want = _counted(r for r in found if r.kept)
    assert 0 < want.total() < len(found) and _counted(corpus_pipeline.quality(spark, docs, given).collect()) == want


def test_one_row_of_each_linked_group(spark, folder):
    # 12's copy of 9 goes, its own text stays once (the first by lang), 13 is 12's text; 16 is without words.
    got = _counted(corpus_pipeline.near_duplicates(spark, _docs(spark, ROWS), folder).collect())
    assert got == _rows([0, 1, 5, 6, 7, 10, 11, 12, 13])


def test_texts_under_one_id_are_told_apart(spark, folder):
    rows = [(1, _text("a")), (2, _text("a")), (2, _text("b")), (2, _text("c")), (3, _text("c"))]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_duplicates(spark, _docs(spark, order), folder).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, _text("a")), (2, _text("b")), (2, _text("c"))]


def test_decontaminate(spark, folder):
    docs = _docs(spark, ROWS)
    got = corpus_pipeline.decontaminate(spark, docs, folder).collect()
    clean = {r.doc_id: r.clean_text for r in decontamination.scan_benchmark(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect() if r.n_hit}
    assert set(clean) == {14, 15} and clean[14].split() == _text("c").split()
    want = _rows([k for k in range(len(ROWS)) if k not in (5, 6)])
    want[14, clean[14], "l1", "s5", len(clean[14])] += 1
    assert _counted(got) == want


def test_personal_data(spark, folder):
    masked = "mail [EMAIL] " + _text("d")
    want = _rows([k for k in range(len(ROWS)) if k != 10])
    want[17, masked, "l0", "s10", len(masked)] += 1
    assert _counted(corpus_pipeline.personal_data(spark, _docs(spark, ROWS), folder).collect()) == want


def _packed(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = collections.Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    return found


def test_pack(spark, folder):
    got = corpus_pipeline.pack(spark, _docs(spark, ROWS), folder).collect()
    assert collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == _packed(ROWS)


def test_run(spark, folder):
    rows, seen = [], {}
    for k in sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] or 0, k % 2, k)):
        i, text = ROWS[k]
        group = (text or "").lower().removesuffix(" z") or (i, "wordless")
        if text == LEAK or i is not None and seen.setdefault(group, k) != k:
            continue
        text = text and text.replace(LEAK, "").replace("a.b@example.com", "[EMAIL]")
        rows.append((i, text))
    got = collections.Counter((r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    want = _packed([(i, t and t.rstrip()) for i, t in rows])
    assert len(rows) > 3
    assert got == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_table(spark, folder, stage):
    assert stage(spark, _docs(spark, ROWS).limit(0), folder).count() == 0
