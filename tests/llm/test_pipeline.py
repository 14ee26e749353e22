"""The pipeline's stages on small tables against brute force, with nulls, repeated rows, clashing columns and empty tables."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_rules_and_models import brute_metrics
from tests.llm.test_text_operators import brute_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    texts = [(i, prose(r.randint(10, 60))) for i in range(40)]
    texts += [(40, texts[3][1]), (41, texts[4][1] + " more"), (42, None), (43, ""), (44, prose(20) + " " + item + " " + prose(20)), (45, prose(25) + " call +1 (743) 555-3824"), (46, "a b c d e f g h " * 9)]
    texts += [(45, texts[-2][1]), (None, prose(40))]
    rows = [(i, t, None if (i or 0) % 7 == 0 else "en", None, None if t is None else len(t), "clash", None) for i, t in texts]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), DOCS)
        kept.append(sorted((x.doc_id if x.doc_id is not None else -1, x.text) for x in docs.collect()))
    key = lambda rows: sorted((i if i is not None else -1, t) for i, t in rows)
    # with two labels no cutoff is certified: the base rule alone
    passed = [(i, t) for i, t in texts if (m := brute_metrics(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    assert kept[0] == key(passed)
    first = {c for _, c in brute_components([x for x in passed if x[0] is not None], 80).values()}
    unique = list(dict.fromkeys((i, t) for i, t in passed if i is None or i in first))
    assert kept[1] == key(unique)
    clean = [x for x in unique if x[0] != 44]
    assert kept[2] == key(clean) and len(clean) == len(unique) - 1
    assert [i for i, _ in kept[3]] == [i for i, _ in key(clean)]
    changed = [i for (i, a), (_, b) in zip(kept[2], kept[3], strict=True) if a != b]
    assert changed == [45]
    pieces = corpus_pipeline.run(spark, path).collect()
    by_sequence: dict = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert {p.doc_id for p in pieces} == {i for i, _ in clean}


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
