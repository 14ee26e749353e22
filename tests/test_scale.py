"""Work that has to be dealt to all cores, or done once a row, whatever the tables' files are."""

import pyarrow as pa
import pytest

from orgweave.functions import fuzzy, html
from orgweave.operators import pairs
from orgweave.plans import queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["fuzzy_ratio", "query_plan", "rerank_lexicographic"])
def test_rows_are_dealt(spark, small, name):
    """The tables are one file each, so one task would do it all."""
    assert "RepartitionByExpression" in plan(queries.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["domain_score", "domain_identity_match", "candidate_evaluation"])
def test_written_by_many_tasks(spark, small, name):
    assert len(queries.QUERIES[name](spark, small).inputFiles()) >= 3


@pytest.mark.parametrize(("name", "table"), [("ranked_emails", "together-"), ("ranked_phones", "together-"), ("first_party_aliases", "links-")])
def test_rules_read_written_groups(spark, small, name, table):
    """Conditions on groups would else be computed for every row before it is grouped."""
    assert any(table in f for f in queries.QUERIES[name](spark, small).inputFiles())


@pytest.mark.parametrize(("name", "text"), [("query_plan", "regexp_extract_all"), ("semantic_taxonomy", "regexp_extract_all"), ("semantic_taxonomy_conflict", "regexp_extract_all")])
def test_texts_are_taken_apart_once(spark, small, name, text):
    assert plan(queries.QUERIES[name](spark, small)).count(text) == 1


def test_pages_are_read_few_at_a_time():
    """No more pages at once than STEP, all of them in order."""
    n = 2 * html.STEP + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["https://a.example/"] * n, "html": ["<a href='/contact'>x</a>"] * n})
    parts = list(html._read([batch], html._links, ["page_id", "n", "target", "label", "score", "same_site", "is_document"], [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]))
    assert [p.num_rows for p in parts] == [html.STEP, html.STEP, 1]
    assert [i for p in parts for i in p.column("page_id").to_pylist()] == list(range(n))


def test_blocks_are_compared(spark, small):
    """Names meet in bounded blocks; no function is called for each of the pairs."""
    text = plan(queries.QUERIES["fuzzy_ratio"](spark, small))
    assert "MapInArrow" in text and "EvalPython" not in text


def test_pairs_of_repeated_names(spark, monkeypatch):
    """One key beyond a block's size, names of several rows beyond a list's, nulls: a row for each pair of rows."""
    monkeypatch.setattr(pairs, "LEFT", 3), monkeypatch.setattr(pairs, "RIGHT", 5)
    left = [("k", f"name {i % 7}") for i in range(20)] + [("m", "x"), (None, "x"), ("m", None), ("only left", "y")]
    right = [("k", f"Name#{i % 11}") for i in range(40)] + [("m", "x y"), ("m", ""), (None, "x")]
    found = pairs.fuzzy_pairs(*[spark.createDataFrame(rows, "key string, name string") for rows in (left, right)])
    expected = [(a, b, fuzzy.ratio_of(a, b), fuzzy.partial_of(a, b), fuzzy.token_set_of(a, b)) for k, a in left for j, b in right if k == j is not None and a is not None]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_artifacts_are_compressed(spark, small):
    files = queries.QUERIES["written_artifacts"](spark, small).inputFiles()
    assert files and all(f.endswith(".txt.gz") for f in files)
