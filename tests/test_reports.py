"""Snapshots, artifacts, reports and corroboration on small tables against plain Python."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from orgweave.functions import names as N
from orgweave.operators import corroboration, evaluation, reports, snapshots
from orgweave.plans import report_queries as Q

ENTRY = "store string, namespace string, key string, schema_version long, value string, at long"
ROWS = [
    ("crawl", "site", "é\"\\/\n", 7, '{"b": [1, 2.5, {"password": "x", "a": null}], "a": "ü", "API_KEY": 1}', 1), ("crawl", "site", "old", 7, '{"v": 1}', 1), ("crawl", "site", "old", 7, '{"v": 2}', 2),
    ("mail", None, "k", None, None, 1), ("mail", "x", "k", 1, "no json", 1), ("mail", "x", "k", 2, "true", 1),
]


def plain_entries(rows):
    def safe(x):
        if isinstance(x, dict):
            return {k: safe(v) for k, v in x.items() if k.casefold() not in snapshots.SECRETS}
        return [safe(v) for v in x] if isinstance(x, list) else x

    last = {}
    for store, namespace, key, version, value, at in sorted(rows, key=lambda r: r[5]):
        try:
            parsed = None if value is None else json.loads(value)
        except ValueError:
            parsed = value
        last[store or "", namespace or "", key or "", version or 0] = safe(parsed)
    return [{"store": s, "namespace": n, "key": k, "schema_version": v, "value": x} for (s, n, k, v), x in sorted(last.items())]


def test_snapshot_has_pythons_hash(spark):
    taken = snapshots.record(spark.createDataFrame(ROWS, ENTRY), "at")
    expected = plain_entries(ROWS)
    canonical = json.dumps(expected, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert taken.count == len(expected) == 5 and taken.sha256 == hashlib.sha256(canonical.encode()).hexdigest()
    assert {json.dumps(json.loads(r.entry)["value"], sort_keys=True) for r in taken.entries.collect()} == {json.dumps(e["value"], sort_keys=True) for e in expected}
    snapshots.verify(taken, 5, taken.root)
    for count, root in ((4, taken.root), (5, "0" * 64)):
        with pytest.raises(ValueError):
            snapshots.verify(taken, count, root)


def plain_root(entries, width):
    """The tree by recursion over the places' digits."""
    marks = sorted((hashlib.sha256("\x1f".join(map(str, (e["store"], e["namespace"], e["key"], e["schema_version"]))).encode()).hexdigest(), hashlib.sha256(json.dumps(e, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()) for e in entries)
    depth = next(d for d in range(20) if width * 16**d >= len(entries))
    level = [(m, h) for m, h in marks]
    for d in range(depth, -1, -1):
        groups = collections.defaultdict(list)
        for m, h in level:
            groups[m[:d]].append(h)
        level = [(m, hashlib.sha256("\n".join(hs).encode()).hexdigest()) for m, hs in sorted(groups.items())]
    return level[0][1], depth


@pytest.mark.parametrize("n,width", [(3, 4), (60, 4), (700, 4)])
def test_tree_and_changes(spark, n, width):
    r = random.Random(n)
    first = [("s", f"n{r.randrange(3)}", str(i), 1, str(i), 1) for i in range(n)]
    later = [(s, ns, k, v, "999" if i in (1, n // 2) else x, t) for i, (s, ns, k, v, x, t) in enumerate(first) if i != 2] + [("s", "new", "x", 1, "1", 1)]
    a, b = (snapshots.record(spark.createDataFrame(rows, ENTRY), "at", width) for rows in (first, later))
    root, depth = plain_root(plain_entries(first), width)
    assert a.root == root and a.nodes.agg(F.max("level")).first()[0] == depth == snapshots.depth_of(n, width)
    got = {(r.namespace, r.key, r.change) for r in snapshots.changes(a, b).collect()}
    assert got == {(first[1][1], "1", "changed"), (first[n // 2][1], str(n // 2), "changed"), (first[2][1], "2", "removed"), ("new", "x", "added")} - ({(first[1][1], "1", "changed")} if n == 3 and n // 2 == 1 else set()) | ({(first[1][1], "1", "changed")} if n == 3 else set())
    assert snapshots.changes(a, a).collect() == []
    if depth == 4:
        assert snapshots.differing_leaves(a, b).count() <= 4
    none = snapshots.record(spark.createDataFrame([], ENTRY), "at", width)
    assert none.root == "" and {x.change for x in snapshots.changes(none, a).collect()} == {"added"} and snapshots.changes(a, none).count() == n


def test_snapshots_of_other_depths(spark):
    few, many = ([("s", "n", str(i), 1, str(i), 1) for i in range(n)] for n in (3, 100))
    a, b = (snapshots.record(spark.createDataFrame(rows, ENTRY), "at", 4) for rows in (few, many))
    assert {(r.key, r.change) for r in snapshots.changes(a, b).collect()} == {(str(i), "added") for i in range(3, 100)}


def test_artifacts_in_one_scan(spark, small, tmp_path):
    rows = Q.results(spark, small)
    counts = reports.write_artifacts(rows, f"{tmp_path}/out")
    assert counts == reports.run_report(rows).first().asDict()
    plan = reports.artifact_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    plain = [r.asDict(recursive=True) for r in rows.collect()]
    ok = [r for r in plain if r["status"] in reports.OK_STATUSES]
    listed = {a: [json.loads(r.value) for r in reports.read_artifact(spark, f"{tmp_path}/out", a).collect()] for a in reports.ARTIFACTS}
    assert sorted(r["website"] for r in listed["contacts"]) == sorted(r["website"] for r in ok)
    assert all(r["website_status"] == ("verified" if r["website"] else "not_found") for r in listed["verified_contacts"])
    assert len(listed["review_queue"]) == len(listed["failed"]) == len(plain) - len(ok) and set(listed["failed"][0]) == {"company", "status", "reason"}
    assert {r["status"] for r in listed["failed"]} >= {""} and len(listed["status_log"]) == len(plain)
    assert sorted((r["company"], r["gap"]) for r in listed["acquisition_plan"]) == sorted((r["company"], g) for r in plain for g in r["gaps"])
    assert collections.Counter(r["place"] for r in listed["website_candidates"]) == collections.Counter(i + 1 for r in plain for i in range(len(r["candidates"])))


REPORTED = "company string, website string, email string, phone string, status string, reason string, score int, email_verification string, publication_eligible boolean, publication_blockers string, publication_policy_action string, publication_risk_tier string, email_publication_status string, phone_publication_status string, gaps array<string>, candidates array<struct<domain:string,score:int>>"


def test_report_separates_held_rows_from_publications(spark):
    rows = [
        ("PUBLISHED", "https://published.example", "info@published.example", "02125550000", "OK_HIGH_CONFIDENCE", None, 90, "verified", True, None, None, "low", None, None, None, [("a", 1), ("b", 2)]),
        ("HELD", "https://held.example", "info@held.example", "02125550001", "REVIEW_NEEDED", None, None, "verified", False, reports.UNPROVED, None, None, None, None, ["x"], None),
    ]
    counts = reports.run_report(spark.createDataFrame(rows, REPORTED)).first().asDict()
    lines = reports.report_lines(counts, {"http.crawler.requests": 5})
    assert {"publication_eligible: 1 (50.0%)", "complete_held: 1 (50.0%)", "identity_unproved: 1 (50.0%)", "average_score: 45.0", "candidates_per_company: 1.0", "crawler_requests: 5", "source_5xx: 0"} <= set(lines)
    empty = reports.run_report(spark.createDataFrame([], REPORTED)).first().asDict()
    assert set(empty.values()) == {0} and "websites: 0 (0.0%)" in reports.report_lines(empty, {})


def test_corroboration_asks_once(spark):
    profiles = spark.createDataFrame([("ORNEK GIDA", "Ornek Gida", "https://www.ornek.com.tr/about", None), ("Other", "Else", "https://other.com", None), ("Short", "Short Metal", "https://lnk.in/x", "https://short.com")], "company string, name string, website string, resolved string")
    asked = spark.createDataFrame([("Örnek Gıda", "https://ornek.com.tr/x"), ("ORNEK GIDA", "http://shop.ornek.com.tr"), ("Other", "https://other.com"), ("Short", "https://short.com"), ("Nobody", "https://nobody.com"), ("x", None), (None, "https://y.com")], "company string, url string")
    memory = spark.createDataFrame([], corroboration.MEMORY)
    answers, looked_up = corroboration.corroborate(asked, profiles, memory, 1)
    assert {(r.company_key, r.domain, r.verified) for r in answers.collect()} == {("ornek gida", "ornek.com.tr", True), ("other", "other.com", False), ("short", "short.com", True), ("nobody", "nobody.com", False), ("", "y.com", False)}
    assert looked_up.count() == 5
    memory = corroboration.remember(memory, answers)
    again, looked_up = corroboration.corroborate(asked, profiles, memory, 2)
    assert again.count() == looked_up.count() == 0 and corroboration.remember(memory, again).count() == 5
    more, looked_up = corroboration.corroborate(spark.createDataFrame([("ornek gida", "https://ornek.com")], "company string, url string"), profiles, memory, 3)
    assert [(r.domain, r.website_match, r.batch) for r in more.collect()] == [("ornek.com", False, 3)] and looked_up.count() == 0


def test_related_names(spark):
    cases = [
        ("Aurora Metal", "Aurora Metal", "AURORA YILDIZ-TEKS SİTESİ ve AURORA YILDIZTEKS SİT.", ["aurora yildizteks"]), ("Aurora Metal", "Aurora", "AURORA YENI SITESI", []), ("Aurora Metal", "Aurora Metal", "BASKA YENI SITESI", []),
        ("Aurora", "aurora", "AURORA BIR SITE and AURORA YENI SITESI, AURORA ESKI SIT, AURORA BUYUK SIT", ["aurora bir", "aurora yeni"][1:] + ["aurora eski"]), (None, "x", "A", []), ("Aurora", None, None, []),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "c string, t string, s string")
    assert [r.x for r in rows.select(N.related_names("c", "t", "s").alias("x")).collect()] == [c[3] for c in cases]


def test_business_markers(spark):
    from orgweave.functions import text as T

    texts = ["Çelik çelik, travel agency", "travel-agency hotelier otel", "", None, "e ticaret e-ticaret insaat"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize("t").alias("n"))
    got = [sorted(r.m) for r in rows.select(evaluation.business_markers(F.col("n"), T.tokens("n")).alias("m")).collect()]
    assert got == [["celik", "travel agency"], ["otel"], [], [], ["e ticaret", "insaat"]]
