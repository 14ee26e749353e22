import collections
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orgweave.functions.words import WILSON_Z
from orgweave.operators import calibration, candidates, graph, identity, policy, records, state
from orgweave.sources import tables
from orgweave.streaming import limits


def test_curve_and_recommendation(spark):
    rows = [(95, True), (90, True), (80, False), (60, True), (70, None), (None, True), (300, True), (-5, False)]
    out = calibration.curve(spark.createDataFrame(rows, "score int, correct boolean")).orderBy(F.desc("threshold")).collect()
    assert [r.threshold for r in out] == [100, 95, 90, 80, 60, 0]
    assert [r.accepted for r in out] == [1, 2, 3, 4, 5, 6] and out[-1].coverage == 1.0
    n, c, z = 4, 3, WILSON_Z
    p = c / n
    assert out[3].wilson_lower == pytest.approx((p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))
    small = calibration.recommend(calibration.curve(spark.createDataFrame([(90, True)] * 20, "score int, correct boolean")), 0.9, 10).first()
    large = calibration.recommend(calibration.curve(spark.createDataFrame([(90, True)] * 500, "score int, correct boolean")), 0.9, 10).first()
    assert not small.deployable and large.deployable
    assert calibration.recommend(calibration.curve(spark.createDataFrame([], "score int, correct boolean"))).first().threshold is None


def test_labels(spark):
    values = ["true", "No", "1", "incorrect", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.x for r in df.select(calibration.parse_label(F.col("v")).alias("x")).collect()] == [True, False, True, False, None, None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("maybe",)], "v string").select(calibration.parse_label(F.col("v"))).collect()


def test_leakage(spark):
    rows = [("calibration", True), ("holdout", True), ("holdout", None), (None, False)]
    got = {r.role: r.n for r in calibration.leakage(spark.createDataFrame(rows, "role string, correct boolean")).collect()}
    assert got == {"holdout": 1, None: 1}


def test_dedupe_keeps_first_filled_and_orders_sources(spark):
    rows = [("a", 2, "x2", "s2"), ("a", 1, "", "s1"), ("a", 3, "x3", "s1"), ("b", 4, None, None)]
    out = {r.key: r for r in records.dedupe(spark.createDataFrame(rows, "k string, o int, v string, s string"), F.col("k"), "o", ["v"], "s").collect()}
    assert (out["a"].v, out["a"].s, out["a"].n_rows) == ("x2", "s1;s2", 3)
    assert (out["b"].v, out["b"].s) == (None, None)


def test_suffix_anti_join(spark):
    rows = spark.createDataFrame([("a.x.com",), ("x.com",), ("ax.com",), (None,)], "host string")
    listed = spark.createDataFrame([("x.com",)], "domain string")
    assert [r.host for r in records.suffix_anti_join(rows.where("host is not null"), "host", listed).collect()] == ["ax.com"]


def test_apply_and_merge(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (4, "old")], "k int, status string")
    new = spark.createDataFrame([(1, "new"), (3, "new")], "k int, status string")
    decisions = spark.createDataFrame([(1, "new"), (2, "new"), (3, "old")], "k int, decision string")
    got = {r.k: (r.status, r.outcome) for r in records.apply_decisions(base, decisions, new, "k", ["status"]).collect()}
    assert got == {1: ("new", "replaced"), 2: ("old", "missing"), 3: ("old", "kept"), 4: ("old", "undecided")}
    routes = {r.k: r.route for r in records.merge_runs(base, new, "k", "status", ("OK",)).collect()}
    assert routes == {1: "review", 2: "keep", 3: "review", 4: "keep"}


def test_resolution(spark):
    rows = [(1, "f", 5, True), (1, "g", 5, True), (2, "f", 5, True), (2, "f", 5, True), (2, "g", 4, True), (3, "f", 9, False)]
    got = {r.c: (r.status, r.family) for r in candidates.resolve(spark.createDataFrame(rows, "c int, fam string, key int, ready boolean"), ["c"], ["key"], "fam", "ready").collect()}
    assert got == {1: ("ambiguous", None), 2: ("resolved", "f"), 3: ("unresolved", None)}


def test_skyline_spares_family_and_equals(spark):
    rows = [(1, "a", 5, 5, "f"), (1, "b", 4, 4, "g"), (1, "c", 4, 4, "f"), (1, "d", 5, 5, "g"), (1, "e", 9, 1, "h")]
    out = candidates.skyline(spark.createDataFrame(rows, "c int, n string, x int, y int, fam string"), ["c"], ["x", "y"], "fam")
    assert sorted(r.n for r in out.collect()) == ["a", "d", "e"]


def test_picks(spark):
    rows = [(1, i, k) for i, k in enumerate("aaabbc")]
    out = candidates.balanced_pick(spark.createDataFrame(rows, "g int, i int, k string"), ["g"], "k", [F.asc("i")], 4)
    assert [r.i for r in out.orderBy("pick").collect()] == [0, 3, 5, 1]
    passes = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 6, 1), (2, 5, 2)], "k int, q int, p int")
    assert {r.k: r.p for r in candidates.best_pass(passes, ["k"], ["q"], "p").collect()} == {1: 2, 2: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (None, 1), (70, 70)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 50, 55: 50, 70: 70}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_policy_never_promotes(spark):
    df = spark.createDataFrame([(ok, s, b) for ok in (True, False) for s in (0, 74, 75, 100) for b in (0, 1)], "ok boolean, s int, b int")
    blockers = F.when(F.col("b") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    out = df.select("*", policy.policy_action(F.col("ok"), F.col("s"), blockers).alias("a"), policy.risk_tier(F.col("s"), blockers).alias("t")).collect()
    assert all((r.a == "allow") == (r.ok and r.s >= 75 and not r.b) for r in out)
    assert all(r.a == "retain_legacy_abstention" for r in out if not r.ok) and all(r.t == "blocked" for r in out if r.b)


def test_assessment_counts_independent_keys_once(spark):
    rows = [("c", "support", "site", "name", "n", True), ("c", "support", "site", "phone", "p", False), ("d", "support", "site", "n", "1", True), ("d", "support", "registry", "n", "2", True), ("e", "support", "a", "x", "1", False), ("e", "support", "b", "x", "1", False)]
    got = {r.c: (r.n_support, r.n_conflicts, r.publishable) for r in identity.assess(spark.createDataFrame(rows, "c string, polarity string, independence_key string, kind string, value string, strong boolean"), ["c"]).collect()}
    assert got == {"c": (1, 0, False), "d": (2, 1, False), "e": (2, 0, True)}


def test_rounds_stop_without_progress(spark):
    start = spark.createDataFrame([(i, 0) for i in range(6)], "i int, done int")
    step = lambda df, n: df.withColumn("done", F.when(F.col("i") <= n, 1).otherwise(F.col("done")))
    out, n = identity.rounds(start, step, lambda df: df.where("done = 0"), 3)
    assert n == 3 and out.where("done = 1").count() == 3
    out, n = identity.rounds(start, lambda df, n: df, lambda df: df.where("done = 0"), 5)
    assert n == 1


def events(spark, n=300):
    rows = [(i, "p%d" % (i % 3), float((i * 7919) % 1000) / 10, (i * 31) % 5 > 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, provider string, t_s double, success boolean")


def test_limiter_and_budget_against_loops(spark):
    rows, df = events(spark)
    got = {r.event_id: r for r in state.schedule(state.admit(df, "provider", ["t_s", "event_id"], F.lit(10)), "provider", ["t_s", "event_id"], F.col("t_s"), 3).collect()}
    next_s, used = collections.defaultdict(lambda: float("-inf")), collections.Counter()
    for i, p, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(t, next_s[p])
        next_s[p] = start + 1 / 3
        assert got[i].start_s == pytest.approx(start) and got[i].admitted == (used[p] < 10)
        used[p] += 1
    assert state.admit(df, "provider", ["t_s"], F.lit(0)).where("admitted").count() == 0
    assert state.admit(df, "provider", ["t_s"], F.lit(0), zero_is_unlimited=True).where("admitted").count() == 300


def test_streaming_equals_batch(spark, tmp_path):
    rows, df = events(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10, 3, 3, 5.0)
    done = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {r.event_id: r for r in spark.table("limited").collect()}
    batch = state.schedule(state.admit(df, "provider", ["t_s", "event_id"], F.lit(10)), "provider", ["t_s", "event_id"], F.col("t_s"), 3)
    assert len(got) == 300 and any(r.is_open for r in got.values())
    for r in batch.collect():
        assert got[r.event_id].admitted == r.admitted and got[r.event_id].start_s == pytest.approx(r.start_s)


def test_cache_prefix_and_manifest(spark):
    entries = spark.createDataFrame([("a", 1, 1, "2024-01-01"), ("a", 2, 1, "2024-01-05"), ("a", 3, 2, "2024-01-06"), ("b", 4, 1, "2020-01-01")], "k string, entry_id int, schema_version int, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    now = F.to_timestamp(F.lit("2024-01-10"))
    got = {r.k: r.entry_id for r in state.cache_lookup(asked, entries, ["k"], 1, 10 * 86400, now).collect()}
    assert got == {"a": 2, "b": None, "c": None}
    stale = {r.k: r.entry_id for r in state.cache_lookup(asked, entries, ["k"], 1, 10 * 86400, now, stale_ok=True).collect()}
    assert stale["b"] == 4
    m = lambda df: state.manifest(df, [], "entry_id", F.col("k"), width=2).first().sha256
    assert m(entries) == m(entries.orderBy(F.desc("entry_id")).repartition(3)) != m(entries.where("entry_id <> 1"))
    prefix = state.contiguous_prefix(spark.createDataFrame([("r", i) for i in (0, 1, 3, 2, 5)], "run string, i int"), "run", "i").first()
    assert (prefix.n_prefix, prefix.n_done) == (4, 5)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(" Zümrüt ", "", "TR"), ("", "x.example", None)], "Firma string, `Web Sitesi` string, `Ülke` string")
    out = tables.company_records(df).collect()
    assert [(r.company, r.website, r.country) for r in out] == [("Zümrüt", None, "TR")]
    bare = tables.company_records(spark.createDataFrame([("Anka", "a.example")], "c0 string, c1 string")).first()
    assert (bare.company, bare.website) == ("Anka", "a.example")
    (tmp_path / "a.json").write_text('[{"score": 5}, {"score": 6}]')
    (tmp_path / "b.json").write_text('{"score": 5}\n{"score": 6}\n')
    for name in ("a.json", "b.json"):
        assert tables.read_json_records(spark, str(tmp_path / name), "score int").count() == 2
    row = tables.json_lines(spark.createDataFrame([(1, "s")], "a int, _secret_key string")).first().value
    assert row == '{"a":1}'
    assert tables.project(df, ["Firma", "missing"]).first().asDict() == {"Firma": " Zümrüt ", "missing": ""}
    parts = tables.artifacts(spark.createDataFrame([("HIGH",), ("REVIEW",), (None,)], "status string"), "status", ("HIGH",))
    assert [parts[k].count() for k in ("published", "review", "failed")] == [1, 1, 1]


def test_running_values_of_a_hot_key(spark):
    """Limiter, circuit and source health of a key that lies in every range, and of a null key, against plain loops."""
    import random

    from orgweave.operators import registries

    r = random.Random(5)
    rows = [(i, None if i % 50 == 7 else "hot" if r.random() < 0.8 else f"p{r.randrange(5)}", float(r.randrange(40)), r.choice(("available", "server_error", "server_error", "not_found", "circuit_open"))) for i in range(600)]
    calls = spark.createDataFrame(rows, "event_id long, provider string, t double, st string")
    by = {}
    for row in sorted(rows, key=lambda x: (x[2], x[0])):
        by.setdefault(row[1], []).append(row)
    starts, runs, health = {}, {}, {}
    for key, own in by.items():
        free, successes, run, attempts, errors = float("-inf"), 0, 0, 0, 0
        for event, _, t, st in own:
            starts[event] = max(t, free)
            free = starts[event] + 0.5
            run += st == "available"
            if st != "available":
                runs[key, run] = runs.get((key, run), 0) + 1
            attempts, successes, errors = attempts + (st != "circuit_open"), run, 0 if st == "available" else errors + (st == "server_error")
            health[event] = (attempts, successes, errors, errors >= 2, "degraded" if errors >= 2 and st == "server_error" else st)
    got = {x.event_id: x.start_s for x in state.schedule(calls, "provider", ["t", "event_id"], F.col("t"), 2.0).collect()}
    assert got == pytest.approx(starts)
    found = state.failure_runs(calls, "provider", ["t", "event_id"], F.col("st") == "available", 3).collect()
    assert {(x.provider, x.run): x.n_failures for x in found} == runs and all(x.opens == (x.n_failures >= 3) for x in found)
    seen = registries.source_health(calls, "provider", ["t", "event_id"], F.col("st")).collect()
    assert {x.event_id: (x.attempts, x.successes, x.server_errors, x.circuit_open, x.health) for x in seen} == health
    assert state.schedule(calls.limit(0), "provider", ["t", "event_id"], F.col("t"), 2.0).collect() == []
