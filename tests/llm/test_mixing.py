import itertools
import random

from pyspark.sql import functions as F

from leafmill.llm import mixing


def best_total(patterns, targets, total):
    """Most tokens that can be placed: the smallest cut over all subsets of sources (Gale's condition)."""
    names = sorted(targets)
    best = None
    for r in range(len(names) + 1):
        for cut in itertools.combinations(names, r):
            # quotas of the sources in the cut, and what the patterns can give the others
            value = sum(round(targets[s][0] * total) for s in cut)
            for p, n in patterns.items():
                rest = [s for s in p if s not in cut]
                top = max((targets[s][1] for s in p), default=0)
                value += min(n * top, sum(n * targets[s][1] for s in rest))
            best = value if best is None else min(best, value)
    return best


def test_flow_is_a_largest_one_and_keeps_the_caps():
    rng = random.Random(5)
    for _ in range(60):
        targets = {s: (rng.choice([0.1, 0.3, 0.6]), rng.randint(0, 4)) for s in "abc"}
        patterns = {p: rng.randint(1, 50) for r in (1, 2, 3) for p in itertools.combinations("abc", r) if rng.random() < 0.7}
        total = rng.randint(10, 200)
        flow = mixing.plan(patterns, targets, total)
        assert sum(flow.values()) == best_total(patterns, targets, total)
        for (p, s), f in flow.items():
            assert s in p and 0 < f <= patterns[p] * targets[s][1]
        for s in targets:
            assert sum(f for (_, t), f in flow.items() if t == s) <= round(targets[s][0] * total)
        for p in patterns:
            assert sum(f for (q, _), f in flow.items() if q == p) <= patterns[p] * max(targets[s][1] for s in p)


def test_repetition_is_spread_before_it_grows():
    # both patterns can serve the source; each is used once before any is used twice
    flow = mixing.plan({("a",): 10, ("a", "b"): 10}, {"a": (1.0, 3), "b": (0.0, 3)}, 20)
    assert flow == {(("a",), "a"): 10, (("a", "b"), "a"): 10}


def test_documents_reach_their_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("tokens"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("sources"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 3), ("c", 0.2, 2), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(spark, docs, targets, total=20_000)
    used = {r.source: r for r in m.select().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()}
    for r in m.report.collect():
        if r.source == "gone":
            assert r.short and r.planned == 0
            continue
        # the plan in tokens is met up to the size of a document at each end of an interval
        assert abs(used[r.source].t - r.planned) <= 60
        assert used[r.source].c <= r.max_repeats and not r.short
    assert m.select().groupBy("doc_id", "source").count().filter("count > 1").count() == 0
    again = mixing.mix(spark, docs.repartition(7), targets, total=20_000).select()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.select().collect()))


def test_shortage_and_odd_rows(spark):
    rows = [(1, ["a"], 5, "x"), (1, ["a"], 5, "x"), (2, None, 5, "x"), (3, ["zzz"], 5, "x"), (4, ["b", "b", None], 0, "x"), (5, [], 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, sources array<string>, tokens bigint, bucket string")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1), ("n", None, None)], "source string, target_share double, max_repeats int")
    m = mixing.mix(spark, docs, targets, total=100)
    report = {r.source: r for r in m.report.collect()}
    assert (report["a"].tokens, report["a"].planned, report["a"].short) == (10, 20, True)
    assert report["b"].short and not report["n"].short
    assert [(r.doc_id, r.copies) for r in m.select().collect()] == [(1, 2), (1, 2)]
    empty = mixing.mix(spark, docs.limit(0), targets)
    assert all(r.tokens == 0 for r in empty.report.collect()) and empty.select().count() == 0


def test_all_of_many_targets_are_planned(spark):
    names = [f"s{i:04}" for i in range(1100)]
    targets = spark.createDataFrame([(s, 1 / 1100, 1) for s in names], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(i, [s], 10) for i, s in enumerate(names)], "doc_id bigint, sources array<string>, tokens bigint")
    m = mixing.mix(spark, docs, targets)
    assert m.report.count() == 1100 and m.report.filter("planned = 10").count() == 1100
    try:
        mixing.mix(spark, docs, targets, max_patterns=100)
        raise AssertionError("too many patterns must be refused")
    except ValueError:
        pass
