"""Problem 7: one mixture of several sources with target shares.

Documents are aggregated by membership pattern (the set of target sources they belong to), so the plan is made
on a table whose size is bounded by the number of patterns, never by the number of documents:

* every pattern offers its tokens once per repetition; the k-th repetition costs k, so repetitions are spread
  evenly and nothing is repeated while unused tokens remain;
* every source asks for its share of the total and takes from a pattern at most `max_repeats` times its tokens;
* a min-cost flow gives the tokens that each pattern gives to each source.

The flow is then turned into documents: each pattern's documents lie on a line in a seeded order, as long as
their tokens, and a source takes an interval of the line, repeated as often as needed.  Positions come from
bucket sums and a window inside each bucket, so that a source with a third of all rows is spread over all tasks.

Results by case: null text has 0 tokens; a null or unknown source takes no part; repeated rows are separate
records; a source without documents or with null `max_repeats` or share gets nothing and is reported; with an empty
document table every source reports 0 tokens.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of the seeded order of a pattern.
BUCKETS = 4096
#: Membership patterns that a plan is made for by default; `mix` refuses a corpus with more, and never leaves one out.
MAX_PATTERNS = 1 << 16


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, start: int, end: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of a cheapest largest flow, by cheapest augmenting paths."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, capacity, price in arcs:
        for x, y, r, c in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
    potential = [0] * nodes
    while True:
        best = [None] * nodes
        via = [-1] * nodes
        best[start] = 0
        heap = [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in graph[u]:
                if room[e]:
                    v, n = to[e], d + cost[e] + potential[u] - potential[to[e]]
                    if best[v] is None or n < best[v]:
                        best[v], via[v] = n, e
                        heapq.heappush(heap, (n, v))
        if best[end] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        for u in range(nodes):
            if best[u] is not None:
                potential[u] += best[u]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def plan(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source. targets: source -> (share, max_repeats)."""
    names, sources = sorted(patterns), sorted(targets)
    place = {s: j for j, s in enumerate(sources)}
    start, end, base = 0, 1, 2 + len(names)
    arcs, meaning = [], []
    for i, p in enumerate(names):
        for k in range(1, max((targets[s][1] for s in p), default=0) + 1):
            arcs.append((start, 2 + i, patterns[p], k))
        for s in p:
            meaning.append((len(arcs), p, s))
            arcs.append((2 + i, base + place[s], patterns[p] * targets[s][1], 0))
    for j, s in enumerate(sources):
        arcs.append((base + j, end, round(targets[s][0] * total), 0))
    flow = min_cost_flow(arcs, base + len(sources), start, end)
    return {(p, s): flow[i] for i, p, s in meaning if flow[i]}


@dataclass
class Mixture:
    """report: source, target_share, max_repeats, tokens, wanted, planned, short; select() gives the documents."""

    report: DataFrame
    documents: DataFrame
    flow: dict
    patterns: dict
    total: int
    seed: int
    key: str

    def select(self) -> DataFrame:
        """The key, source, tokens, copies of each document that is used."""
        spark: SparkSession = self.documents.sparkSession
        rows, at = [], {}
        for (p, s), f in sorted(self.flow.items()):
            rows.append(("\x00".join(p), s, at.get(p, 0), at.get(p, 0) + f, self.patterns[p]))
            at[p] = at.get(p, 0) + f
        intervals = spark.createDataFrame(rows, "pattern string, source string, x0 bigint, x1 bigint, length bigint")
        docs = self.documents.withColumn("h", F.xxhash64(F.lit(self.seed), F.col("key"))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
        sums = docs.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
        before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("pattern", "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("bucket_start"))
        inside = Window.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
        placed = docs.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, ["pattern", "bucket"])
        start = F.col("bucket_start") + F.col("within")
        passes = lambda x: F.ceil((F.col(x) - start).cast("double") / F.col("length"))
        # a row for each pattern and source of the plan: broadcast by the optimizer's own size check
        used = placed.join(intervals, "pattern").withColumn("copies", (passes("x1") - F.greatest(passes("x0"), F.lit(0))).cast("int"))
        return used.filter("copies > 0").select(F.col("key").alias(self.key), "source", "tokens", "copies")


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 7, max_patterns: int = MAX_PATTERNS) -> Mixture:
    """Plan a mixture. documents: `key`, `sources` (array of the sources of a record), `tokens`; other columns are not read.

    total: tokens of the whole mixture; by default the tokens of all documents of the target sources.
    targets: `source`, `target_share`, `max_repeats`; all its rows are planned for.
    max_patterns: how many different sets of sources the plan may hold on the driver; more of them are an error.
    """
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None}
    known = F.array_sort(F.array_intersect(F.array_distinct("sources"), F.array(*[F.lit(s) for s in sorted(wanted)]).cast("array<string>")))
    docs = documents.select(F.col(key).alias("key"), F.concat_ws("\x00", known).alias("pattern"), "tokens").filter("pattern <> ''")
    sums = docs.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["pattern"].split("\x00")): r["tokens"] for r in sums if r["tokens"]}
    if total is None:
        total = sum(patterns.values())
    flow = plan(patterns, wanted, total)
    rows = []
    for s, (share, repeats) in sorted(wanted.items()):
        planned = sum(f for (_, t), f in flow.items() if t == s)
        rows.append((s, share, repeats, sum(n for p, n in patterns.items() if s in p), share * total, planned, planned < round(share * total)))
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens bigint, wanted double, planned bigint, short boolean")
    return Mixture(report, docs, flow, patterns, total, seed, key)
