import random
from itertools import combinations

from leafmill.llm import neardup as N

SCHEMA = "kind int, id bigint, text string, n string, cell string"


def truth(rows):
    sets = {}
    for kind, i, text, *_ in rows:
        w = N.WORD.findall((text or "").lower())
        sets[kind, i] = frozenset(zip(w, w[1:], w[2:]))
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a, b in combinations(sets, 2) if a[0] == b[0] and a[1] != b[1] and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.choice([0, 1])] = [f"new{rng.randrange(9999)}"]
    return words


def corpus(seed, originals=60, size=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for k in range(originals):
        base = ["this", "is", "the", "usual", "beginning", "of", "a", "text"] + [rng.choice(vocabulary) for _ in range(size)]
        for e in (0, 0, 1, 2, 4, 6) if k % 3 == 0 else (0,):
            rows.append((k % 2, n, " ".join(edited(rng, base, e)), "x", "y"))
            n += 1
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [(r.kind, r.id_a, r.id_b) for r in N.pairs(*N.classes_and_links(df)).collect()]


def test_same_pairs_as_brute_force(spark):
    rows = corpus(1)
    rows += [(0, 9000, None, "x", "y"), (0, 9001, "", "x", "y"), (0, 9002, "two words", "x", "y"), (0, 9003, "two words", "x", "y"), (0, 5, rows[5][2], "again", "y"), (1, 9004, "汉字 文本 示例 汉字", "x", "y"), (1, 9005, "汉字文本示例汉字!", "x", "y")]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == truth(rows)


def test_hot_group_of_copies_and_family(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 7)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(60)]
    rows = [(0, i, " ".join(base), "x", "y") for i in range(40)] + [(0, 100 + i, " ".join(edited(rng, base, 2)), "x", "y") for i in range(40)] + corpus(3, 20)[:0]
    rows += [(0, 1000 + r[1], r[2], "x", "y") for r in corpus(4, 40)]
    assert set(run(spark, rows)) == truth(rows)


def test_distance_of_embeddings_is_a_lower_bound(spark):
    import numpy as np

    rows = corpus(7, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    prints = {(r.kind, r.id): (r.n, np.frombuffer(bytes(r.counts), np.uint8).astype(int)) for r in N.first_look(df).filter("block is null").collect()}
    low, sizes = N.triples([r[2] for r in rows])
    ends = np.cumsum(sizes)
    sets = {(r[0], r[1]): set(low[e - s : e].tolist()) for r, s, e in zip(rows, sizes, ends)}
    keys = list(prints)
    for a, b in combinations(keys[:60], 2):
        x, y = prints[a][1], prints[b][1]
        apart = sum(np.abs(((x >> k) & 3) - ((y >> k) & 3)).sum() for k in (0, 2, 4, 6))
        assert apart <= len(sets[a] ^ sets[b])


def test_groups(spark):
    rows = [(0, 3, "a b c d e f g h i j", "x", "y"), (0, 1, "a b c d e f g h i j k", "x", "y"), (0, 2, "a b c d e f g h i j", "x", "y"), (0, 7, "q r s t u v", "x", "y"), (1, 7, "a b c d e f g h i j", "x", "y")]
    copies, links = N.classes_and_links(spark.createDataFrame(rows, SCHEMA))
    assert {(r.kind, r.id, r.group_id) for r in N.groups(copies, links).collect()} == {(0, 1, 1), (0, 2, 1), (0, 3, 1)}


def family(prefix, first, size, template, own):
    """Records with a common template between words of their own: neither half of a record is common to all."""
    base = [f"{prefix}t{i}" for i in range(template + 2)]
    return [(0, first + k, " ".join([*base, *(f"{prefix}o{k}x{i}" for i in range(own))]), "x", "y") for k in range(size)]


def test_families_of_mostly_common_triples(spark):
    # shares of common triples just around two thirds, similarities of 0.517, 0.61 and (no links) 0.48
    rows = family("a", 0, 200, 60, 28) + family("b", 1000, 200, 70, 22) + family("c", 2000, 60, 60, 32)
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == truth(rows)


def test_pair_with_a_common_neighbour_that_is_no_least_one(spark):
    # a-c and b-c are links, a is linked to 3 and b to 7, so a and b have different least neighbours
    rows = family("a", 100, 2, 60, 28)
    a, b = (r[2].split() for r in rows)
    rows += [(0, 50, " ".join(a[:76] + b[-14:]), "x", "y"), (0, 3, " ".join(a + ["more"]), "x", "y"), (0, 7, " ".join(b + ["more"]), "x", "y")]
    rows += [(0, 1000 + r[1], r[2], "x", "y") for r in family("a", 900, 60, 60, 45)]
    got = run(spark, rows)
    assert (0, 100, 101) in got and set(got) == truth(rows)


def test_hot_cells_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 16)
    rows = family("a", 0, 90, 60, 28) + corpus(5, 40)
    rows = [(k, 10_000 + i if t[0] != "a" else i, t, *rest) for k, i, t, *rest in rows]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == truth(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_blocks_are_read_as_they_were_packed():
    import numpy as np

    rng = np.random.default_rng(5)
    arrays = [np.sort(rng.integers(0, 1 << 28, 5000)), rng.integers(0, 300, 5000), rng.integers(-(1 << 62), 1 << 62, 70), np.zeros(0, np.int64), np.array([7])]
    for x, y in zip(arrays, N._unpack(N._pack(*arrays), len(arrays))):
        assert x.tolist() == y.tolist()


def test_large_ids_stay_exact(spark):
    rows = family("a", 0, 3, 60, 28)
    rows = [(0, (1 << 62) + 2 * i + 1, *rest) for _, i, *rest in rows] + [(1, -(1 << 62) - i, rows[i][2], "x", "y") for i in range(3)]
    got = run(spark, rows)
    assert len(got) == 6 and set(got) == truth(rows)


def test_many_small_shards_give_the_same_pairs(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("FLUSH", 500), ("MERGE", 300), ("KEPT", 6)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(6) + [(0, 5000 + i, t, *rest) for _, i, t, *rest in family("a", 0, 30, 60, 28)]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == truth(rows)


def met_of(rows, cells):
    """The packed blocks of one shard, as a task of `packed_cells` makes them."""
    import numpy as np

    low, n = N.triples([r[2] for r in rows])
    kind, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return [N._pack((cell >> np.uint64(64 - N.KEPT)).astype(np.int64)[o], owner[o], at[o], ids, kind, n) for cell, owner, at in cells(low, n, kind, ids) for o in [np.argsort(cell)]]


def test_a_task_holds_a_bounded_part_of_a_large_shard(monkeypatch):
    import numpy as np

    rows = corpus(6, 60)
    common = np.full(N.WIDTH, 100, np.uint8)  # over 5000 records in each class
    monkeypatch.setattr(N, "HOT", 1000)
    monkeypatch.setattr(N, "FLUSH", 500)
    sizes = []

    def cells(low, n, kind, ids):
        for some in N._cells(low, n, kind, ids, common):
            sizes.append(len(some[0]))
            yield some

    blocks = met_of(rows, cells)
    assert max(sizes) <= 500 < sum(sizes)
    whole = N._once(list(N._met(blocks)))
    real, seen = N._meet, []
    monkeypatch.setattr(N, "_meet", lambda cell, *rest: seen.append(len(cell)) or real(cell, *rest))
    monkeypatch.setattr(N, "SHARD", 1000)
    parted = N._once(list(N._met(blocks)))
    assert len(seen) > 10 and max(seen) <= 2000 and all((x == y).all() for x, y in zip(whole, parted))

    out = [tuple(c[k::3] for c in whole) for k in range(3)] * 2
    packed = [N._pack(*c) for c in out]
    at_once = {r for b in N._often(packed) for r in zip(*b.to_pydict().values())}
    monkeypatch.setattr(N, "MERGE", 100)
    parts = [list(zip(*b.to_pydict().values())) for b in N._often(packed)]
    assert len(parts) > 5 and max(map(len, parts)) < len(at_once) and sorted(r for p in parts for r in p) == sorted(at_once)
    assert at_once >= truth(rows)
