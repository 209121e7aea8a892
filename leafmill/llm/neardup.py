"""Problem 5: near-duplicate records with small edits.

Two records are linked if the Jaccard similarity of their sets of word triples is at least one half.

The fingerprint of a record is the set of its hashed triples, read as a bit vector over the hash space.  The bit
vector is cut into segments and a record is embedded as its bit counts per segment.  The Manhattan distance of two
embeddings is a lower bound of the number of differing bits, and a similarity of one half allows at most a third of the
bits of both records to differ, so a pair beyond that bound cannot be a link.

The embedding is used at two widths.  In the finest one a segment is one hash class, its count is 0 or 1, and the grid
over it has one cell for each segment with a count of 1.  Distance and sizes bound how many of these cells a pair must
share: n and m triples, at least (n + m) / 3 cells, and n and m within a factor of two.  The segments have one order, rare
ones first; how common a segment is comes from a count sketch of fixed size over all records, and any order is right, a
good one only saves work.  Then the first shared cell of a pair stands in the first half of the longer record and in the
first third of the shorter one; so do the first `MEETINGS` shared ones, as many places further.  So a record lies in
the cells of its first half and those places, and two records are a candidate if they meet in so many cells (more of a
long pair, fewer if the pair need not share so many) in which what follows in either of them is still long enough.  A
segment of one record alone needs no cell; a cell of very many records is compared in pieces, every piece with every other
one.  No pair is left out.  In the coarse embedding of `SEGMENTS` segments the Manhattan bound is then tested for each
candidate, and what is left is verified on whole sets of 50-bit hashes.

A cell's rows travel packed: a block holds the cells of one shard of many records in order, as differences and byte planes,
compressed.  What is kept of a cell's hash inside a shard is short, so cells may fall together, which adds candidates and
loses none.

Results by case: null texts and texts of under three words have no triples and no links; a re-delivered id is one record;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import broadcast_if_small, written

SEGMENTS, WIDTH = 128, 1 << 21
#: A cell of more records than this by the sketch is compared in pieces of about so many.
HOT = 8192
#: In how many cells a pair must meet: so many, or one for so many triples of both, if that is more.
MEETINGS, LONG = 6, 96
#: Members of a class that are paired in one task.
PIECE = 1000
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_LOW = np.uint64((1 << 50) - 1)
_BLOCKS = 64
_ONE = np.uint64(8)  # a count of one as the sketch packs it
#: Cells of one shard, bits that are kept of a cell inside it, cells that a task packs at once, pairs that it merges at once.
#: A shard that turns out larger is read in parts of so many cells, or of `MERGE` pairs, so no task holds more.
SHARD, KEPT, FLUSH, MERGE = 1_000_000, 28, 1_000_000, 2_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def triples(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 50-bit triple hashes of up to 16,384 texts, sorted inside each text, and the number of each text's."""
    words, ends = [], [0]
    for t in texts:
        if t:
            words += WORD.findall(t.lower())
        ends.append(len(words))
    if len(words) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    x = _mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9), 1)
    ends = np.array(ends)
    which = np.repeat(np.arange(len(texts)), np.diff(ends))
    inside = which[:-2] == which[2:]
    y = (which[:-2][inside].astype(np.uint64) << np.uint64(50)) | (x[inside] >> np.uint64(14))
    y.sort()
    if len(y):
        y = y[np.concatenate([[True], y[1:] != y[:-1]])]
    return y & _LOW, np.bincount((y >> np.uint64(50)).astype(np.int64), minlength=len(texts))


def _parts(batch, size: int = 4096):
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def _packed_counts(n: np.ndarray) -> bytes:
    return np.minimum(255, np.round(8 * np.log2(1.0 + n))).astype(np.uint8).tobytes()


def _counts(packed: bytes) -> np.ndarray:
    return np.exp2(np.frombuffer(packed, np.uint8) / 8.0) - 1.0


def _arrow(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


FIRST = "kind int, id bigint, n int, class_hash bigint, counts binary, block int, sketch binary"


def first_look(records: DataFrame) -> DataFrame:
    """In one pass over the texts: n, class_hash and counts (the coarse embedding: bit counts of the segments up to three,
    two bits each) of every record, and blocks of the count sketch of each task.

    Every task counts all its records in one array of `WIDTH` hash classes and packs it on a logarithmic scale.
    """

    def run(batches):
        names = [c.split()[0] for c in FIRST.split(", ")]
        total = np.zeros(WIDTH, np.int32)
        for batch in batches:
            for part in _parts(batch):
                low, sizes = triples(part.column(2).to_pylist())
                keep = np.flatnonzero(sizes)
                if not len(keep):
                    continue
                np.add.at(total, (low % np.uint64(WIDTH)).astype(np.int64), 1)
                n = sizes[keep]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                whole = np.add.reduceat(_mix(low, 77), starts)
                rows = pa.array(keep)
                none = pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.binary())
                yield _arrow(names, part.column(0).take(rows), part.column(1).take(rows), pa.array(n.astype(np.int32)), pa.array(whole.view(np.int64)), _bytes_of(_embedded(low, n)), *none)
        blocks = total.reshape(_BLOCKS, -1)
        used = [i for i in range(_BLOCKS) if blocks[i].any()]
        nulls = [pa.nulls(len(used), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())]
        yield _arrow(names, *nulls, pa.array(used, pa.int32()), pa.array([_packed_counts(blocks[i]) for i in used], pa.binary()))

    return records.select("kind", "id", "text").mapInArrow(run, FIRST)


def _embedded(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of the segments of each record, four to a byte; cutting a count off at three keeps the distance a lower bound."""
    owner = np.repeat(np.arange(len(n)), n)
    segment = np.bincount(owner * SEGMENTS + (_mix(low, 99) % np.uint64(SEGMENTS)).astype(np.int64), minlength=len(n) * SEGMENTS)
    few = np.minimum(3, segment.reshape(len(n), SEGMENTS)).astype(np.uint8)
    return (few[:, ::4] << 6) | (few[:, 1::4] << 4) | (few[:, 2::4] << 2) | few[:, 3::4]


def sketch(first: DataFrame) -> bytes:
    """How many records have a triple of each hash class, one byte each. The blocks of the tasks are added up in two rounds, so
    that no task reads those of all others; the driver gets WIDTH bytes whatever the size of the corpus."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = _counts(packed)
                sums[block] = sums[block] + n if block in sums else n
        yield _arrow(["block", "counts"], pa.array(list(sums), pa.int32()), pa.array([_packed_counts(n) for n in sums.values()], pa.binary()))

    schema = "block int, counts binary"
    # the first round adds up what a task reads of the written table, and nothing is shuffled in it
    blocks = first.filter("block is not null").select("block", F.col("sketch").alias("counts")).mapInArrow(add, schema)
    rows = blocks.repartition(_BLOCKS, "block").mapInArrow(add, schema).collect()
    by = {r["block"]: bytes(r["counts"]) for r in rows}
    return b"".join(by.get(i, bytes(WIDTH // _BLOCKS)) for i in range(_BLOCKS))


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, compressed; arrays in ascending order as differences."""
    head, planes = [], []
    for x in arrays:
        x = x.astype(np.int64)
        rising = bool(len(x)) and bool((x[1:] >= x[:-1]).all())
        if rising:
            x = np.diff(x, prepend=0)
        head += [len(x), int(rising)]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _parts_of(blocks: list[bytes], columns: int, most: int) -> int:
    """In how many parts packed blocks with so many values a row are read, for about `most` rows a part."""
    return -(-sum(int.from_bytes(b[:8], "little") for b in blocks) // (8 * columns * most)) or 1


def _unpack(packed: bytes, count: int) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    head, at, out = np.frombuffer(raw, np.int64, 2 * count), 16 * count, []
    for k in range(count):
        n, rising = int(head[2 * k]), head[2 * k + 1]
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()
        out.append(np.cumsum(x) if rising else x)
        at += 8 * n
    return out


def _cells(low, n, kind, ids, common):
    """cell (a hash), owner and at (four times the place, and the side of a pair of pieces) of every row of a cell, about
    `FLUSH` rows at a time: a record of hot cells has many."""
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(n)), n)
    usual = common[(low % np.uint64(WIDTH)).astype(np.int64)].astype(np.uint64)
    # triples of equal 44 bits count as one that occurs twice, which leaves the filter exact
    order = (owner.astype(np.uint64) << np.uint64(52)) | (usual << np.uint64(44)) | (low >> np.uint64(6))
    order.sort()
    place = np.arange(len(low)) - np.repeat(starts, n)
    usual = (order >> np.uint64(44)) & np.uint64(255)
    chosen = np.flatnonzero((place < np.repeat(n // 2 + np.maximum(MEETINGS, 3 * n // LONG), n)) & (usual > _ONE))
    owner, place, usual = owner[chosen], place[chosen], usual[chosen]
    cell = _mix(order[chosen] & np.uint64((1 << 44) - 1), 21) ^ _mix(kind[owner].astype(np.uint64), 22)
    # a hot cell in pieces: a record goes to the pairs of its own piece with every piece, on side 0 or 1, or 2 with itself
    pieces = np.maximum(1, np.ceil((np.exp2(usual / 8.0) - 1) / HOT)).astype(np.int64)
    own = (_mix(ids[owner].view(np.uint64), 23) % pieces.astype(np.uint64)).astype(np.int64)
    ends = np.cumsum(pieces)
    start = 0
    while start < len(cell):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FLUSH, "right")))
        some = pieces[start:end]
        row = np.repeat(np.arange(start, end), some)
        other = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        of = own[row]
        both = np.minimum(of, other) * 1_000_003 + np.maximum(of, other)
        to = np.where(pieces[row] > 1, _mix(cell[row] + both.astype(np.uint64), 24), cell[row])
        yield to, owner[row], 4 * place[row] + np.where(of < other, 0, np.where(of > other, 1, 2))
        start = end


def packed_cells(records: DataFrame, common, shards: int) -> DataFrame:
    """shard, block: the rows of the cells of all records (kind, id, text)."""
    shift = np.uint64(64 - (shards - 1).bit_length())

    def pack(held):
        kind, ids, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        base = np.cumsum([0] + [len(h[0]) for h in held])
        cell = np.concatenate([h[3] for h in held])
        owner = np.concatenate([h[4] + b for h, b in zip(held, base)])
        at = np.concatenate([h[5] for h in held])
        order = np.argsort(cell)
        cell, owner, at = cell[order], owner[order], at[order]
        shard = (cell >> shift).astype(np.int64) if shards > 1 else np.zeros(len(cell), np.int64)
        short = ((cell << (np.uint64(64) - shift if shards > 1 else np.uint64(0))) >> np.uint64(64 - KEPT)).astype(np.int64)
        borders = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        blocks = []
        for x, y in zip(borders, [*borders[1:], len(cell)]):
            used, local = np.unique(owner[x:y], return_inverse=True)
            rank = np.argsort(ids[used], kind="stable")  # in the order of ids, which packs better
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            used = used[rank]
            blocks.append(_pack(short[x:y], place[local], at[x:y], ids[used], kind[used], n[used]))
        return _arrow(["shard", "block"], pa.array(shard[borders].astype(np.int32)), pa.array(blocks, pa.binary()))

    def run(batches):
        usual = np.frombuffer(common.value, np.uint8)
        held, size = [], 0
        for batch in batches:
            for part in _parts(batch):
                low, sizes = triples(part.column(2).to_pylist())
                keep = np.flatnonzero(sizes)
                if not len(keep):
                    continue
                rows = pa.array(keep)
                kind, ids, n = part.column(0).take(rows).to_numpy(), part.column(1).take(rows).to_numpy(), sizes[keep]
                for cells in _cells(low, n, kind, ids, usual):
                    held.append((kind, ids, n, *cells))
                    size += len(cells[0])
                    if size >= FLUSH:
                        yield pack(held)
                        held, size = [], 0
        if size:
            yield pack(held)

    return records.select("kind", "id", "text").mapInArrow(run, "shard int, block binary")


def candidates(cells: DataFrame, shards: int) -> DataFrame:
    """kind, a, b (a < b) of all records that may share half of their triples, from packed cells."""

    def meet(batches):
        out, pairs = [], 0
        for blocks in _shards(batches):
            for some in _met(blocks):
                out.append(some)
                pairs += len(some[0])
                if pairs >= MERGE:
                    yield from _packed_pairs(_once(out), shards)
                    pairs = 0
        if out:
            yield from _packed_pairs(_once(out), shards)

    def count(batches):
        for blocks in _shards(batches):
            yield from _often(blocks)

    spread = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    met = spread(cells).mapInArrow(meet, "shard int, block binary")
    return spread(met).mapInArrow(count, "kind int, a bigint, b bigint")


def _shards(batches):
    """The packed blocks of one shard after the other."""
    held, last = [], None
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and shard != last:
                yield held
                held = []
            last = shard
            held.append(block)
    if held:
        yield held


def _met(blocks: list[bytes]):
    """The meetings in the cells of one shard. All rows of a cell are in the same part of it."""
    parts = _parts_of(blocks, 3, SHARD)
    for part in range(parts):
        held = []
        for block in blocks:
            short, local, at, ids, kind, n = _unpack(block, 6)
            x, y = np.searchsorted(short * parts >> KEPT, (part, part + 1))
            local = local[x:y]
            held.append((short[x:y].astype(np.int32), kind[local].astype(np.int32), ids[local], n[local].astype(np.int32), at[x:y].astype(np.int32)))
        short, kind, ids, n, at = _joined(held)
        order = np.lexsort((n, short))
        yield from _meet(short[order], kind[order], ids[order], n[order], at[order])


def _joined(held: list[tuple]) -> list[np.ndarray]:
    """The columns of all pieces, which are let go."""
    columns = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    return columns


def _meet(cell, kind, r, n, at):
    """The pairs (kind, a, b, in how many cells they must meet) of rows in the order of cell and n."""
    left, side = n - (at >> 2), at & 3
    # the shorter record of a pair still needs two thirds of its triples
    a = np.flatnonzero(3 * (left + np.maximum(MEETINGS, 3 * n // LONG) - 1) >= 2 * n)
    step = 0
    while True:
        step += 1
        a = a[: np.searchsorted(a, len(cell) - step)]
        a = a[cell[a] == cell[a + step]]
        a = a[2 * n[a] >= n[a + step]]
        if not len(a):
            return
        b = a + step
        both = n[a] + n[b]
        need = np.maximum(np.minimum(MEETINGS, (both + 2) // 3), both // LONG)
        good = (3 * (np.minimum(left[a], left[b]) + need - 1) >= both) & ((side[a] != side[b]) | (side[a] == 2)) & (r[a] != r[b]) & (kind[a] == kind[b])
        x, y = r[a[good]], r[b[good]]
        if len(x):
            yield kind[a[good]], np.minimum(x, y), np.maximum(x, y), need[good], np.ones(len(x), np.int32)


def _once(out) -> list[np.ndarray]:
    """Every pair once: kind, a, b, need, and how often it occurs, in the order of kind, a, b. out is emptied."""
    columns = _joined(out)
    order = np.lexsort(columns[2::-1])
    for i in range(5):
        columns[i] = columns[i][order]
    kind, a, b, need, times = columns
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])]))
    return [kind[new], a[new], b[new], np.maximum.reduceat(need, new), np.add.reduceat(times, new, dtype=np.int32)]


def _packed_pairs(pairs: list[np.ndarray], shards: int):
    """Blocks of pairs by a hash of both records, so that all meetings of a pair come together."""
    kind, a, b, need, times = pairs
    to = (_mix(a.view(np.uint64) + _mix(b.view(np.uint64), 31), 32) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    borders = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    blocks = [_pack(*(c[order[x:y]] for c in (kind, a, b, need, times))) for x, y in zip(borders, [*borders[1:], len(to)])]
    yield _arrow(["shard", "block"], pa.array(to[borders].astype(np.int32)), pa.array(blocks, pa.binary()))


def _often(blocks: list[bytes]):
    """The pairs of one shard that meet as often as they must. All meetings of a pair are in the same part of it."""
    parts = _parts_of(blocks, 5, MERGE)
    for part in range(parts):
        held = []
        for block in blocks:
            kind, a, b, need, times = _unpack(block, 5)
            x = np.flatnonzero(_mix(a.view(np.uint64) + _mix(b.view(np.uint64), 31), 33) % np.uint64(parts) == part) if parts > 1 else slice(None)
            held.append((kind[x].astype(np.int32), a[x], b[x], need[x].astype(np.int32), times[x].astype(np.int32)))
        kind, a, b, need, times = _once(held)
        keep = times >= need
        yield _arrow(["kind", "a", "b"], pa.array(kind[keep]), pa.array(a[keep]), pa.array(b[keep]))


def _exact_sets(records: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                low, sizes = triples(part.column(2).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield _arrow(["kind", "id", "set"], part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(low.view(np.int64))))

    return records.select("kind", "id", "text").mapInArrow(run, "kind int, id bigint, set array<bigint>")


def classes_and_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records: kind (int), id (bigint), text.

    Returns the copies (kind, id, rep: members of a class that do not represent it) and the links between
    representatives (kind, a, b, a < b, shared, either).
    """
    spark = records.sparkSession
    first = written(first_look(records), "first-look")
    prints = first.filter("block is null")
    common = spark.sparkContext.broadcast(sketch(first))
    # the rows of a re-delivered id fall together in a class, too
    group = prints.groupBy("kind", "class_hash", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    copies = written(prints.select("kind", "class_hash", "n", "id").join(group.drop("members"), ["kind", "class_hash", "n"]).select("kind", "id", "rep").distinct(), "copies")
    others = broadcast_if_small(written(copies.filter("id <> rep").select("kind", "id"), "others"))
    texts = records.filter("text is not null").join(others, ["kind", "id"], "left_anti")
    # about half of all triples become cells
    shards = 1 << max(4, ((prints.agg(F.sum("n")).first()[0] or 0) // (2 * SHARD)).bit_length())
    met = written(_bounded(candidates(packed_cells(texts, common, shards), shards), prints.join(others, ["kind", "id"], "left_anti").select("kind", "id", "n", "counts")), "met")
    wanted = written(met.select("kind", F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = written(_exact_sets(records.join(broadcast_if_small(wanted), ["kind", "id"], "left_semi")).dropDuplicates(["kind", "id"]), "sets")
    return copies, _verified(met, sets)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets share at least half of what is in either: kind, a, b, shared, either."""
    joined = pairs.join(sets.toDF("kind", "a", "x"), ["kind", "a"]).join(sets.toDF("kind", "b", "y"), ["kind", "b"])
    both = F.size("x") + F.size("y")
    counted = joined.select("kind", "a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), both.alias("both"))
    return counted.filter("3 * shared >= both").select("kind", "a", "b", "shared", (F.col("both") - F.col("shared")).alias("either"))


def _bounded(met: DataFrame, embedded: DataFrame) -> DataFrame:
    """The pairs whose Manhattan distance leaves a similarity of one half possible."""
    embedded = embedded.dropDuplicates(["kind", "id"])
    pairs = met.join(embedded.toDF("kind", "a", "na", "ca"), ["kind", "a"]).join(embedded.toDF("kind", "b", "nb", "cb"), ["kind", "b"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int16) for i in (3, 4))
            apart = sum(np.abs(((a >> k) & 3) - ((b >> k) & 3)).sum(1) for k in (0, 2, 4, 6))
            near = pa.array(np.flatnonzero(3 * apart <= batch.column(5).to_numpy()))
            yield _arrow(["kind", "a", "b"], *(batch.column(i).take(near) for i in range(3)))

    return pairs.select("kind", "a", "b", "ca", "cb", (F.col("na") + F.col("nb")).alias("both")).mapInArrow(run, "kind int, a bigint, b bigint")


def pairs(copies: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id_a, id_b (id_a < id_b) of all linked records, members of classes included."""
    links = written(links.select("kind", "a", "b"), "found-links")
    ends = links.select("kind", F.col("a").alias("rep")).unionByName(links.select("kind", F.col("b").alias("rep"))).distinct()
    # every representative stands for itself and the members of its class
    members = copies.select("kind", "rep", "id").unionByName(ends.withColumn("id", F.col("rep"))).distinct()
    between = links.join(members.select("kind", F.col("rep").alias("a"), F.col("id").alias("x")), ["kind", "a"]).join(members.select("kind", F.col("rep").alias("b"), F.col("id").alias("y")), ["kind", "b"])
    # the pairs of a large class are made in pieces, every piece with all members
    pieces = copies.groupBy("kind", "rep").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    sized = copies.join(pieces, ["kind", "rep"])
    left = sized.select("kind", "rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    right = sized.select("kind", "rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    inside = left.join(right, ["kind", "rep", "piece"]).filter("x < y")
    return between.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(inside.select("kind", F.col("x").alias("id_a"), F.col("y").alias("id_b")))


def groups(copies: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id, group_id (the least id of the group), links (between representatives) of each record that has a near-duplicate."""
    links = written(links.select("kind", "a", "b"), "found-links")
    named = links.select(F.concat_ws(":", "kind", F.lpad(F.col("a").cast("string"), 20, "0")).alias("a"), F.concat_ws(":", "kind", F.lpad(F.col("b").cast("string"), 20, "0")).alias("b"))
    found = components(named)
    number = lambda c: F.element_at(F.split(c, ":"), 2).cast("bigint")
    degree = links.select("kind", F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count(F.lit(1)).alias("links"))
    roots = found.select(F.element_at(F.split("node", ":"), 1).cast("int").alias("kind"), number("node").alias("rep"), number("root").alias("root"))
    reps = degree.join(roots, ["kind", "rep"], "full").unionByName(copies.select("kind", "rep").distinct(), allowMissingColumns=True).groupBy("kind", "rep").agg(F.coalesce(F.max("links"), F.lit(0)).alias("links"), F.coalesce(F.min("root"), F.first("rep")).alias("group_id"))
    members = copies.select("kind", "rep", "id").unionByName(reps.select("kind", "rep", F.col("rep").alias("id"))).distinct()
    return members.join(reps, ["kind", "rep"]).select("kind", "id", "group_id", "links")
