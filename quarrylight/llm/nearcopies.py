"""Pairs and groups of texts that share most of their word runs.

The pairs are exact. Two sets with a Jaccard similarity of t or more differ in at most (1-t)/(1+t) of the sum of their sizes,
and share a run among the first |A| - ceil(t|A|) + 1 of either in any common order. Texts meet in the buckets of these
runs, the most frequent last; in a bucket, bit sketches whose bits are flipped by each run are compared in tiles by
exclusive-or and bit count, a lower bound of the difference; what is left is compared run by run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.storage import written

#: Words in a run and least similarity.
RUN, SIMILARITY = 5, 0.8
#: Bits of a sketch, and slots of the table that tells the frequent runs, a byte each, which is broadcast.
BITS, SLOTS = 256, 1 << 24
#: Runs that are counted together, the count in such a block from which a run is reported, and most runs that the table takes
#: up: the most frequent of the whole collection, whatever its size.
BLOCK, REPORTED, FREQUENT = 1 << 22, 8, 1 << 20
#: Texts of a tile. Buckets of more texts are cut into tiles, which meet in pairs.
TILE = 2048
#: Bucket rows that are compared in one go, and most parts that they are spread over.
PART_ROWS, MOST_PARTS = 1 << 20, 100_000
#: Ids, 16 MB of them, up to which a set of ids is broadcast to pick rows; beyond it they are joined by a shuffle.
MOST_IDS = 1 << 21
#: Copies of the other side's rows that a key with a thousandth of all rows is spread over in joins.
SALTS = 32
#: Rows from which a key can be hot.
HOT = 1000
#: Buckets up to this size are compared by shifts of the whole batch, larger ones in tiles of SUBTILE rows.
SMALL, SUBTILE = 32, 256
_DROP = re.compile(r"[^A-Za-z0-9 \t\n\x0B\f\r\x01]+")
_END, _KNOWN = "\x01", 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Words met before and their hashes; the end of a text has the hash 0."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KNOWN:
            self.clear()
        h = self[word] = 0 if word == _END else xxhash.xxh3_64_intdigest(word) | 1
        return h


_hashes = _Hashes()


def run_sets(texts: list[str | None], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``run`` consecutive index terms of each text, sorted by row and hash."""
    whole = f" {_END} ".join([t or "" for t in texts])
    if whole.count(_END) >= len(texts):  # some text has the mark itself, which is no part of a term
        whole = f" {_END} ".join([t.replace(_END, "") if t else "" for t in texts])
    found = _DROP.sub("", whole).lower().split()
    words = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    ends = words == 0
    rows = np.cumsum(ends)[~ends]
    words = words[~ends]
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            hashes = _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    inside = rows[:n] == rows[run - 1 :]
    rows, hashes = rows[:n][inside], hashes[inside]
    order = _order(rows, hashes, 0)
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes


def _order(rows: np.ndarray, hashes: np.ndarray, often: np.ndarray | int) -> np.ndarray:
    """The order by row, ``often`` (a byte) and hash."""
    if len(rows) and rows[-1] >= 1 << 16:
        return np.lexsort((hashes, np.broadcast_to(often, len(rows)), rows))
    # in one number, which sorts faster; the hash's last bits matter only if all others are the same
    key = rows.astype(np.uint64) << np.uint64(48) | np.uint64(often) << np.uint64(40) if isinstance(often, int) else rows.astype(np.uint64) << np.uint64(48) | often.astype(np.uint64) << np.uint64(40)
    order = np.argsort(key | hashes >> np.uint64(24), kind="stable")
    tied = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (hashes[order[1:]] >> np.uint64(24) == hashes[order[:-1]] >> np.uint64(24)) & (hashes[order[1:]] < hashes[order[:-1]]))
    return np.lexsort((hashes, np.broadcast_to(often, len(rows)), rows)) if len(tied) else order


def _survey(run: int, block: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per text its number of runs and a 128-bit hash of the set; per block of texts its frequent runs and their counts."""
    names = ["id", "n", "set_a", "set_b", "run", "times"]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        runs, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= least
        empty = [pa.nulls(int(often.sum()), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*empty, pa.array(runs[often].view(np.int64)), pa.array(times[often])], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, hashes = run_sets(batch.column(1).to_pylist(), run)
            n = np.bincount(rows, minlength=batch.num_rows)
            sets = []
            starts = np.concatenate(([0], np.cumsum(n)))
            for salt in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165):
                with np.errstate(over="ignore"):
                    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(hashes ^ np.uint64(salt)))))
                    sets.append(pa.array((total[starts[1:]] - total[starts[:-1]]).view(np.int64)))
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), *sets, none, none], names=names)
            held.append(hashes)
            size += len(hashes)
            if size >= block:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)

    return work


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: up to 15 as they are, above in steps of an eighth of a doubling, never less than the count."""
    steps = np.ceil(8 * np.log2(np.maximum(counts, 16) / 16)).astype(np.int64)
    return np.where(counts < 16, counts, np.minimum(16 + steps, 255)).astype(np.uint8)


#: The greatest count that a byte stands for.
_COUNT = np.concatenate([np.arange(16), np.ceil(16 * 2.0 ** (np.arange(240) / 8))]).astype(np.int64)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (slots - 1)


def frequency_table(reported: DataFrame, slots: int, most: int) -> np.ndarray:
    """A byte per slot that tells how frequent the most frequent run in it is, of the ``most`` that are the most frequent of
    all; 0 for the others. Only a histogram of the counts and ``most`` runs at most reach the driver.

    Every run that has a share of ``REPORTED`` in ``BLOCK`` of all runs is in ``reported``. It need not be exact: any order
    of the runs that all texts share gives the same pairs.
    """
    sums = written(reported.groupBy("run").agg(F.sum("times").alias("times")), "frequent-runs")
    level = F.floor(F.log2("times") * 8).cast("int")
    kept, lowest = 0, 1 << 30
    for r in sorted(sums.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # under 512 rows
        if kept + r["n"] > most:
            break
        kept, lowest = kept + r["n"], r["level"]
    table = np.zeros(slots, dtype=np.uint8)
    frequent = sums.where(level >= lowest).toArrow()
    runs, times = (frequent.column(i).to_numpy() for i in range(2))
    np.maximum.at(table, _slot(runs.view(np.uint64), slots), _scaled(times))
    return table


_PACKED = "part int, rows binary, texts binary"
_ROW = np.dtype([("key", "<u8"), ("text", "<u4"), ("side", "u1")])
_TEXT = np.dtype([("id", "<i8"), ("n", "<i4"), ("bits", "<u8", BITS // 64)])


def _columns(a: np.ndarray) -> bytes:
    """A table field by field, so that like bytes lie together."""
    return b"".join(np.ascontiguousarray(a[f]).view(np.uint8).reshape(len(a), -1).T.tobytes() for f in a.dtype.names)


def _from_columns(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at, raw = np.empty(n, dtype=kind), 0, np.frombuffer(data, dtype=np.uint8)
    for f in kind.names:
        width = kind[f].itemsize
        out[f] = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind[f].base).reshape((n, *kind[f].shape))
        at += n * width
    return out


def _tile_key(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(keys + _mixed(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1))


def in_tiles(keys: np.ndarray, ids: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side) of bucket rows whose bucket is cut into ``tiles``: a row for each pair of tiles that its own is in,
    which is set by its text's id. Side 0 is for a tile with itself, 1 and 2 are the two tiles of a pair."""
    own = (_mixed(ids.astype(np.uint64)) % tiles.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(keys)), tiles)
    other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    mine = own[at]
    key = np.where(tiles[at] == 1, keys[at], _tile_key(keys[at], np.minimum(mine, other), np.maximum(mine, other)))
    return at, key, np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.uint8)


def _packed(key: np.ndarray, text: np.ndarray, side: np.ndarray, texts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Bucket rows by the part that their bucket is compared in, each with the sketches of its texts once."""
    part = (_mixed(key) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part.astype(np.int32), kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts)))
    out: tuple[list, list, list] = ([], [], [])
    for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
        i = order[lo:hi]
        used, at = np.unique(text[i], return_inverse=True)
        rows = np.empty(len(i), dtype=_ROW)
        rows["key"], rows["text"], rows["side"] = key[i], at, side[i]
        for into, value in zip(out, (int(part[i[0]]), _columns(rows), _columns(texts[used])), strict=True):
            into.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "rows", "texts"])


def prefix_rows(texts: list[str | None], ids: np.ndarray, run: int, t: float, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, count of the run as far as known) of each text's prefix, and the texts' ids, sizes and sketches."""
    rows, hashes = run_sets(texts, run)
    n = np.bincount(rows, minlength=len(texts))
    bit = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    flips = np.bincount(rows * BITS + bit, minlength=len(texts) * BITS) & 1
    out = np.empty(len(texts), dtype=_TEXT)
    out["id"], out["n"], out["bits"] = ids, n, np.packbits(flips.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.uint64)
    often = table[_slot(hashes, len(table))]
    order = _order(rows, hashes, often)
    rows, hashes, often = rows[order], hashes[order], often[order]
    place = np.arange(len(rows)) - np.concatenate(([0], np.cumsum(n)[:-1]))[rows]
    use = place < (n - np.ceil(t * n - 1e-9).astype(np.int64) + 1)[rows]
    return rows[use], hashes[use], _COUNT[often[use]], out


def _emit(run: int, t: float, table, parts: int, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """A row for each text and run of its prefix, packed by part. A run known to be in more texts than a tile holds is cut
    into tiles from the start, so that no task gets it whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(table.value, dtype=np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            rows, keys, often, texts = prefix_rows(batch.column(1).to_pylist(), ids, run, t, counts)
            if len(rows):
                at, key, side = in_tiles(keys, ids[rows], np.maximum(1, -(-often // tile)))
                yield from _packed(key, rows[at], side, texts, parts)

    return work


def _near(words: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which pairs may be alike by size and by the bits in which their sketches differ."""
    few = np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[few], j[few]
    apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
    few[few] = apart <= (1 - t) / (1 + t) * (n[i] + n[j]) + 1e-9
    return few


def tiled_pairs(words: np.ndarray, n: np.ndarray, side: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket, of different sides where there are two, by tiles in the order of their bit counts.

    A pair of tiles is skipped if no bit counts in them lie within the greatest radius of their sizes.
    """
    pop = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    two = bool(side.any()) and not bool(side.all())
    out_i, out_j = [], []
    cuts = [order[lo : lo + SUBTILE] for lo in range(0, len(order), SUBTILE)]
    for x, a in enumerate(cuts):
        for y in range(x, len(cuts)):
            b = cuts[y]
            if pop[b[0]] - pop[a[-1]] > (1 - t) / (1 + t) * (n[a].max() + n[b].max()):
                continue
            i, j = (g.ravel() for g in np.meshgrid(a, b, indexing="ij"))
            keep = np.ones(len(i), dtype=bool)
            if x == y:
                p, q = np.triu_indices(len(a), 1)
                i, j, keep = a[p], b[q], np.ones(len(p), dtype=bool)
            if two:
                keep = side[i] != side[j]
            i, j = i[keep], j[keep]
            near = _near(words, n, i, j, t)
            out_i.append(i[near])
            out_j.append(j[near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def bucket_pairs(key: np.ndarray, side: np.ndarray, texts: np.ndarray, t: float, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate pairs of ids in whole buckets, rows of buckets with over ``limit`` rows, which are not compared). A bucket
    is a run of equal keys; rows of sides 1 and 2 are compared with each other only."""
    ids, n, words = texts["id"], texts["n"].astype(np.int64), texts["bits"]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(starts, len(key)))
    group = np.repeat(np.arange(len(starts)), size)
    left, right = [], []
    small = size[group] <= SMALL
    for d in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & ((side[:-d] == 0) | (side[:-d] != side[d:])))
        near = _near(words, n, i, i + d, t)
        left.append(i[near])
        right.append(i[near] + d)
    for g in np.flatnonzero((size > SMALL) & (size <= limit)):
        s = np.arange(starts[g], starts[g] + size[g])
        if side[s[0]] and (side[s] == side[s[0]]).all():
            continue
        i, j = tiled_pairs(words[s], n[s], (side[s] == 2).astype(np.int32), t)
        left.append(s[i])
        right.append(s[j])
    none = np.zeros(0, dtype=np.int64)
    i, j = np.concatenate([none, *left]), np.concatenate([none, *right])
    both = np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)
    both = both[both[:, 0] != both[:, 1]]
    return np.unique(both, axis=0), np.flatnonzero(size[group] > limit)


def _compare(t: float, tile: int, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs (a, b) of each part of a partition sorted by part. With ``cut``, the rows of buckets that turn out to be
    larger than two tiles are packed anew, in tiles; these are small enough to be compared whole."""
    names = ["a", "b", "part", "rows", "texts"]

    def done(rows: list[bytes], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        tables = [_from_columns(x, _TEXT) for x in texts]
        first = np.cumsum([0, *map(len, tables)])
        found = [_from_columns(x, _ROW) for x in rows]
        key, side = (np.concatenate([x[f] for x in found]) for f in ("key", "side"))
        text = np.concatenate([x["text"] + np.uint32(lo) for x, lo in zip(found, first, strict=False)])
        order = np.argsort(key, kind="stable")
        key, side = key[order], side[order]
        # a bucket with one row has nothing to compare
        same = key[1:] == key[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, side, held = key[keep], side[keep], np.concatenate(tables)[text[order][keep]]
        if not len(key):
            return
        pairs, over = bucket_pairs(key, side, held, t, 2 * tile if cut else len(key))
        m = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
        for lo in range(0, len(over), PART_ROWS):
            yield from cut_up(key, side, held, over[lo : lo + PART_ROWS])

    def cut_up(key: np.ndarray, side: np.ndarray, held: np.ndarray, over: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, size = np.unique(key, return_counts=True)
        tiles = -(-size[np.searchsorted(starts, key[over])] // tile)
        # the two tiles of a pair that was cut before stay apart: their parts meet in all combinations of one with the other
        at, new, sides = in_tiles(key[over], held["id"][over], tiles)
        was = side[over][at]
        crossed = was > 0
        if crossed.any():
            mine = (_mixed(held["id"][over].astype(np.uint64)) % tiles.astype(np.uint64)).astype(np.int64)[at]
            other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            one, two = np.where(was == 1, mine, other), np.where(was == 1, other, mine)
            new = np.where(crossed, _tile_key(key[over][at], one, two), new)
            sides = np.where(crossed, was, sides).astype(np.uint8)
        for packed in _packed(new, over[at], sides, held, MOST_PARTS):
            m = packed.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *packed.columns], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, texts = None, [], []
        for batch in batches:
            for part, r, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now and rows:
                    yield from done(rows, texts)
                    rows, texts = [], []
                now = part
                rows.append(r)
                texts.append(x)
        if rows:
            yield from done(rows, texts)

    return work


def _verify(run: int, t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            rows, hashes = run_sets(batch.column(2).to_pylist() + batch.column(3).to_pylist(), run)
            n = np.bincount(rows, minlength=2 * m)
            pair = rows % m
            order = np.lexsort((hashes, pair))
            pair, hashes = pair[order], hashes[order]
            both = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
            common = np.bincount(pair[1:][both], minlength=m)
            similarity = common / np.maximum(n[:m] + n[m:] - common, 1)
            keep = pa.array(np.flatnonzero(similarity >= t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(similarity).take(keep)], names=["a", "b", "similarity"])

    return work


def _few(ids: DataFrame) -> bool:
    return ids.limit(MOST_IDS + 1).count() <= MOST_IDS


def uneven_join(left: DataFrame, right: DataFrame, key: str, by: Column, weights: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where a key may have any share of the rows of ``left``.

    A key with over a thousandth of them is hot; under a thousand are, so they can be broadcast. A hot key's rows are spread
    by ``by``, a column of ``left``, and the rows that ``right`` has for it are repeated for each of the ``SALTS`` parts.
    ``weights`` gives (key, n_), the rows of ``left`` by key, if that is cheaper than to count them.
    """
    weights = left.groupBy(key).agg(F.count("*").alias("n_")) if weights is None else weights
    most = max((weights.agg(F.sum("n_")).first()[0] or 0) // 1000, HOT)
    hot = written(weights.where(F.col("n_") > most).select(key, F.lit(True).alias("hot_")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key)
    one = left.join(F.broadcast(hot), key, "left").withColumn("salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_")
    every = F.explode(F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    two = right.join(F.broadcast(hot), key, "left").withColumn("salt_", every).drop("hot_")
    return one.join(two, [key, "salt_"]).drop("salt_")


def classes_of(sets: DataFrame) -> DataFrame:
    """(id, class_id) of (id, set_a, set_b): texts with the same set of runs; the least id names the class."""
    classes = sets.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    most = max(1, sets.count() // 1000)
    hot = classes.where(F.col("size") > most).drop("size")  # fewer than 1000 rows, so they can be broadcast
    by_hot = sets.join(F.broadcast(hot), ["set_a", "set_b"])
    by_rest = sets.join(F.broadcast(hot), ["set_a", "set_b"], "left_anti").join(classes.where(F.col("size") <= most), ["set_a", "set_b"])
    return by_hot.select("id", "class_id").unionByName(by_rest.select("id", "class_id")).distinct()


def alike(rows: DataFrame, key: str = "line_no", text: str = "text", run: int = RUN, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables: members (id, class_id) and links (a, b, similarity) between the classes.

    A class holds the texts with the same set of runs and is named by its least id; its texts are alike. Links join the
    classes whose similarity is at least ``similarity``, a < b, and none is left out. Texts with fewer than ``run`` terms,
    null and empty ones too, have no runs and are in no class. Rows with a null id are left out; an id given twice counts
    once for each different text. Empty table: two empty tables. Other columns are dropped.

    A text has as many bucket rows as its prefix has runs, at any size of the collection. They are shuffled once, by bucket,
    in parts of about ``PART_ROWS`` rows. A bucket with more than a tile of texts is cut into tiles and its rows repeated for
    each pair of tiles that theirs is in: at once if its run is known to be frequent, else when its size is seen.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null")
    survey = written(source.mapInArrow(_survey(run, BLOCK, REPORTED), "id bigint, n int, set_a bigint, set_b bigint, run bigint, times bigint"), "survey")

    sets = survey.where("n > 0").select("id", "set_a", "set_b")
    members = written(classes_of(sets), "members")
    table = frequency_table(survey.where("run is not null").select("run", "times"), SLOTS, FREQUENT)
    counts = spark.sparkContext.broadcast(table.tobytes())

    prefix = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    wanted = survey.where("n > 0").agg(F.sum(prefix)).first()[0] or 0
    parts = int(min(MOST_PARTS, max(spark.sparkContext.defaultParallelism, wanted // PART_ROWS)))
    copies = members.where("id <> class_id").select("id")
    heads = source.join(F.broadcast(copies), "id", "left_anti") if _few(copies) else source.join(members.where("id = class_id").select("id"), "id", "left_semi")
    found = "a bigint, b bigint, " + _PACKED
    packed = heads.mapInArrow(_emit(run, similarity, counts, parts, TILE), _PACKED)
    first = written(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_compare(similarity, TILE, True), found), "near")
    near = first.where("a is not null").select("a", "b")
    if over := first.where("part is not null").select(F.count("*"), F.sum(F.length("rows"))).first()[1]:
        more = int(min(MOST_PARTS, max(parts, over // _ROW.itemsize // PART_ROWS)))
        again = first.where("part is not null").select("part", "rows", "texts").repartition(more, "part").sortWithinPartitions("part")
        near = near.unionByName(again.mapInArrow(_compare(similarity, TILE, False), found).select("a", "b"))
    near = written(near.distinct(), "candidates")
    asked = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = source.join(F.broadcast(asked), "id", "left_semi") if _few(asked) else source.join(asked, "id", "left_semi")
    texts = lambda name: some.select(F.col("id").alias(name), F.col("text").alias(f"text_{name}"))
    in_b = near.groupBy("b").agg(F.count("*").alias("n_"))
    links = uneven_join(uneven_join(near, texts("a"), "a", F.col("b")), texts("b"), "b", F.col("a"), in_b).select("a", "b", "text_a", "text_b")
    links = links.mapInArrow(_verify(run, similarity), "a bigint, b bigint, similarity double")
    return members, written(links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")


def alike_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(line_a, line_b) of every pair of texts that are alike, copies too, line_a < line_b.

    The result grows with the square of a class; its rows are made in parts, whatever the class's share.
    """
    one = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    within = uneven_join(one, two.withColumnRenamed("b", "a"), "a", F.col("x")).where("x < y").select("x", "y")
    sizes = one.groupBy("a").agg(F.count("*").alias("size"))
    pairs = links.select("a", "b")
    in_b = uneven_join(pairs, sizes, "a", F.col("b")).groupBy("b").agg(F.sum("size").alias("n_"))
    across = uneven_join(uneven_join(pairs, one, "a", F.col("b")), two, "b", F.col("x"), in_b).select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b"))


def components(links: DataFrame) -> DataFrame:
    """(node, group_id) of each node of ``links`` (a, b): the least node that it is joined to, however far.

    Each round joins every node's greater neighbours, then its lesser ones, to the least node around it; the number of
    rounds grows with the logarithm of the longest path. Each round's links are written, so no lineage builds up.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = uneven_join(both.where("v > u"), least, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = uneven_join(large, low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group_id")).distinct())


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(line_no, class_id, group_id, links): one row per text that has runs; ``links`` counts its class's links."""
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    named = degree.join(components(links).withColumnRenamed("node", "class_id"), "class_id", "left")
    joined = members.join(named, "class_id", "left")
    return joined.select(F.col("id").alias("line_no"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
