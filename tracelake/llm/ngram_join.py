"""N-gram Jaccard join: count-vector R-trees find which documents share most of their 5-word shingles.

A document is the set of its hashed shingles. Equal sets are one node. Two sets of Jaccard
similarity J or more share one of their first keys in any common order of all shingles, so nodes
meet by key; frequent shingles go last in that order, which keeps passages that many documents
share out of the keys. Nodes that meet are points: shingles are hashed into groups and the counts
of the groups are the coordinates. The summed minima of two points' coordinates bound their overlap
from above. An R-tree over the points of a key finds the pairs whose bound reaches what J needs.
Connected candidates are then compared by their true sets, again through an R-tree: every pair whose
bound suffices is verified once. Where only components are asked for (near_duplicates), a pair that
links already connect is not. A group of many nodes is cut into blocks; each is written once to the
shared folder, and a task compares two blocks by mapping them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import hashed_words, materialize, mix, shared_dir, slices, small_batches, tidied
from tracelake.llm.components import components
from tracelake.llm.packed import ROWS, Shards, batches_of, dealt, by_shard, find, mapped, pack, put, ranges, runs, shard_bits, unpack

WIDTH = 5
#: Similarity in hundredths.
LEAST = 75
#: Shingles that more nodes hold than this go last in the order of keys. Any limit gives the same links.
FREQUENT = 32
#: Mean shingles in a coordinate; at most so many coordinates.
PER_GROUP = 6
MOST_GROUPS = 4096
#: Points of a leaf, and children of an inner node.
LEAF = 64
#: Nodes of a key or of a cluster that a task compares at once, and their shingles; larger ones are dealt by pairs of blocks.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
PART_BYTES = 4 << 20


# --- sets and points -----------------------------------------------------------


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct hashed shingles, sorted. Under WIDTH words the whole sequence is one; without words there is none."""
    h, first = hashed_words(texts)
    n = max(len(h) - WIDTH + 1, 0)
    g = h[:n].copy()
    for k in range(1, WIDTH):
        g = mix(g) + h[k : k + n]
    g = mix(g)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(g[a : b - WIDTH + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mix(short) + h[k]
            out.append(mix(short ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(h[:0])
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit value for each non-empty set, equal for equal sets."""
    if not sets:
        return np.zeros(0, np.uint64)
    every, n = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.cumsum(n) - n
    one, two = (np.add.reduceat(mix(every ^ np.uint64(k)), at) for k in (0, 0xA5A5A5A5A5A5A5A5))
    return mix((one ^ two << np.uint64(1)) + n.astype(np.uint64))


def n_keys(n: np.ndarray | int):
    """How many keys a set of n must be found by: all but one of those that a partner may lack, and one."""
    return n - (LEAST * n + 99) // 100 + 1


def needed(a: np.ndarray | int, b: np.ndarray | int):
    """The least overlap with which sets of sizes a and b link: 100 o >= LEAST (a + b - o)."""
    return -(-LEAST * (a + b) // (100 + LEAST))


def n_groups(n: int) -> int:
    return min(MOST_GROUPS, 1 << max(3, (n // PER_GROUP).bit_length()))


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by the first bits of their hashes, in the smallest type that holds the largest: no count is cut."""
    bits = n_groups(len(s)).bit_length() - 1
    counts = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    most = int(counts.max())
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def as_point(data: bytes | np.ndarray, n: int) -> np.ndarray:
    """A point from its bytes; their number tells the type."""
    return np.frombuffer(data, f"<u{len(data) // n_groups(n)}")


def as_points(data: np.ndarray, n: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """Points from their bytes in a row; wide has the bytes of a count of each."""
    ends = np.cumsum([n_groups(k) * w for k, w in zip(n.tolist(), wide.tolist())])
    return [as_point(p, k) for p, k in zip(np.split(data, ends[:-1]), n.tolist())]


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer coordinates: neighbours by first bits go together."""
    return p.reshape(groups, -1).sum(axis=1, dtype=np.int32) if len(p) > groups else p.astype(np.int32)


class RTree:
    """A packed R-tree over points in order of size. A node keeps its points' greatest coordinates and least size, so its bound for a query is never below those of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes, self.levels = points, sizes, []
        top, least = points, sizes
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((top, least))

    def search(self, q: np.ndarray, size: int, upto: int) -> np.ndarray:
        """Places before `upto` whose bound with q reaches the overlap needed."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else upto)
        for k in reversed(range(len(self.levels))):
            top, least = self.levels[k]
            at = at[np.minimum(top[at], q).sum(axis=1) >= needed(size, least[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[k - 1][0] if k else self.points)]
        at = at[at < upto]
        at = at[self.sizes[at] * 100 >= LEAST * size]
        return at[np.minimum(self.points[at], q).sum(axis=1) >= needed(size, self.sizes[at])]


def _candidates(points: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of nodes in order of size, each with those before it whose bound suffices, if any."""
    # Partners have nearly as many shingles: nodes whose points have as many coordinates share a tree, folded to the fewest of a partner.
    dims = np.array([len(p) for p in points])
    trees: dict[int, tuple[int, RTree]] = {}
    for d in np.unique(dims):
        mine = np.flatnonzero(dims == d)
        trees[int(d)] = (int(mine[0]), RTree(np.stack([points[i] for i in mine]).astype(np.int32), sizes[mine]))
    for x in range(1, len(points)):
        size, found = int(sizes[x]), []
        for d, (start, tree) in trees.items():
            if start >= x or d > dims[x] or int(tree.sizes[-1]) * 100 < LEAST * size:
                continue
            found.append(start + tree.search(folded(points[x], d), size, min(x - start, len(tree.sizes))))
        near = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(near):
            yield x, near


def _widths(points: list[np.ndarray]) -> np.ndarray:
    return np.array([p.itemsize for p in points], np.uint8)


class Block(NamedTuple):
    """Nodes in order of size: ids, sizes, how many documents each stands for, points and, where they are compared in full, sets."""

    node: np.ndarray
    n: np.ndarray
    copies: np.ndarray
    points: list[np.ndarray]
    sets: list[np.ndarray] | None

    def packed(self) -> bytes:
        return pack(self.node, self.n, self.copies, np.concatenate(self.sets) if self.sets is not None else np.zeros(0, np.uint64), _widths(self.points), np.concatenate([p.view(np.uint8) for p in self.points]))


def unpacked(data: np.ndarray) -> Block:
    node, n, copies, sets, wide, points = unpack(data, "<i8", "<i8", "<i8", "<u8", "u1", "u1")
    return Block(node, n, copies, as_points(points, n, wide), np.split(sets, np.cumsum(n)[:-1]) if len(sets) else None)


def together(a: Block, b: Block | None) -> tuple[Block, np.ndarray]:
    """The nodes of one or two blocks in order of size, and which block each is of."""
    if b is None:
        return a, np.zeros(len(a.node), np.int8)
    side = np.repeat(np.array([0, 1], np.int8), [len(a.node), len(b.node)])
    node, n, copies = (np.concatenate(c) for c in zip(a[:3], b[:3]))
    order = np.lexsort((node, n))
    points, sets = [*a.points, *b.points], [*a.sets, *b.sets] if a.sets is not None else None
    return Block(node[order], n[order], copies[order], [points[k] for k in order], None if sets is None else [sets[k] for k in order]), side[order]


class Overlaps:
    """Overlaps of sets, by flags of the shingles that one of them holds."""

    def __init__(self, sets: list[np.ndarray]):
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.split(at.astype(np.int32), np.cumsum([len(s) for s in sets])[:-1])
        self.held = np.zeros(len(names), np.int8)

    def of(self, x: int, others: np.ndarray) -> np.ndarray:
        self.held[self.at[x]] = 1
        some = [self.at[y] for y in others.tolist()]
        starts = np.cumsum([0, *map(len, some[:-1])])
        shared = np.add.reduceat(self.held[np.concatenate(some)], starts, dtype=np.int32)
        self.held[self.at[x]] = 0
        return shared


def _meeting(block: Block, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Candidates of one block, or those of two blocks whose ends are in different ones."""
    crossing = side.any()
    for x, near in _candidates(block.points, block.n):
        near = near[side[near] != side[x]] if crossing else near
        if len(near):
            yield x, near


def forest(block: Block, side: np.ndarray, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest that connects what links connect (places of nodes), beyond what `group` connects already. Without sets, pairs whose bound suffices count as links."""
    group = np.arange(len(block.node)) if group is None else group
    out = []
    overlaps = Overlaps(block.sets) if block.sets is not None else None
    for x, near in _meeting(block, side):
        near = near[group[near] != group[x]]
        for first_only in (True, False):  # the first of every component, as one link is enough; then what is left
            if not len(near):
                break
            tried = near[np.unique(group[near], return_index=True)[1]] if first_only else near
            if overlaps is not None:
                shared = overlaps.of(x, tried)
                tried = tried[100 * shared >= LEAST * (block.n[x] + block.n[tried] - shared)]
            if len(tried):
                tried = tried[np.unique(group[tried], return_index=True)[1]]
                out += [(x, int(y)) for y in tried]
                joined = np.isin(group, group[tried])
                near = near[~joined[near]]
                group[joined] = group[x]
    return out


def links(block: Block, side: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many documents link to each node, every pair verified once, and a forest of these links."""
    group, count, out = np.arange(len(block.node)), np.zeros(len(block.node), np.int64), []
    overlaps = Overlaps(block.sets)
    for x, near in _meeting(block, side):
        shared = overlaps.of(x, near)
        near = near[100 * shared >= LEAST * (block.n[x] + block.n[near] - shared)]
        count[x] += block.copies[near].sum()
        count[near] += block.copies[x]  # no node is in near twice
        of, first = np.unique(group[near], return_index=True)
        new = of != group[x]
        if new.any():
            out += [(x, int(y)) for y in near[first[new]]]
            group[np.isin(group, of)] = group[x]
    return count, out


# --- tables ----------------------------------------------------------------------


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/shingles-{uuid.uuid4().hex}"


def _frequent(texts: DataFrame, bits: int, folder: str) -> frozenset[int]:
    """Writes the shingles that are counted more than FREQUENT times, a sorted array a shard, and gives the shards that have one. Tasks send on what at least two of their documents hold: what is missed costs time, never links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column("text").to_pylist())]))
                    at, n = runs((every,), np.ones(len(every), np.int64))
                    key, n = every[at][n > 1], n[n > 1]
                    for s, x in ranges(key, bits):
                        yield s, pack(key[x], n[x].astype("<u4")), []

        yield from batches_of(rows())

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for shard, parts, _ in by_shard(batches):
                got = [unpack(p, "<u8", "<u4") for p in parts]
                key, n = (np.concatenate([g[k] for g in got]) for k in (0, 1))
                order = np.argsort(key)
                at, n = runs((key[order],), n[order].astype(np.int64))
                put(folder, f"frequent-{shard}", pack(key[order][at][n > FREQUENT]))
                yield shard, b"", []

        yield from batches_of(rows())

    return frozenset(r["shard"] for r in dealt(texts.mapInArrow(tidied(count), ROWS), bits).mapInArrow(tidied(total), ROWS).select("shard").collect())


def _is_frequent(shards: Shards, bits: int, every: np.ndarray) -> np.ndarray:
    """Which shingles are frequent: sorted first, so that each shard is searched once."""
    out, order = np.zeros(len(every), bool), np.argsort(every)
    for shard, x in ranges(every[order], bits):
        if (found := shards[shard]) is not None:
            out[order[x]] = find(found[0], every[order[x]])[0]
    return out


_KEYED = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("point", pa.binary()), ("doc_id", pa.int64())])


def _long(a) -> list[int]:
    return np.asarray(a, np.uint64).view(np.int64).tolist()


def _block_key(group: int, block: np.ndarray) -> list[int]:
    """The keys of blocks of a group."""
    return _long(mix(block.astype(np.uint64) + np.uint64(1) ^ mix(np.array([group], np.int64).view(np.uint64))))


#: Kinds of packed parts and of rows: keys that nodes share, nodes, documents, blocks of large groups.
SHARED, NODE, DOCUMENT, BLOCKS = 0, 1, 2, 3


def _meetings(texts: DataFrame, bits: int, folder: str, frequent: frozenset[int]) -> DataFrame:
    """SHARED: node and key, the block of a set of nodes that share a key of texts; n is 1 if the set has several blocks. BLOCKS: node (the set), key (a block's number) and n (its blocks), of sets of several blocks. NODE: node, key (the least row key of its documents), n and point. DOCUMENT: node (null without words), key (its row key), n and doc_id."""
    block = BLOCK

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            often = Shards(folder, "frequent", frequent, "<u8")
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    yield from sent(often, part)

        def sent(shards: Shards, part: pa.RecordBatch):
            sets = shingle_sets(part.column("text").to_pylist())
            n = np.array([len(s) for s in sets], "<u4")
            row, ids = part.column("row_key").to_numpy().view("<u8"), part.column("doc_id")
            digest = np.zeros(len(sets), np.uint64)
            digest[n > 0] = digests([s for s in sets if len(s)])
            flags = (ids.is_null().to_numpy(zero_copy_only=False) + 2 * (n == 0)).astype(np.uint8)
            order = np.argsort(row)
            for s, x in ranges(row[order], bits):
                x = order[x]
                yield s, pack(row[x], digest[x], ids.fill_null(0).to_numpy()[x], n[x], flags[x]), [DOCUMENT]
            # Each distinct set once, with its least row key.
            order = np.lexsort((row.view(np.int64), digest))
            order = order[n[order] > 0]
            if not len(order):
                return
            at, _ = runs((digest[order],), np.ones(len(order), np.int64))
            order = order[at]
            node = digest[order]
            every = np.concatenate([sets[k] for k in order])
            often = np.split(_is_frequent(shards, bits, every), np.cumsum(n[order])[:-1])
            keys = [np.concatenate([sets[k][~o], sets[k][o]])[: n_keys(len(o))] for k, o in zip(order, often)]
            points = [point(sets[k]) for k in order]
            for s, x in ranges(node, bits):
                yield s, pack(node[x], row[order[x]], n[order[x]], _widths(points[x]), np.concatenate([p.view(np.uint8) for p in points[x]])), [NODE]
            key, of = np.concatenate(keys), np.repeat(node, [len(k) for k in keys])
            place = mix(key)
            by = np.argsort(place)
            for s, x in ranges(place[by], bits):
                yield s, pack(key[by[x]], of[by[x]]), [SHARED]

        yield from batches_of(rows())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, parts = None, ([], [], [])
            for batch in batches:
                for shard, part, kind in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                    if shard != now:
                        yield from met(*parts)
                        now, parts = shard, ([], [], [])
                    parts[kind[0]].append(part)
            yield from met(*parts)

        def met(shared: list[bytes], nodes: list[bytes], documents: list[bytes]):
            if shared:
                yield from _groups(*(np.concatenate(c) for c in zip(*(unpack(p, "<u8", "<u8") for p in shared))))
            for p in documents:
                row, node, ids, n, flags = unpack(p, "<u8", "<u8", "<i8", "<u4", "u1")
                for r, d, i, k, f in zip(_long(row), _long(node), ids.tolist(), n.tolist(), flags.tolist()):
                    yield DOCUMENT, None if f & 2 else d, r, k, b"", None if f & 1 else i
            if nodes:
                got = [unpack(p, "<u8", "<u8", "<u4", "u1", "u1") for p in nodes]
                points = [x for g in got for x in as_points(g[4], g[2], g[3])]
                node, row, n = (np.concatenate([g[k] for g in got]) for k in (0, 1, 2))
                order = np.lexsort((row.view(np.int64), node))
                at, _ = runs((node[order],), np.ones(len(order), np.int64))
                for k in order[at].tolist():
                    yield NODE, int(node[k].view(np.int64)), int(row[k].view(np.int64)), int(n[k]), points[k].tobytes(), None

        return batches_of(rows(), _KEYED, 4)

    def _groups(key: np.ndarray, node: np.ndarray):
        """Nodes of each key that several share. Keys that the same nodes share are one group, named by its nodes, so near copies meet once and not once a key."""
        order = np.lexsort((node, key))
        at, _ = runs((key[order], node[order]), np.ones(len(order), np.int64))
        key, node = key[order][at], node[order][at]
        at, m = runs((key,), np.ones(len(key), np.int64))
        name = mix(np.add.reduceat(mix(node), at) + m.astype(np.uint64))
        _, first = np.unique(name, return_index=True)
        first = first[m[first] > 1]
        for a, k, group in zip(at[first].tolist(), m[first].tolist(), _long(name[first])):
            own, many = _long(node[a : a + k]), k > block
            keys = _block_key(group, np.arange(k) // block) if many else [group] * k
            for v, g in zip(own, keys):
                yield SHARED, v, g, int(many), b"", None
            for x in range(-(-k // block) if many else 0):
                yield BLOCKS, group, x, -(-k // block), b"", None

    schema = "kind byte, node long, key long, n int, point binary, doc_id long"
    return materialize(dealt(texts.mapInArrow(tidied(send), ROWS), bits).mapInArrow(tidied(meet), schema), "join-meetings")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """The groups of a partition sorted by key, one at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        keys = batch.column(key).to_numpy()
        at = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(at, at[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                got = {name: part.column(name).to_pylist() for name in part.schema.names}
                if held and held[key][0] == got[key][0]:
                    for name in held:
                        held[name] += got[name]
                else:
                    if held:
                        yield held
                    held = got
    if held:
        yield held


#: What blocks give: edges of a forest (u, v), and numbers of links (u, n; v is null).
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])
_FOUND_DDL = "u long, v long, n long"


def _block(g: dict[str, list], with_sets: bool) -> Block:
    """A block's rows in order of size, a node once."""
    order, seen = [], set()
    for k in sorted(range(len(g["node"])), key=lambda k: (g["n"][k], g["node"][k])):
        if g["node"][k] not in seen:
            seen.add(g["node"][k])
            order.append(k)
    take = lambda name: np.array([g[name][k] for k in order], np.int64)
    points = [as_point(g["point"][k], g["n"][k]) for k in order]
    sets = [np.frombuffer(g["set"][k], "<u8") for k in order] if with_sets else None
    return Block(take("node"), take("n"), take("copies") if with_sets else np.ones(len(order), np.int64), points, sets)


class Known:
    """What a task has connected so far, so that groups of the same nodes cost no more than one. It starts anew when it is large."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def groups(self, node: np.ndarray) -> np.ndarray:
        if len(self.up) > 500_000:
            self.up.clear()
        return np.unique(np.array([self.root(x) for x in node.tolist()], np.int64), return_inverse=True)[1]

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _compared(met: Iterator[tuple[Block, Block | None]], counted: bool) -> Iterator[pa.RecordBatch]:
    """Edges, and where links are counted their numbers, of blocks by themselves or of pairs of blocks."""
    known, held, size = Known(), [], 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=columns[3]), pa.array(columns[2])], schema=_FOUND)

    for a, b in met:
        block, side = together(a, b)
        if counted:
            count, edges = links(block, side)
            some = np.flatnonzero(count)
            held.append((block.node[some], block.node[some], count[some], np.ones(len(some), bool)))
        else:
            group = known.groups(block.node)
            edges = forest(block, side, group) if group.any() else []  # all are one already
        u, v = (block.node[[e[k] for e in edges]] if edges else np.zeros(0, np.int64) for k in (0, 1))
        if not counted:
            for x, y in zip(u.tolist(), v.tolist()):
                known.join(x, y)
        held.append((u, v, np.zeros(len(u), np.int64), np.zeros(len(u), bool)))
        size += sum(len(h[0]) for h in held[-2:])
        if size > 500_000:
            yield flush()
            size = 0
    if held:
        yield flush()


def _met(blocks: DataFrame, pairs: DataFrame, bits: int, folder: str, name: str, with_sets: bool, counted: bool) -> DataFrame:
    """_FOUND of all blocks (rows by `key`; `many` if the group has others) and of all pairs of blocks (keys `a` and `b`).

    A block of a group that has others is also written to the shared folder, once, and tasks of
    pairs map the two that they compare: what is shuffled grows with the nodes, whatever a group's size.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for g in _grouped(batches, "key"):
                block = _block(g, with_sets)
                if g["many"][0]:
                    put(folder, f"{name}-{g['key'][0]}", block.packed())
                yield block, None

        return _compared(each(), counted)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            last, block = None, None
            for batch in batches:
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                    if a != last:
                        last, block = a, unpacked(mapped(folder, f"{name}-{a}"))
                    yield block, unpacked(mapped(folder, f"{name}-{b}"))

        return _compared(each(), counted)

    first = blocks.repartition(1 << bits, "key").sortWithinPartitions("key").mapInArrow(tidied(own), _FOUND_DDL)
    first = materialize(first, f"join-{name}")
    return first.union(pairs.repartition(1 << bits, "a", "b").sortWithinPartitions("a").mapInArrow(tidied(both), _FOUND_DDL))


def _write_members(members: DataFrame, bits: int, folder: str) -> frozenset[int]:
    """Sorted arrays row key -> node, cluster, blocks, copies for workers to look up; gives the shards that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("row_key", "node", "cluster", "blocks", "copies")]
            shards = batch.column("shard").to_numpy()
            for shard in np.unique(shards).tolist():
                rows.setdefault(shard, []).append([c[shards == shard] for c in columns])
        for shard, found in rows.items():
            columns = [np.concatenate(c) for c in zip(*found)]
            order = np.argsort(columns[0].view(np.uint64))
            put(folder, f"members-{shard}", pack(*(c[order] for c in columns)))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    top = F.shiftrightunsigned("row_key", 64 - bits).cast("int")
    kept = members.select(top.alias("shard"), "row_key", "node", "cluster", F.col("blocks").cast("long").alias("blocks"), "copies")
    return frozenset(r["shard"] for r in kept.repartition(1 << bits, "shard").mapInArrow(tidied(run), "shard int").collect())


def _block_of(cluster: np.uint64 | int, block: int) -> int:
    return _block_key(cluster, np.array([block]))[0]


def _sets(texts: DataFrame, bits: int, folder: str, written: frozenset[int]) -> DataFrame:
    """key (of its block), many, node, n, copies, point and set of every node in a cluster, once, from the text of its first document."""
    schema = pa.schema([("key", pa.int64()), ("many", pa.bool_()), ("node", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("point", pa.binary()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            members = Shards(folder, "members", written, *["<i8"] * 5)
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    keys = part.column("row_key").to_numpy().view(np.uint64)
                    order = np.argsort(keys)
                    hits = []
                    for shard, x in ranges(keys[order], bits):
                        if (found := members[shard]) is not None:
                            hit, at = find(found[0].view("<u8"), keys[order][x])
                            hits += zip(order[x][hit].tolist(), *(found[k][at].tolist() for k in (1, 2, 3, 4)))
                    texts = part.column("text")
                    for (_, node, cluster, blocks, copies), s in zip(hits, shingle_sets([texts[h[0]].as_py() for h in hits])):
                        yield _block_of(cluster, node % (1 << 64) % blocks), blocks > 1, node, len(s), copies, point(s).tobytes(), s.astype("<u8").tobytes()

        yield from batches_of(rows(), schema, 6)

    return texts.mapInArrow(tidied(run), "key long, many boolean, node long, n int, copies long, point binary, set binary")


def _all_pairs(blocks: DataFrame) -> DataFrame:
    """(group, block, blocks) -> the keys of every two blocks of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [[_block_of(g, x) for g, x in zip(batch.column("group").to_pylist(), batch.column(c).to_pylist())] for c in ("block", "other")]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    others = F.sequence(F.col("block") + 1, F.col("blocks") - 1)
    return blocks.filter("block + 1 < blocks").repartition("group", "block").select("group", "block", F.explode(others).alias("other")).mapInArrow(run, "a long, b long")


def _clustered(docs: DataFrame, doc_id: str, text: str, counted: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, row_key, n_shingles, node; node is null without words), how many documents have each node, and _FOUND of the clusters that candidates connect."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = picked.select("doc_id", F.xxhash64(F.col("doc_id"), "text").alias("row_key"), "text")
    bits, folder = shard_bits(docs.sparkSession), _folder(docs)
    met = _meetings(texts, bits, folder, _frequent(texts.select("text"), bits, folder))
    rows = met.filter(F.col("kind") == DOCUMENT).select("doc_id", F.col("key").alias("row_key"), F.col("n").cast("long").alias("n_shingles"), "node")
    nodes = met.filter(F.col("kind") == NODE).select("node", F.col("key").alias("row_key"), "n", "point")
    # Nodes that share a key meet as points.
    shared = met.filter(F.col("kind") == SHARED).select("node", "key", (F.col("n") > 0).alias("many"))
    blocks = met.filter(F.col("kind") == BLOCKS).select(F.col("node").alias("group"), F.col("key").cast("int").alias("block"), F.col("n").alias("blocks"))
    near = _met(shared.join(nodes.select("node", "n", "point"), "node"), _all_pairs(blocks), bits, folder, "points", False, False)
    # Nodes that candidates connect meet as sets. Blocks are bounded by their nodes and by their shingles.
    clusters = components(near.select("u", "v"))
    sized = clusters.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sized = sized.select("root", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    copies = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    members = nodes.select("node", "row_key").join(clusters, "node").join(sized, "root").join(copies, "node").withColumnRenamed("root", "cluster")
    sets = _sets(texts, bits, folder, _write_members(members, bits, folder))
    blocks = sized.filter("blocks > 1").select(F.col("root").alias("group"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 2)).alias("block"))
    return rows, copies, _met(sets, _all_pairs(blocks), bits, folder, "sets", True, counted)


def linked_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, row_key, n_shingles, node; node is null without words) and, of nodes that links connect, (node, root). Pairs that links connect already are not verified."""
    rows, _, found = _clustered(docs, doc_id, text, counted=False)
    return rows, components(found.select("u", "v"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The join, one row per row of docs: doc_id, n_shingles, component_id (the least id that links reach) and n_links (how many other rows are linked to it, those of equal sets among them).

    Every pair of different sets whose bound suffices is verified, but pairs are not written: a task
    sends each node's number of links in its blocks, and a forest of the links.

    A null or empty text has no shingles and no links; equal sets link; a null id takes part and is
    named only where it is alone; repeated rows get equal results; extra columns are left out; an
    empty table gives an empty one.
    """
    rows, copies, found = _clustered(docs, doc_id, text, counted=True)
    found = materialize(found, "join-links")
    linked = components(found.filter("v is not null").select("u", "v"))
    others = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    # Only nodes with several documents or links need a look-up. A node may have a third of all rows: such a join is left to the skew join of the adaptive plan, which splits by size, not by a fixed number.
    wordless = rows.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    worded = rows.filter("node is not null")
    firsts = worded.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = materialize(firsts.join(linked, "node", "left").filter("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first", "n"), "join-nodes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(others, "node", "left").join(least, "root").select("node", "component", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = worded.join(materialize(named, "join-named"), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return out.union(wordless)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of similar()."""
    return similar(docs, doc_id, text).drop("n_links")
