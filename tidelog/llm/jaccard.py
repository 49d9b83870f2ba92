"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups its links make.

A document is the set of its word shingles. Sets are put in one order for all
documents, from rare to frequent by a sketch of the whole corpus. If two sets are
similar enough, their prefixes of length n - ceil(t n) + l share at least l shingles
(n: size, t: least similarity). Each document takes its own l: the more candidates
its prefix is estimated to bring, the longer the prefix and the more shared shingles
a pair needs (the smaller l of both) before it is verified on the whole sets.

Equal sets are one node, so copies cost nothing. A pair all of whose shared prefix
shingles are in at most HOT nodes is counted and verified as above. A shingle in more
nodes would give pairs by the square of their number. Its nodes are a group instead:
they are dealt into parts of at most TILE nodes, and in each part all sets are compared
with each other and with one node of the group, the pivot. 1 - similarity is a metric,
so a node of the pivot's component can only link with a node outside of it if their
distances to the pivot differ by no more than 1 - t. The others go; what remains of the
group takes another pivot. When a round hardly removes anything, all pairs of what
remains are compared. So no link is lost, and a large group costs in proportion to its
size as long as pivots tell its families apart.

The texts are read four times (sketch, prefixes, longer prefixes of candidates, sets of likely ones), never moved.
Nodes are 64-bit digests of the sorted set, shingles 64-bit hashes: sets are told apart
and compared by them, so of 2^32 different sets about two share a node. Null or wordless
texts have an empty set and are linked with nothing. Rows with equal or null ids are
documents of their own; a component's id is the smallest id that isn't null. Ties by
frequency go by the shingle's hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, forget, give_back, make_room, map_batches, stored, utf8
from .words import SPACE_TABLE, hash_words, mix, rolling

WORDS, PERCENT = 4, 85
#: Cells of the frequency sketch (16 MB), cells in a row.
SKETCH, BLOCK = 1 << 22, 1 << 16
#: Least and most bits of the node filter; between them it has FILTER_LOAD bits a node. Most bits that a node sets.
FILTER, FILTER_LOAD, FILTER_MARKS = (1 << 16, 1 << 26), 8, 3
#: Largest l, and how many estimated candidates make the first step up.
LEVELS, STEP = 8, 8
#: Nodes of a prefix shingle up to which its pairs are counted; nodes and bytes of sets in a part of a group.
HOT, TILE, TILE_BYTES = 48, 512, 8 << 20
#: Most rounds of pivots, and the part of the nodes a round must remove if another one is to follow.
ROUNDS, GAIN = 8, 0.25
#: Part of the set by which the second, longer prefix of a candidate pair is lengthened.
LONGER = 8
#: Bytes of texts whose shingles are taken at once; nodes that a task remembers, so as to give the set of copies once.
PORTION, SEEN = 1 << 20, 1 << 17


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer than k words is one shingle; without words it is none."""
    words = hash_words(texts, SPACE_TABLE)
    grams = rolling(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else rolling(words.hashes[a:b], b - a) if b > a else grams[:0])
    return out


def node_of(shingles: np.ndarray) -> int | None:
    """A digest of the set; order doesn't matter, as sums of scrambled members don't."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) * np.uint64(len(shingles) * 2 + 1)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sets_in(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column, PORTION bytes of texts (one at least) at a time."""
    some, size = [], 0
    for text in utf8(column):
        some.append(text)
        size += len(text)
        if size >= PORTION:
            yield from shingle_sets(some, k)
            some, size = [], 0
    yield from shingle_sets(some, k) if some else ()


class Seen:
    """Whether a task meets a node for the first time, as far as it remembers."""

    def __init__(self):
        self.nodes: set[int] = set()

    def first(self, node: int | None) -> bool:
        if node is None or node in self.nodes:
            return False
        if len(self.nodes) >= SEEN:
            self.nodes.clear()
        self.nodes.add(node)
        return True


def packed(counts: np.ndarray) -> bytes:
    """Counts with their bytes sorted by their place in the number, which squeezes well."""
    return zlib.compress(counts.astype("<u8").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.tobytes(), "<u8")


def read_once(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Of rows (__id, __hash, __text): a stored table of __id, __hash, n_shingles, node (null for the empty set), and the sketch.

    The sketch is how many nodes have a shingle of each cell (copies count once a task); tasks sum it, SKETCH numbers reach the driver.
    """
    bounded_batches(rows.sparkSession)
    block = T.StructType.fromDDL("block int, counts binary")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]), *T.StructType.fromDDL("n_shingles long, node long").fields, *block.fields])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        make_room()
        total, seen, last = np.zeros(SKETCH, np.uint32), Seen(), None
        for batch in batches:
            sizes, nodes = [], []
            for s in sets_in(batch.column(2), k):
                sizes.append(len(s))
                nodes.append(node_of(s))
                if seen.first(nodes[-1]):
                    np.add.at(total, (s & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            last = batch
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, kinds[0]), pa.array(nodes, kinds[1]), pa.nulls(len(sizes), kinds[2]), pa.nulls(len(sizes), kinds[3])], schema.fieldNames())
        for b, x in enumerate(total.reshape(-1, BLOCK) if last is not None else ()):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, last.schema.types[0]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([b], kinds[2]), pa.array([packed(x)], kinds[3])], schema.fieldNames())
        del total
        give_back()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[b] = total[b] + unpack(c) if b in total else unpack(c)
        for b, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], kinds[2]), pa.array([packed(c)], kinds[3])], block.fieldNames())

    table = stored(rows.mapInArrow(run, schema), "nodes")
    counts = np.zeros(SKETCH, np.uint64)
    for r in table.where("block is not null").select("block", "counts").repartition(SKETCH // BLOCK, "block").mapInArrow(add, block).collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = unpack(r["counts"])
    documents = table.where("block is null").drop("block", "counts")
    counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
    give_back()
    return documents, counts


def prefix(shingles: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """The document's prefix, rare shingles first, and its l."""
    n = len(shingles)
    least = -(-percent * n // 100)
    own = counts[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((shingles, own))
    first = n - least + 1
    # What a cell holds beyond the usual load is taken for documents that share the shingle.
    cost = float(np.maximum(own[order[:first]] - usual - 1, 0).sum())
    level = min(1 + int(np.log2(1 + cost / STEP)), LEVELS, least)
    return shingles[order[: first - 1 + level]], level


def shared_prefixes(texts: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """token, node, meta, nodes, pivot: the prefix shingles of two nodes at least, with the number and the least of their nodes. meta packs place, l and size (see unpacked)."""
    usual = float(np.median(counts) + 2 * np.sqrt(np.median(counts)))
    bounded_batches(texts.sparkSession)
    schema = T.StructType.fromDDL("node long, size long, tokens array<long>")

    def run(batches):
        make_room()
        seen = Seen()
        for batch in batches:
            nodes, sizes, tokens = [], [], [np.zeros(0, np.uint64)]
            for s in sets_in(batch.column(0), k):
                if seen.first(node := node_of(s)):
                    some, level = prefix(s, counts, usual, percent)
                    nodes.append(node)
                    sizes.append(len(s) << 4 | level)
                    tokens.append(some)
            ends = pa.array(np.cumsum([len(x) for x in tokens]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens).view(np.int64)))], schema.fieldNames())
        give_back()

    nodes = stored(texts.mapInArrow(run, schema).dropDuplicates(["node"]), "prefixes")
    tokens = nodes.select("node", F.explode("tokens").alias("token"))
    # Stored, so that both sides of the join are dealt for it alone and a frequent token's rows can be split.
    several = stored(tokens.groupBy("token").agg(F.count("*").cast("int").alias("nodes"), F.min("node").alias("pivot")).where("nodes > 1"), "tokens")
    shared = stored(repeated_tokens(nodes, several).join(several, "token"), "shared")
    forget(nodes, several)
    return shared


def repeated_tokens(nodes: DataFrame, several: DataFrame) -> DataFrame:
    """token, node, meta of the tokens that pass the filter of `several`: most have one node only and needn't be moved."""
    repeated = node_filter(several.select(F.col("token").alias("node")))

    def run(batches):
        for batch in batches:
            tokens = batch.column(2)
            flat, sizes = tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
            kept = np.flatnonzero(repeated.passes(flat))
            meta = place[kept] << 32 | batch.column(1).to_numpy()[owner[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(flat[kept]), pa.array(batch.column(0).to_numpy()[owner[kept]]), pa.array(meta)], ["token", "node", "meta"])
        give_back()

    return nodes.select("node", "size", "tokens").mapInArrow(run, "token long, node long, meta long")


def unpacked(shared: DataFrame) -> DataFrame:
    return shared.selectExpr("token", "node", "shiftright(meta, 32) as place", "(meta & 4294967295) div 16 as n", "meta & 15 as l")


def could_link(a: str, b: str, percent: int) -> str:
    """SQL: sizes are near enough, and the two places of a shared shingle leave enough for the rest of the overlap."""
    most = f"{100 + percent} * (least({a}.place, {b}.place) + least({a}.n - {a}.place, {b}.n - {b}.place))"
    return f"{percent} * {a}.n <= 100 * {b}.n and {percent} * {b}.n <= 100 * {a}.n and {most} >= {percent} * ({a}.n + {b}.n)"


def cold_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that share l prefix shingles of at most HOT nodes each."""
    cold = unpacked(shared.where(f"nodes <= {HOT}"))
    pairs = cold.alias("p").join(cold.alias("x"), "token").where("p.node < x.node").where(could_link("p", "x", percent))
    return pairs.groupBy(F.col("p.node").alias("a"), F.col("x.node").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("p.l", "x.l")).alias("l")).where("c >= l").select("a", "b")


def hot_groups(shared: DataFrame) -> DataFrame:
    """group, node, n: the nodes of each hot shingle. Many have the same least node, which names their group."""
    hot = shared.where(f"nodes > {HOT}")
    return hot.groupBy(F.col("pivot").alias("group"), "node").agg(F.first("meta").alias("meta")).selectExpr("`group`", "node", "(meta & 4294967295) div 16 as n")


def parts_of(members: DataFrame, pivot: Column) -> DataFrame:
    """group, pivot, parts: how many parts the size of a group needs."""
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES)).cast("int")
    return members.groupBy("group").agg(pivot.alias("pivot"), parts.alias("parts"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Frequent shingles by matrix products, the others by their pairs; both in slices of bounded size."""
    m = len(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(every)]]))
    del every
    out = np.zeros((m, m), np.float32)
    frequent = np.flatnonzero(counts >= 32)
    for k in range(0, len(frequent), 2048):
        some = frequent[k : k + 2048]
        n = counts[some]
        column = np.repeat(np.arange(len(some)), n)
        row = owner[np.repeat(starts[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        held = np.zeros((m, len(some)), np.float32)
        held[row, column] = 1
        out += held @ held.T
    for n in range(2, 32):
        some = starts[counts == n]
        for k in range(0, len(some), max(1, (1 << 20) // (n * n))):
            rows = owner[some[k : k + max(1, (1 << 20) // (n * n)), None] + np.arange(n)]
            cells = (rows[:, :, None].astype(np.int64) * m + rows[:, None, :]).ravel()
            out += np.bincount(cells, minlength=m * m).reshape(m, m) if len(cells) > m * m >> 4 else added(cells, m)
    return out


def added(cells: np.ndarray, m: int) -> np.ndarray:
    cell, n = np.unique(cells, return_counts=True)
    out = np.zeros(m * m, np.float32)
    out[cell] = n
    return out.reshape(m, m)


def tile_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many shingles each two sets share, and links that join the tile's nodes as all of its links do: each node to the first of its component."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = overlaps(sets)
    linked = np.empty(shared.shape, bool)
    for k in range(0, len(sets), 128):
        common = shared[k : k + 128].astype(np.float64)
        linked[k : k + 128] = 100 * common >= percent * (sizes[k : k + 128, None] + sizes[None, :] - common)
    left, out = np.ones(len(nodes), bool), []
    for first in range(len(nodes)):
        if left[first]:
            seen = edge = np.arange(len(nodes)) == first
            while edge.any():
                edge = linked[edge].any(axis=0) & ~seen
                seen = seen | edge
            left &= ~seen
            out += [(nodes[first], nodes[k]) for k in np.flatnonzero(seen) if k != first]
    return shared, out


def compared(tiles: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """group, a, b, n, distance: for each tile (keys), what joins its components (a and b; distance -1), and each node's (a, b is a) size n and distance to the pivot.

    tiles: group, keys, node, pivot. The distances come only where the pivot is in the tile. No column has nulls: pandas would turn ids into floats.
    """

    def run(frame):
        nodes, sets = frame["node"].tolist(), [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        pivot = int(frame["pivot"].iloc[0])
        shared, links = tile_links(nodes, sets, percent)
        a, b, n, distance = [x for x, _ in links], [y for _, y in links], [0] * len(links), [-1.0] * len(links)
        if pivot in nodes:
            sizes, to = np.array([len(s) for s in sets]), nodes.index(pivot)
            common = shared[to].astype(np.float64)
            a, b, n, distance = a + nodes, b + nodes, n + sizes.tolist(), distance + (1 - common / (sizes + sizes[to] - common)).tolist()
        columns = {"a": np.array(a, np.int64), "b": np.array(b, np.int64), "n": np.array(n, np.int64), "distance": np.array(distance, np.float64)}
        give_back()
        return pd.DataFrame({"group": np.full(len(a), frame["group"].iloc[0], np.int64)} | columns)

    return tiles.join(sets, "node").groupBy(*keys).applyInPandas(run, "group long, a long, b long, n long, distance double")


def star_tiles(members: DataFrame, heads: DataFrame) -> DataFrame:
    """group, part, node, pivot: each part of a group with its pivot."""
    own = members.join(heads, "group").select("group", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "pivot").where("node <> pivot")
    return own.union(heads.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"), "pivot"))


def pair_tiles(members: DataFrame, heads: DataFrame) -> DataFrame:
    """group, i, j, node, pivot (0: none): tile (i, j) holds parts i and j of a group, so each two nodes meet."""
    dealt = members.join(heads, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return dealt.select("group", "node", F.explode(tiles).alias("t")).select("group", "t.i", "t.j", "node", F.lit(0).cast("long").alias("pivot"))


def remaining(stars: DataFrame, heads: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """group, node, n, other: of groups of several parts, the nodes outside the pivot's component (other) and those in it that could link with one of these."""
    near = 1 - percent / 100 + 1e-9
    own = lambda node: labels.select(F.col("node").alias(node), F.col("label").alias(f"__{node}"))
    large = heads.where("parts > 1").join(own("pivot"), "pivot", "left").select("group", F.coalesce("__pivot", "pivot").alias("main"))
    nodes = stars.where("distance >= 0").groupBy("group", F.col("a").alias("node")).agg(F.first("n").alias("n"), F.first("distance").alias("distance"))
    placed = stored(nodes.join(large, "group").join(own("node"), "node", "left").select("group", "node", "n", "distance", (F.coalesce("__node", "node") != F.col("main")).alias("other")), "placed")
    reach = stored(placed.where("other").groupBy("group").agg((F.min("distance") - near).alias("low"), (F.max("distance") + near).alias("high")), "reach")
    out = stored(placed.join(reach, "group").where("other or distance between low and high").select("group", "node", "n", "other"), "members")
    forget(placed, reach)
    return out


def hot_links(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> list[DataFrame]:
    """Stored tables of links (a, b) that, with `links`, join what the groups' links join. members: a stored table of group, node, n."""
    found, pivot = [], F.min("node")
    size = members.count()
    for k in range(ROUNDS + 1):
        if not size:
            forget(members)
            break
        heads = stored(parts_of(members, pivot), "heads")
        if k == ROUNDS or k and size > before * (1 - GAIN):
            found.append(stored(compared(pair_tiles(members, heads), only(sets, members), ["group", "i", "j"], percent).where("a <> b").select("a", "b"), "links"))
            forget(members, heads)
            break
        stars = stored(compared(star_tiles(members, heads), only(sets, members), ["group", "part"], percent), "stars")
        found.append(stored(stars.where("a <> b").select("a", "b"), "links"))
        forget(members)
        if heads.where("parts > 1").isEmpty():
            forget(heads, stars)
            break
        members = remaining(stars, heads, components(reduce(DataFrame.union, found, links)), percent)
        forget(heads, stars)
        before, size = size, members.count()
        pivot = F.min_by("node", F.when(F.col("other"), F.xxhash64("node", F.lit(k))))
    return found


class Filter:
    """What passes for a member of a set of 64-bit hashes: all that are, and few others.

    A hash's first bits name a word, others up to FILTER_MARKS bits of it (fewer if the words are full). None of them are the last
    ones, which name a cell of the sketch: prefixes are of rare cells, so a filter by those would have most of its bits where it is asked.
    """

    def __init__(self, size: int, n: int):
        self.words = np.zeros(size // 64, np.uint64)
        self.right = 64 - (size // 64).bit_length() + 1
        self.shifts = (38, 32, 26)[: min(max(size // max(2 * n, 1), 1), FILTER_MARKS)]

    def columns(self, of: str) -> tuple[str, str]:
        """SQL: the word and the bits of a column."""
        return f"cast(shiftrightunsigned({of}, {self.right}) as int)", " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({of}, {k}) & 63 as int))" for k in self.shifts)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        hashes, marks = hashes.view(np.uint64), np.zeros(len(hashes), np.uint64)
        for k in self.shifts:
            marks |= np.uint64(1) << (hashes >> np.uint64(k) & np.uint64(63))
        return self.words[(hashes >> np.uint64(self.right)).astype(np.int64)] & marks == marks


def node_filter(nodes: DataFrame) -> Filter:
    """The filter of a column `node`, FILTER_LOAD bits a node within the bounds of FILTER; beyond them it only lets more through."""
    n = nodes.count()
    out = Filter(min(max(1 << max(n * FILTER_LOAD - 1, 1).bit_length(), FILTER[0]), FILTER[1]), n)
    word, bits = out.columns("node")
    found = nodes.selectExpr(f"{word} as word", f"{bits} as bits").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER's bits
    out.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def sets_of(texts: DataFrame, k: int, nodes: DataFrame, part: Callable[[np.ndarray], tuple[np.ndarray, int]] | None = None) -> DataFrame:
    """node, l, shingles (sorted) of the texts whose nodes pass the filter of `nodes`; `part` takes a part of a set and its l, else sets are whole (l is 0). Stored."""
    wanted = node_filter(nodes)
    bounded_batches(texts.sparkSession)
    schema = T.StructType.fromDDL("node long, l int, shingles binary")

    def run(batches):
        make_room()
        seen = Seen()
        for batch in batches:
            ids, levels, sets = [], [], []
            for s in sets_in(batch.column(0), k):
                node = node_of(s)
                if node is not None and wanted.passes(np.array([node], np.int64))[0] and seen.first(node):
                    some, level = part(s) if part else (s, 0)
                    ids.append(node)
                    levels.append(level)
                    sets.append(np.sort(some).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32()), pa.array(sets, pa.binary())], schema.fieldNames())
        give_back()

    return stored(texts.mapInArrow(run, schema).dropDuplicates(["node"]), "sets")


def only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets that pass the filter of `nodes`, so that others aren't moved for a join with these."""
    wanted = node_filter(nodes)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.passes(batch.column(0).to_numpy())))

    return sets.mapInArrow(run, sets.schema)


def longer_prefix(shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A prefix lengthened by a part of the set, and its l."""
    n = len(shingles)
    least = -(-percent * n // 100)
    level = min(1 + n // LONGER, least)
    order = np.lexsort((shingles, counts[(shingles & np.uint64(SKETCH - 1)).astype(np.int64)]))
    return shingles[order[: n - least + level]], level


def tested(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs for which test(set, set, the smaller l) holds."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"__{x}"), F.col("l").alias(f"__l{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "__a", "__b", F.least("__la", "__lb").alias("__l"))

    def run(batch):
        rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))
        return [pa.array([test(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y, least in rows], pa.bool_())]

    return map_batches(both, "__passed boolean", run, ("__a", "__b", "__l")).where("__passed").select("a", "b")


def shared_by(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - len(np.union1d(x, y))


def similar(percent: int):
    """Exact, in integers."""

    def test(x: np.ndarray, y: np.ndarray, _: int) -> bool:
        common = shared_by(x, y)
        return 100 * common >= percent * (len(x) + len(y) - common)

    return test


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links lead to, for every node with a link. Large star and small star in turn, until nothing changes."""
    edges, last = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: id, hash (of its text), n_shingles, node, label (of its component; null as the node is), component_id (the smallest id that links lead to, its own included)."""
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    texts = rows.select("__text")
    documents, counts = read_once(rows, k)
    shared = shared_prefixes(texts, k, percent, counts)
    pairs, members = stored(cold_pairs(shared, percent), "pairs"), stored(hot_groups(shared), "members")
    forget(shared)
    ends = lambda p: p.select("a").union(p.select("b")).toDF("node")
    # Candidates by few shared shingles are tested on longer prefixes, which need as many more, before whole sets are moved.
    prefixes = sets_of(texts, k, ends(pairs), lambda s: longer_prefix(s, counts, percent))
    likely = stored(tested(pairs, prefixes, lambda x, y, level: shared_by(x, y) >= level), "pairs")
    forget(pairs, prefixes)
    sets = sets_of(texts, k, ends(likely).union(members.select("node")))
    links = stored(tested(likely, only(sets, ends(likely)), similar(percent)), "links")
    forget(likely)
    hot = hot_links(members, sets, links, percent)
    labels = components(reduce(DataFrame.union, hot, links))
    forget(sets, links, *hot)
    give_back()
    least = documents.where("node is not null").groupBy("node").agg(F.min("__id").alias("least"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = named.join(groups, "label").select("node", "label", "component_id")
    out = documents.join(placed, "node", "left")
    return out.select(F.col("__id").alias(id_col), F.col("__hash").alias("hash"), "n_shingles", "node", "label", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """df with one document of each group: that with the smallest id (ties: the least node, then the least hash of its text). Documents without words all stay.

    What goes is decided on ids and hashes. Of rows of a group that are equal in id and text, any one stays.
    """
    groups = similar_groups(df, id_col, text_col, k, percent).where("label is not null").select(F.col(id_col).alias("__id"), "hash", "node", "label")
    rows = groups.groupBy("__id", "hash", "node", "label").agg(F.count("*").alias("n"))
    rows = stored(rows, "rows")
    # By label: ids may be null or stand in several components.
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), "node", "hash")
    several = stored(rows.groupBy("label").agg(F.sum("n").alias("__n"), F.min(order).alias("keep")).where("__n > 1").select("label", "keep"), "several")
    mine = F.col("__id").eqNullSafe(F.col("keep.id")) & (F.col("node") == F.col("keep.node")) & (F.col("hash") == F.col("keep.hash"))
    judged = stored(rows.join(several, "label").select("__id", F.col("hash").alias("__hash"), mine.alias("stays"), "n").where("not stays or n > 1"), "judged")
    forget(rows, several)
    same = (F.xxhash64(text_col) == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id"))
    kept = df.join(judged.select("__id", "__hash"), same, "left_anti")
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return kept
    # A row that stays and is there several times.
    again = df.withColumn("__key", F.xxhash64(text_col)).join(repeated.select("__id", "__hash"), same, "left_semi").dropDuplicates([id_col, "__key"]).drop("__key")
    return kept.unionByName(again)
