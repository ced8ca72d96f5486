"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is that of its distinct 5-word shingles. Documents with equal sets are one class;
everything below works on classes. Each class has ``COORDINATES`` minwise values. A tree starts with all
classes in one node; at a node each class chooses ``BRANCHES`` of its minwise tokens, by a hash of the
node, and goes to one child for each. Nodes of ``SMALL`` classes at most are compared exhaustively. A
pair that agrees in a share p of its tokens stays together somewhere in a tree with the probability that
q = 1 - (1 - p q)^2 gives for the depth. All trees choose from the same tokens, so they are independent
only given p: ``missed`` sums over the binomial number of agreeing tokens, at the greatest depth, and adds
what the estimates prune; ``trees_for`` takes as many trees as miss a share of 1 - recall at most.

Two passes over the nodes find the links:

* The first takes the nodes of the first tree, and of each larger node only its pivot, the least class,
  against all others. It connects nearly all of what belongs together.
* The second takes every other node, of every tree, that still holds two components. It compares classes of
  different components only, and branches a node while the classes outside its largest component are
  too many to be compared with all of it.

A comparison of minwise values yields groups of classes that may be similar, never pairs. A group's full
sets then meet in one task, which keeps a spanning forest of the links that hold for them. A pair
that agrees on an earlier small node is compared there and nowhere else.

Defined results
---------------
* Null or empty text, or one without words: no shingles, a component of its own. Fewer than five
  words: the whole sequence is the only shingle.
* Rows are linked by their texts, so repeated ids with different texts stay apart; the label is the
  smallest id of the component. A null id is never the label unless there is no other; ``kept`` then
  compares nulls as equal.
* Repeated rows are one class. ``one_of_each`` keeps a single row of each component: that with the least
  (id, text hash), and of rows that agree in both the one whose columns hash lowest.
* Texts of any length are taken whole; the minwise values of a long one are found in parts.
* Case is folded for A-Z. An empty table gives an empty table; other columns are not read, and
  ``one_of_each`` passes them on whatever their names.
* Shingles are told apart by 64-bit hashes, sets by 128-bit ones.

At scale
--------
Rows of a tree are a node number and a class digest. Sizes of nodes are counted with partial sums, and
joins on nodes are split by AQE. A task holds ``CAPACITY`` classes of a node at most: beyond that the first
pass deals the node out in parts, each with the pivot, and the second deals out the largest component,
branches the node by a shuffle, or, where levels run out, takes it by pairs of parts. A group of more than
``SHINGLES`` values is taken by pairs of its blocks. Full sets are made from the texts again, for members of a
group only, and are shuffled once for each group. Components are found by distributed stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.packing import window_hashes, word_hashes
from textloom.plans.components import components
from textloom.plans.lineage import checked_broadcast, checkpointed

#: Production parameters: words of a shingle, percent of similarity, recall aimed at.
WIDTH, PERCENT, RECALL = 5, 75, 0.999999
#: Minwise values; children of a class at a node; levels before a node is compared in blocks.
COORDINATES, BRANCHES, LEVELS = 256, 2, 16
#: Classes of a node that is compared exhaustively; of a node that one task holds; shingles of a group.
SMALL, CAPACITY, SHINGLES = 2048, 32768, 1 << 20
#: A pair is confirmed unless its minwise estimate lies this many deviations below the threshold: first
#: over a few values, then over all of them.
FIRST, FIRST_MARGIN, MARGIN = 64, 6, 5
#: Coordinates of the first pass, the children of one root.
EARLY = BRANCHES
_RANDOM = np.random.Generator(np.random.PCG64(11))
_TIMES = _RANDOM.integers(0, 2**31, (COORDINATES, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, (COORDINATES, 1), np.uint32)


def binomial(n: int, s: float) -> list[float]:
    return [math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n + 1)]


def missed(trees: int, percent: int = PERCENT, levels: int | None = None) -> float:
    """The share of pairs at the threshold that no tree keeps together down to a depth, or that the
    estimates prune."""
    s = percent / 100
    total = sum(binomial(COORDINATES, s)[: least_agreeing(percent)]) + sum(binomial(FIRST, s)[: least_agreeing(percent, FIRST, FIRST_MARGIN)])
    for k, p in enumerate(binomial(COORDINATES, s)):
        stays = 1.0
        for _ in range(LEVELS if levels is None else levels):
            stays = 1 - (1 - k / COORDINATES * stays) ** BRANCHES
        total += p * (1 - stays) ** trees
    return total


def trees_for(recall: float = RECALL, percent: int = PERCENT) -> int:
    """Trees that find a pair at the threshold with probability ``recall`` at any depth."""
    trees = 1
    while trees * BRANCHES < 60 and missed(trees, percent) > 1 - recall:
        trees += 1
    return trees


def least_agreeing(percent: int = PERCENT, values: int = COORDINATES, margin: float = MARGIN) -> int:
    """Minwise values in which a pair at the threshold agrees, up to chance."""
    s = percent / 100
    return max(0, math.floor(values * s - margin * math.sqrt(values * s * (1 - s))))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    hashes = word_hashes((text or "").encode().lower().split())
    if 0 < len(hashes) < WIDTH:
        return window_hashes(hashes, len(hashes))
    h = np.sort(window_hashes(hashes, WIDTH))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def minwise(sets: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``COORDINATES`` random permutations."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (low[i : i + 512] * _TIMES + _PLUS).min(axis=1), out=out)
    return out


def digest_of(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def signatures(rows: DataFrame, first: int) -> DataFrame:
    """``(id, check, text)`` to ``(id, check, digest, n, tokens, sig)``: the ``first`` minwise values, for the
    roots, and 16 bits of all; with the digest, these are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, tokens, sigs = [], [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py())
                sizes.append(len(own))
                digests.append(digest_of(own))
                least = minwise(own) if len(own) else None
                tokens.append(None if least is None else least[:first].tobytes())
                sigs.append(None if least is None else least.astype(np.uint16).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "check", "digest", "n", "tokens", "sig"])

    return rows.mapInArrow(sign, "id long, check long, digest binary, n long, tokens binary, sig binary")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, one table after the other; rows of a key follow one another."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if rest and rest[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for i, j in zip(cuts, cuts[1:]):
            rest.append(batch.slice(i, j - i))
            if j < len(keys):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


class Node:
    """The classes of a node in one task, and what is similar among them by minwise values."""

    def __init__(self, table: pa.Table, percent: int):
        self.digests = table.column("digest").to_pylist()
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        self.high = np.frombuffer(b"".join(table.column("high").to_pylist()), np.uint16).reshape(len(self.sig), -1)
        self.n, self.mask = (table.column(c).to_numpy() for c in ("n", "mask"))
        self.label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)[1]
        self.key, self.at = table.column("node")[0].as_py(), table.column("at")[0].as_py()
        self.percent, self.least = percent, least_agreeing(percent)
        self.first = least_agreeing(percent, FIRST, FIRST_MARGIN)
        self.early = np.ascontiguousarray(self.sig[:, :FIRST])

    def similar(self, some: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components that may be similar, of ``some`` with ``every``."""
        xs, ys = [], []
        early, n, label = self.early[every], self.n[every], self.label[every]
        step = max(1, 65536 // max(1, len(every)))
        for i in range(0, len(some), step):
            own = some[i : i + step]
            fits = (label[None, :] != self.label[own, None]) & (100 * np.minimum(n[None, :], self.n[own, None]) >= self.percent * np.maximum(n[None, :], self.n[own, None]))
            x, y = np.nonzero(fits)
            for k in range(0, len(x), 16384):
                a, b = own[x[k : k + 16384]], y[k : k + 16384]
                stays = (self.early[a] == early[b]).sum(axis=1, dtype=np.int16) >= self.first
                a, b = a[stays], every[b[stays]]
                agree = self.sig[a] == self.sig[b]
                # Compared already where both agree on an earlier coordinate, in all its bits, whose node is small.
                same = agree[:, : self.at] & (self.high[a, : self.at] == self.high[b, : self.at])
                done = (same & ((self.mask[a, None] >> np.arange(self.at)) & 1).astype(bool)).any(axis=1)
                stays = (agree.sum(axis=1, dtype=np.int16) >= self.least) & ~done
                xs.append(a[stays])
                ys.append(b[stays])
        return (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))

    def star(self) -> Iterator[list[int]]:
        """The least class with all that may be similar to it."""
        pivot = np.array([min(range(len(self.digests)), key=self.digests.__getitem__)])
        yield from self.grouped(*self.similar(pivot, np.arange(len(self.digests))))

    def branched(self) -> Iterator[list[int]]:
        """Groups of the whole node, branched here while it is too large to be compared."""
        todo = [(np.arange(len(self.digests)), self.key, 0)]
        while todo:
            own, key, depth = todo.pop()
            counts = np.bincount(self.label[own])
            few = own[self.label[own] != counts.argmax()]
            if not len(few):
                continue
            if len(few) * len(own) <= SMALL * SMALL or depth == LEVELS:
                yield from self.grouped(*self.similar(few, own))
                continue
            for j in range(BRANCHES):
                tokens = self.sig[own, xxhash.xxh3_64_intdigest(f"{key} {j}") % COORDINATES]
                order = np.argsort(tokens, kind="stable")
                cuts = np.flatnonzero(np.diff(tokens[order])) + 1
                for part in np.split(order, cuts):
                    if len(part) > 1:
                        todo.append((own[part], xxhash.xxh3_64_intdigest(f"{key} {j} {tokens[part[0]]}"), depth + 1))

    def grouped(self, x: np.ndarray, y: np.ndarray) -> Iterator[list[int]]:
        """The connected parts of a graph of pairs; large ones by pairs of blocks."""
        used = np.unique(np.concatenate((x, y)))
        if not len(used):
            return
        a, b = np.searchsorted(used, x), np.searchsorted(used, y)
        part = np.arange(len(used))
        while True:
            least = np.minimum(part[a], part[b])
            now = part.copy()
            np.minimum.at(now, part[a], least)
            np.minimum.at(now, part[b], least)
            now = now[now]
            if (now == part).all():
                break
            part = now
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if self.n[used[own]].sum() <= SHINGLES:
                yield used[own].tolist()
                continue
            size = self.n[used]
            block = np.zeros(len(used), np.int64)
            block[own] = np.cumsum(size[own]) // (SHINGLES // 2)
            inside = part[a] == part[own[0]]
            i, j = np.minimum(block[a], block[b])[inside], np.maximum(block[a], block[b])[inside]
            for p in np.unique(np.stack((i, j)), axis=1).T:
                both = (i == p[0]) & (j == p[1])
                yield used[np.unique(np.concatenate((a[inside][both], b[inside][both])))].tolist()


def linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among full sets."""
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    values, names = np.unique(np.concatenate(sets), return_inverse=True)
    own, starts = np.zeros(len(values), bool), ends - size
    part = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    while True:
        # Of the parts but the largest, each set is held against all; what is in the largest is connected.
        todo = np.flatnonzero(~done & (part != np.bincount(part).argmax()))
        if not len(todo):
            return
        k = int(todo[0])
        done[k] = True
        mine = names[starts[k] : ends[k]]
        own[mine] = True
        both = np.add.reduceat(own[names], starts)
        own[mine] = False
        found = np.flatnonzero((100 * both >= percent * (size + size[k] - both)) & (part != part[k]))
        for p, at in zip(*np.unique(part[found], return_index=True)):
            yield k, int(found[at])
            part[part == p] = part[k]


class Join:
    """The state of one run: texts, classes, and the links confirmed so far."""

    def __init__(self, rows: DataFrame, recall: float, percent: int):
        self.rows, self.percent = rows, percent
        self.coordinates = trees_for(recall, percent) * BRANCHES
        self.signed = checkpointed(signatures(rows, self.coordinates))
        own = self.signed.where(F.col("digest").isNotNull()).groupBy("digest")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "check")).alias("first")
        self.classes = checkpointed(own.agg(first, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sig").alias("sig")))
        self.labels: DataFrame | None = None  # (digest, label) of linked classes

    def roots(self) -> DataFrame:
        """``(node, at, digest, size)`` of the nodes below the roots, those of one class left out. All trees
        choose different coordinates there, so that no chance is lost on the level that finds most pairs."""
        nodes = F.array(*(F.xxhash64(F.lit(i), F.substr("tokens", F.lit(4 * i + 1), F.lit(4))) for i in range(self.coordinates)))
        return checkpointed(self.sized(self.classes.select(F.posexplode(nodes).alias("at", "node"), "digest")))

    @staticmethod
    def sized(nodes: DataFrame) -> DataFrame:
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        return nodes.join(sizes, "node")

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with the label of each digest's component; alone, its own digest."""
        if self.labels is None:
            return nodes.withColumn("label", F.col("digest"))
        named = nodes.join(self.labels, "digest", "left")
        return named.withColumn("label", F.coalesce("label", "digest"))

    def open(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with labels, where a node has two or more; with the number of classes outside the
        label that has the most in ``few``."""
        named = self.labelled(nodes)
        counts = named.groupBy("node", "label").agg(F.count("*").alias("same"))
        most = counts.groupBy("node").agg(F.max(F.struct("same", "label")).alias("most"), F.sum("same").alias("all")).where(F.col("most.same") < F.col("all"))
        return named.join(most.select("node", F.col("most.label").alias("main"), (F.col("all") - F.col("most.same")).alias("few")), "node")

    def first_nodes(self, nodes: DataFrame) -> DataFrame:
        """Of the first tree's nodes, and parts of those beyond a task, each with the pivot."""
        named = self.labelled(nodes.where(F.col("at") < EARLY))
        size, large = F.col("size"), F.col("size") > CAPACITY
        part = F.when(large, F.xxhash64("node", F.pmod(F.xxhash64("digest"), F.ceil(size / F.lit(CAPACITY // 2))))).otherwise(F.col("node"))
        pivots = named.where(large).groupBy("node", "at", "size").agg(F.min("digest").alias("digest"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(size / F.lit(CAPACITY // 2)).cast("long") - 1)).alias("part")
        pivots = pivots.select("node", "at", "digest", "size", every).withColumn("label", F.col("digest"))
        dealt = named.select(part.alias("node"), "at", "digest", "label", "size")
        return dealt.union(pivots.select(F.xxhash64("node", "part"), "at", "digest", "label", "size"))

    def later_nodes(self, nodes: DataFrame) -> DataFrame:
        """The nodes with two components or more that the first pass has not compared whole, branched until a
        task can hold each."""
        compared = (F.col("at") < EARLY) & (F.col("size") <= SMALL)
        nodes = checkpointed(self.open(nodes.where(~compared)))
        fits = F.col("size") <= CAPACITY
        columns = ["node", "at", "digest", "label", "size"]
        out = nodes.where(fits).select(columns)
        large = nodes.where(~fits)
        for level in range(LEVELS):
            if large.isEmpty():
                break
            out = out.union(self.in_parts(large.where(F.col("few") <= CAPACITY // 2)))
            many = large.where(F.col("few") > CAPACITY // 2)
            if level == LEVELS - 1:
                return out.union(self.in_blocks(many))
            nodes = checkpointed(self.open(self.sized(self.children(many.select("node", "at", "digest").join(self.classes.select("digest", "sig"), "digest")))))
            out = out.union(nodes.where(fits).select(columns))
            large = nodes.where(~fits)
        return out

    @staticmethod
    def children(nodes: DataFrame) -> DataFrame:
        """``(node, at, digest, sig)`` to ``(node, at, digest)`` one level down; ``at`` is the root's."""

        def child(j: int) -> Column:
            at = F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES)).cast("int")
            return F.xxhash64("node", F.lit(j), at, F.substr("sig", 2 * at + 1, F.lit(2)))

        return nodes.select(F.explode(F.array(*map(child, range(BRANCHES)))).alias("node"), "at", "digest")

    @staticmethod
    def in_parts(nodes: DataFrame) -> DataFrame:
        """Nodes with few classes outside the main component: all of these, with a part of that."""
        parts = F.ceil((F.col("size") - F.col("few")) / F.lit(CAPACITY // 2)).cast("long")
        own = F.array(F.pmod(F.xxhash64("digest", F.lit(2)), parts))
        part = F.explode(F.when(F.col("label") == F.col("main"), own).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))).alias("part")
        dealt = nodes.select("node", "at", "digest", "label", "size", part)
        return dealt.select(F.xxhash64("node", F.lit(-1), "part").alias("node"), "at", "digest", "label", F.lit(0).cast("long").alias("size"))

    @staticmethod
    def in_blocks(nodes: DataFrame) -> DataFrame:
        """Nodes that stayed large, by pairs of their blocks."""
        count = F.ceil(4 * F.col("size") / F.lit(CAPACITY)).cast("long")
        block = F.pmod(F.xxhash64("digest", F.lit(1)), count)
        other = nodes.select("node", "at", "digest", "label", block.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("y"))
        return other.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "at", "digest", "label", F.lit(0).cast("long").alias("size"))

    def alike(self, nodes: DataFrame, masks: DataFrame, star: bool) -> DataFrame:
        """``(group, digest)``: classes that may be similar, from ``(node, at, digest, label, size)``. With
        ``star``, of large nodes only the pivot's group."""
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[tuple[int, bytes]] = set()
            for table in groups(batches, "node"):
                if table.num_rows < 2:
                    continue
                node = Node(table, percent)
                large = table.column("size")[0].as_py() > SMALL
                for group in node.star() if star and large else node.branched():
                    own = sorted({node.digests[i] for i in group})
                    name = xxhash.xxh3_64_intdigest(b"".join(own)) >> 1
                    found.update((name, x) for x in own)
                if len(found) >= 100_000:
                    yield packed(found)
                    found.clear()
            yield packed(found)

        def packed(found: set[tuple[int, bytes]]) -> pa.RecordBatch:
            a, b = zip(*sorted(found)) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["group", "digest"])

        full = nodes.join(masks, "digest").select("node", "at", "digest", "label", "size", "n", "mask", "high", "sig")
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = full.repartition(n, "node").sortWithinPartitions("node")
        return dealt.mapInArrow(compare, "group long, digest binary").distinct()

    def confirm(self, found: DataFrame) -> None:
        """The links that hold among the full sets of each group, and the components that they make."""
        percent = self.percent
        of = found.groupBy("digest").agg(F.collect_list("group").alias("groups"))
        own = self.classes.join(of, "digest").select(F.col("first.id").alias("want_id"), F.col("first.check").alias("want_check"), "groups")
        wanted = checked_broadcast(own)
        texts = self.rows.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("check") == F.col("want_check"))).select("text", "groups")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made: dict[bytes, tuple[list[int], bytes]] = {}
                for text, of in zip(batch.column(0), batch.column(1)):
                    own = shingles(text.as_py())
                    made[digest_of(own)] = (of.as_py(), own.tobytes())
                    if sum(len(of) * len(s) for of, s in made.values()) > 1 << 23:
                        yield sets_of(made)
                        made = {}
                yield sets_of(made)

        def sets_of(made: dict[bytes, tuple[list[int], bytes]]) -> pa.RecordBatch:
            rows = [(g, d, s) for d, (of, s) in made.items() for g in of]
            g, d, s = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.binary())], ["group", "digest", "shingles"])

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in groups(batches, "group"):
                sets = dict(zip(table.column("digest").to_pylist(), table.column("shingles").to_pylist()))
                names = list(sets)
                pairs = [(names[i], names[j]) for i, j in linked([np.frombuffer(x, np.uint64) for x in sets.values()], percent)]
                a, b = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sets = texts.mapInArrow(build, "group long, digest binary, shingles binary").repartition(n, "group").sortWithinPartitions("group")
        links = sets.mapInArrow(link, "a binary, b binary")
        links = links if self.labels is None else links.union(self.labels.toDF("a", "b"))
        self.labels = checkpointed(components(checkpointed(links)).toDF("digest", "label"))

    def run(self) -> DataFrame:
        """``(digest, component_id, first)`` of the classes in a component of several rows; ``first`` is the
        component's least row."""
        nodes = self.roots()
        small = F.bit_or(F.when(F.col("size") <= SMALL, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).otherwise(F.lit(0).cast("long")))
        high = F.concat(*(F.substr("tokens", F.lit(4 * i + 3), F.lit(2)) for i in range(self.coordinates)))
        masks = nodes.groupBy("digest").agg(small.alias("mask")).join(self.classes.select("digest", "n", high.alias("high"), "sig"), "digest")
        self.confirm(checkpointed(self.alike(self.first_nodes(nodes), masks, star=True)))
        self.confirm(checkpointed(self.alike(self.later_nodes(nodes), masks, star=False)))
        own = self.classes.select("digest", "first", "rows")
        named = own.join(self.labels, "digest", "left").where(F.col("label").isNotNull() | (F.col("rows") > 1)).withColumn("label", F.coalesce("label", "digest"))
        return named.join(named.groupBy("label").agg(F.min("first").alias("top")), "label").select("digest", "top")


def _joined(docs: DataFrame, id_col: str, text_col: str, recall: float, percent: int) -> tuple[Join, DataFrame, list[Column]]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("check")]
    join = Join(docs.select(*own, text.alias("text")), recall, percent)
    return join, checked_broadcast(join.run()), own


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, percent: int = PERCENT) -> DataFrame:
    """Each document's id, ``n_shingles``, ``component_id`` and ``kept``."""
    join, found, _ = _joined(docs, id_col, text_col, recall, percent)
    out = join.signed.drop("sig").join(found, "digest", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("top.id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns of the input."""
    join, found, own = _joined(docs, id_col, text_col, recall, percent)
    top = (F.col("id").eqNullSafe(F.col("top.id"))) & (F.col("check") == F.col("top.check"))
    dropped = join.signed.drop("sig").join(found, "digest").where(~top).select(F.col("id").alias("key_id"), F.col("check").alias("key_check")).distinct()
    again = join.signed.where(F.col("digest").isNotNull()).groupBy(F.col("id").alias("key_id"), F.col("check").alias("key_check")).count().where(F.col("count") > 1).drop("count")
    again = checkpointed(again)
    whole = docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("check") == F.col("key_check"))
    kept = whole.join(checked_broadcast(dropped), same, "left_anti")
    if not again.isEmpty():
        # Rows that agree in id and text: the least of them, found by a grouped minimum.
        repeated = kept.join(checked_broadcast(again), same, "left_semi").groupBy("id", "check")
        one = repeated.agg(F.min_by("whole", F.xxhash64("whole")).alias("whole"))
        kept = kept.join(checked_broadcast(again), same, "left_anti").select("whole").union(one.select("whole"))
    return kept.select("whole.*")
