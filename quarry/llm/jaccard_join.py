"""N-gram Jaccard join: exact components of documents whose 5-word shingle sets overlap.

Documents with equal sets form one class; classes are joined, copies are not.
Links come from signature trees over groups of classes, and whole texts verify
them.  A group holds the classes that share a *neighbour key*: two hashes that
are neighbours in the sorted order of a class's shingle hashes.  Every class is
posted under the neighbour keys of its first 0.4 n + 2 hashes, n being its size,
and that loses no link: of sets that link, at most 0.2 n - 0.8 b hashes of the
one are its own and b are the other's own.  As long as no two shared hashes are
neighbours in the merged order, an unshared one lies between any two shared
ones, so before the first such pair the one set has at most 2 (0.2 n - 0.8 b) + b
<= 0.4 n hashes.  Keys whose groups have the same members count once.

A tree's nodes hold the OR of token bitmaps, the range of sizes, the largest
number of tokens hidden by bitmap collisions and the component, if only one.  A
dual traversal drops node pairs of one component, of sizes out of range, or
whose largest possible overlap is too small.  In each of ``ROUNDS`` rounds every
class stays in one of its groups (the least by a hash that changes by round, so
classes with equal groups meet) and of the pairs its tree leaves every component
proposes one, to the member with most partners; proposals are verified and
linked components put together.  At last the trees of all groups that still hold
two components give all their pairs.

A group of more than ``BLOCK`` members is cut into blocks in the rounds.  At last
its members are posted anew, under the rarest 0.2 n + 1 of all their shingles (the
prefix filter, which loses no link either), so that a passage that many
documents share brings nobody together; groups still too large go by pairs of
blocks.  No round collects pairs or components on the driver.

Defined results: null, empty and wordless texts have no shingles and stand
alone; texts of one to four words have their whole sequence as one shingle;
rows that repeat an id or a text are rows of one class each; a null id never
names a component unless it has no other; extra columns are not read; an empty
table gives an empty result; very long texts are hashed in bounded spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.staging import free_shuffles, small_arrow_batches, staged
from quarry.llm.textkit import slices, string_buffers, whole_hash, window_hashes, word_hashes, word_spans

SHINGLE = 5
BITS = 2048
#: Smaller sets link with equal ones only: the union of two others has five shingles at least.
SMALLEST = 4
ROUNDS = 3
LEAF, FAN, BLOCK = 16, 8, 1024
NUMERATOR, DENOMINATOR = 80, 100


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    raw_all, bounds_all = string_buffers(column)
    for at, to in slices(bounds_all):
        raw, bounds = raw_all[bounds_all[at] : bounds_all[to]], bounds_all[at : to + 1] - bounds_all[at]
        starts, ends, first = word_spans(raw, bounds)
        words = word_hashes(raw, starts, ends, lower=True)
        windows = window_hashes(words, SHINGLE)
        for i in range(to - at):
            a, b = first[i], first[i + 1]
            if b - a >= SHINGLE:
                yield np.unique(windows[a : b - SHINGLE + 1])
            else:
                yield whole_hash(words[a:b]) if b > a else np.zeros(0, np.uint64)


def neighbour_keys(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the neighbouring pairs in the prefix that no link can do without."""
    return window_hashes(hashes[: 2 * len(hashes) // 5 + 2], 2).view(np.int64) if len(hashes) >= SMALLEST else np.zeros(0, np.int64)


def _bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(7)) % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rk, n, digest) of every row."""
    for batch in batches:
        n, digests = [], []
        for hashes in shingle_sets(batch.column(2)):
            n.append(len(hashes))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "rk", "n", "digest"])


def _listed(hashes_of: Callable[[np.ndarray], np.ndarray]):
    """(cid, key) for every hash that ``hashes_of`` makes of a class's sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, texts = batch.column(0).to_numpy(), batch.column(1)
            lists = [hashes_of(h) for h in shingle_sets(texts)]
            owner = np.repeat(cids, [len(x) for x in lists])
            keys = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            for at in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(owner[at : at + (1 << 18)]), pa.array(keys[at : at + (1 << 18)])], names=["cid", "key"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, bitmap, text) of classes."""
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        n, maps = pa.array([len(h) for h in sets], pa.int64()), pa.array([_bitmap(h) for h in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), n, maps, batch.column(1)], names=["cid", "n", "bitmap", "text"])


def _enough(overlap: np.ndarray | int, x: np.ndarray | int, y: np.ndarray | int):
    """Whether an overlap of sets of x and y elements reaches the threshold."""
    return DENOMINATOR * overlap >= NUMERATOR * (x + y - overlap)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose texts link."""
    for batch in batches:
        ids: dict[int, int] = {}
        texts: list[str] = []
        sides = []
        for k in (0, 1):
            own = []
            for cid, text in zip(batch.column(k).to_pylist(), batch.column(k + 2).to_pylist(), strict=True):
                if cid not in ids:
                    ids[cid] = len(texts)
                    texts.append(text)
                own.append(ids[cid])
            sides.append(own)
        sets = list(shingle_sets(pa.array(texts, pa.large_string())))
        linked = []
        for x, y in zip(*sides, strict=True):
            a, b = sets[x], sets[y]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            linked.append(bool(len(a)) and bool(_enough(int((b[at] == a).sum()), len(a), len(b))))
        chosen = batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))
        yield chosen.rename_columns(["a", "b"])


class SignatureTree:
    """Levels of nodes over members sorted by component and size; level 0 are the members."""

    def __init__(self, size: np.ndarray, bitmap: np.ndarray, comp: np.ndarray):
        self.order = np.lexsort((size, comp))
        size, bitmap, comp = size[self.order], bitmap[self.order], comp[self.order]
        hidden = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        self.levels = [(size, size, hidden, bitmap, comp)]
        self.fans = []
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            low, high, hide, bits, label = self.levels[-1]
            heads = np.arange(0, len(low), fan)
            first, last = np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)
            self.levels.append((
                np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(hide, heads),
                np.bitwise_or.reduceat(bits, heads, axis=0), np.where(first == last, first, -1),
            ))
            self.fans.append(fan)
            fan = FAN

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Node pairs that may hold a link between two components."""
        low, high, hide, bits, label = self.levels[level]
        keep = (label[i] != label[j]) | (label[i] < 0)
        keep &= (DENOMINATOR * high[i] >= NUMERATOR * low[j]) & (DENOMINATOR * high[j] >= NUMERATOR * low[i])
        i, j = i[keep], j[keep]
        most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(hide[i], hide[j])
        keep[keep] = _enough(most, low[i], low[j])
        return keep

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Member pairs that the dual traversal can't rule out."""
        level = len(self.levels) - 1
        i = j = np.zeros(1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(level, i, j)]
        while stack:
            level, i, j = stack.pop()
            if level == 0:
                keep = i < j
                i, j = i[keep], j[keep]
            keep = self.possible(level, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                found.append((self.order[i], self.order[j]))
                continue
            fan, below = self.fans[level - 1], len(self.levels[level - 1][0])
            step = np.arange(fan)
            for at in range(0, len(i), 2048):  # bounds what is open at once
                ci = (i[at : at + 2048, None, None] * fan + step[:, None] + 0 * step).ravel()
                cj = (j[at : at + 2048, None, None] * fan + step + 0 * step[:, None]).ravel()
                keep = (ci <= cj) & (cj < below) & (ci < below)
                stack.append((level - 1, ci[keep], cj[keep]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _proposals(x: np.ndarray, y: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (x, y) one for every component, to the member with most partners: (head, member, partners)."""
    degree = np.bincount(np.concatenate([x, y]), minlength=len(comp))
    member, head = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((-head, degree[head], comp[member]))
    member, head = member[order], head[order]
    last = np.flatnonzero(np.r_[comp[member][1:] != comp[member][:-1], True])
    return head[last], member[last], degree[head[last]]


def _tree_groups(every: bool):
    """Pairs from the tree of each (key, left, right) group of rows sorted by group; ``every`` one, or proposals."""
    names = ["a", "b"] if every else ["a", "b", "comp", "v"]

    def joined(rows: pa.Table) -> pa.RecordBatch | None:
        cid, size, comp, own = (rows.column(c).to_numpy() for c in ("cid", "n", "comp", "own"))
        maps = np.frombuffer(b"".join(rows.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        x, y = SignatureTree(size, maps, comp).pairs()
        if rows.column("left")[0].as_py() != rows.column("right")[0].as_py():  # pairs within a block belong to that block's own group
            apart = own[x] != own[y]
            x, y = x[apart], y[apart]
        if not len(x):
            return None
        if every:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y]))], names=names)
        head, member, votes = _proposals(x, y, comp)
        return pa.RecordBatch.from_arrays([pa.array(cid[head]), pa.array(cid[member]), pa.array(comp[member]), pa.array(votes)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            marks = np.stack([table.column(c).to_numpy() for c in ("key", "left", "right")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            edges = np.concatenate(([0], cuts))
            for k in range(len(edges) - 1):
                if (out := joined(table.slice(edges[k], edges[k + 1] - edges[k]))) is not None:
                    yield out
            rest = table.slice(edges[-1]) if table.num_rows else None
        if rest is not None and rest.num_rows and (out := joined(rest)) is not None:
            yield out

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of ``edges`` (a, b); root is the smallest reachable node.

    Smallest labels spread over edges and jump along pointers; every round is
    staged, so the lineage stays short and lost executors cost one round.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
            .join(labels.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), "root", F.least("near", "root").alias("low"))
        )
        spread = staged(spread, "labels")
        jump = spread.select(F.col("node").alias("low"), F.col("low").alias("far"))
        moved = staged(spread.join(jump, "low").select("node", F.col("root").alias("old"), F.least("low", "far").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels


def _links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts link, verified on whole texts."""
    one, two = (known.select(F.col("cid").alias(side), F.col("text").alias(f"t{side}")) for side in "ab")
    rows = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return staged(rows.mapInArrow(_verify, "a long, b long"), "links")


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after the links' components are put together."""
    if links.isEmpty():
        return comps
    side = lambda c: comps.select(F.col("cid").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = connected_components(edges)
    return staged(comps.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("cid", F.coalesce("root", "comp").alias("comp")), "comps")


def _shared(posted: DataFrame) -> DataFrame:
    """The rows of ``posted`` (cid, key) whose key another class has too.

    A semi-join of the table with itself: both sides are one exchange, and of a
    hot key the left rows are split.
    """
    one, other = posted.alias("one"), posted.hint("merge").alias("other")  # never broadcast: it outgrows its texts
    return one.join(other, (F.col("one.key") == F.col("other.key")) & (F.col("one.cid") != F.col("other.cid")), "left_semi")


def _grouped(shared: DataFrame) -> DataFrame:
    """(key, cid) of ``shared`` without all keys of equal members but the least."""
    sets = shared.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("s"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("x"))
    return shared.join(sets.groupBy("m", "s", "x").agg(F.min("key").alias("key")).select("key"), "key")


def _apart(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, cid, comp, m): members of the groups that still hold two components, and the groups' sizes."""
    members = groups.join(comps, "cid")
    apart = members.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "m")
    return members.join(apart, "key").select("key", "cid", "comp", "m")


def _trees(rows: DataFrame, known: DataFrame, every: bool) -> DataFrame:
    """Pairs from the trees over ``rows`` (key, left, right, own, cid, comp)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(known.select("cid", "n", "bitmap"), "cid").select("key", "left", "right", "own", "cid", "comp", "n", "bitmap")
    dealt = full.repartition(parts, "key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(_tree_groups(every), "a long, b long" if every else "a long, b long, comp long, v long")


def _proposed(groups: DataFrame, comps: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """At most one pair (a, b) for every component, from the trees of the groups that its members stay in."""
    block = F.pmod(F.xxhash64("cid", F.lit(turn)), F.ceil(F.col("m") / BLOCK)).cast("int")
    stays = F.min_by(F.struct("key", "comp", "m"), F.xxhash64("key", F.lit(turn))).alias("stay")
    rows = _apart(groups, comps).groupBy("cid").agg(stays).select("cid", "stay.*")
    trees = _trees(rows.select("key", block.alias("left"), block.alias("right"), block.alias("own"), "cid", "comp"), known, every=False)
    best = trees.groupBy("comp").agg(F.max(F.struct("v", "a", "b")).alias("best"))
    return best.select(F.least("best.a", "best.b").alias("a"), F.greatest("best.a", "best.b").alias("b")).distinct()


def _rare_groups(hot: DataFrame, known: DataFrame) -> DataFrame:
    """(key, cid): the classes in ``hot`` (cid) posted under the rarest 0.2 n + 1 of their shingles."""
    shingles = staged(known.join(hot, "cid").select("cid", "text").mapInArrow(_listed(lambda h: h.view(np.int64)), "cid long, key long"), "shingles")
    spread = shingles.groupBy("key").agg(F.count("*").alias("spread")).where("spread >= 2")
    rarest = Window.partitionBy("cid").orderBy("spread", "key")
    size = known.select("cid", F.floor(F.col("n") / 5).alias("alone"))
    own = shingles.groupBy("cid").agg(F.count("*").alias("all"))
    met = shingles.join(spread, "key").withColumn("place", F.row_number().over(rarest)).join(own, "cid").join(size, "cid")
    # Shingles of one class alone come first in its order and bring nobody together: they only use up places.
    met = met.withColumn("met", F.count("*").over(Window.partitionBy("cid")))
    posted = staged(met.where(F.col("place") + F.col("all") - F.col("met") <= F.col("alone") + 1).select("key", "cid"), "rarest")
    return _grouped(staged(_shared(posted), "shared"))


def _all_pairs(groups: DataFrame, comps: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that the trees of all groups with two components leave."""
    apart = staged(_apart(groups, comps), "apart")
    large = F.col("m") > BLOCK
    hot = apart.where(large).select("cid").distinct()
    rows = apart.where(~large)
    if not hot.isEmpty():
        rows = rows.unionByName(_apart(staged(_rare_groups(hot, known), "rare"), comps))
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "cid", "comp")
    return _trees(rows, known, every=True).distinct()


class _Classes:
    """Rows of documents, their classes of equal sets, and the groups of classes that may link."""

    def __init__(self, docs: DataFrame, text: str):
        small_arrow_batches(docs.sparkSession)
        body = docs.select("doc_id", docs[text].cast("string").alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")
        id_type = body.schema["doc_id"].dataType.simpleString()
        self.rows = staged(body.mapInArrow(_sized, f"doc_id {id_type}, rk long, n long, digest binary"), "sized")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("least")
        classes = self.rows.where("digest IS NOT NULL").groupBy("digest").agg(least, F.first("n").alias("n"), F.count("*").alias("copies"))
        self.classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        wanted = self.classes.where(F.col("n") >= SMALLEST).select("cid", "least.rk")
        # Rows that share a row key are equal rows, so any one of them serves.
        texts = staged(body.join(wanted.hint("merge"), "rk").groupBy("rk", "cid").agg(F.first("text").alias("text")).select("cid", "text"), "texts")
        free_shuffles(docs.sparkSession)
        self.groups = staged(_grouped(staged(_shared(texts.mapInArrow(_listed(neighbour_keys), "cid long, key long")), "shared")), "groups")
        free_shuffles(docs.sparkSession)
        involved = self.groups.select("cid").distinct()
        self.known = staged(texts.join(involved, "cid").select("cid", "text").mapInArrow(_signed, "cid long, n long, bitmap binary, text string"), "known")

    def alone(self) -> DataFrame:
        return self.known.select("cid", F.col("cid").alias("comp"))


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, component_rk) for every row of ``docs``.

    ``rk`` is a row key (hash of id and text); ``component_rk`` is that of the
    component's smallest row, ids first and then keys.
    """
    own = _Classes(docs, text)
    comps = own.alone()
    for turn in range(ROUNDS):
        comps = _merge(comps, _links(_proposed(own.groups, comps, own.known, turn), own.known))
    comps = _merge(comps, _links(_all_pairs(own.groups, comps, own.known), own.known))
    labelled = own.classes.select("digest", "cid", "least").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    tops = labelled.groupBy("comp").agg(F.min("least").alias("top"))
    named = labelled.join(tops, "comp").select("digest", F.col("top.doc_id").alias("component_id"), F.col("top.rk").alias("component_rk"))
    return own.rows.join(named.hint("merge"), "digest", "left").select(
        "doc_id", "rk", F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_rk", "rk").alias("component_rk"),
    )


def jaccard_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, copies_a, copies_b): every link between two different shingle sets, by the least id of each.

    This is the join itself; a group of m near copies has up to m (m - 1) / 2 links.
    """
    own = _Classes(docs, text)
    links = _links(_all_pairs(own.groups, own.alone(), own.known), own.known)
    side = lambda c: own.classes.select(F.col("cid").alias(c), F.col("least.doc_id").alias(f"id_{c}"), F.col("copies").alias(f"copies_{c}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "copies_a", "copies_b")


def link_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_links): for the least id of every class that links, with how many rows it links, its own copies included."""
    links = jaccard_links(docs, text)
    ends = links.select(F.col("a").alias("doc_id"), F.col("copies_a").alias("own"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("doc_id"), F.col("copies_b").alias("own"), F.col("copies_a").alias("n")))
    return ends.groupBy("doc_id").agg((F.sum("n") + F.max("own") - 1).alias("n_links"))
