"""Graphs as edge tables (src, dst): degrees, reachability, cycles, levels, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.staging import staged


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in) over distinct edges in one pass."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("fan_out"), F.sum("x.i").alias("fan_in"))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst, depth) of all paths of one edge or more; ``seeds`` (node) limits the sources.

    Semi-naive: only pairs found last round are joined on; every round is
    staged, and its pairs are the ones no round before had.
    """
    e = staged(edges.select("src", "dst").distinct(), "edges")
    first = e if seeds is None else e.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    frontier = staged(first.withColumn("depth", F.lit(1)), "frontier")
    rounds = [frontier]
    while not frontier.isEmpty():
        step = frontier.select("src", F.col("dst").alias("mid"), "depth").join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst", (F.col("depth") + 1).alias("depth")).distinct()
        known = reduce(DataFrame.unionByName, rounds).select("src", "dst")
        frontier = staged(step.join(known, ["src", "dst"], "left_anti"), "frontier")
        rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)


#: Up to so many edges components are found in one task, whose memory they bound.
LOCAL_EDGES = 1_000_000


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task: one depth-first walk without recursion."""
    found = list(batches)
    if not found:
        return
    src, dst = (pa.chunked_array([b.column(k) for b in found]).combine_chunks() for k in (0, 1))
    names = pa.concat_arrays([src, dst]).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    heads, tails = codes[: len(src)], codes[len(src) :]
    n = len(names.dictionary)
    order = np.argsort(heads, kind="stable")
    after, first = tails[order], np.searchsorted(heads[order], np.arange(n + 1))
    index, low, component = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
    count, stack, place = 0, [], first[:-1].copy()
    for start in range(n):
        if index[start] >= 0:
            continue
        walk = [start]
        while walk:
            v = walk[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            if place[v] < first[v + 1]:
                w = after[place[v]]
                place[v] += 1
                if index[w] < 0:
                    walk.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            walk.pop()
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    component[w] = v
                    if w == v:
                        break
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[v])
    nodes = names.dictionary.to_pylist()
    least: dict[int, object] = {}
    for node, c in zip(nodes, component.tolist()):
        if c not in least or node < least[c]:
            least[c] = node
    kind = src.type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([least[c] for c in component.tolist()], kind)], names=["node", "component"])


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the least node of a node's strong component; nodes outside cycles stand alone.

    Small graphs go through one task; others by trimming and colours: nodes
    without an edge in or out are alone; the rest takes the least node that
    reaches it as its colour, and what of a colour reaches its node back is a
    component.  Rows stay linear in the edges.
    """
    e = staged(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "edges")
    kind = e.schema["src"].dataType.simpleString()
    if e.count() <= local_edges:
        return e.repartition(1).mapInArrow(_components_of, f"node {kind}, component {kind}")
    every = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    done: list[DataFrame] = []
    left = staged(e.where("src <> dst"), "left")
    while not left.isEmpty():
        core = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = staged(core.select("src", "dst"), "left")
        if core.count() < left.count():
            left = core
            continue
        colour = staged(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            into = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("near"))
            step = staged(colour.join(into, "node", "left").select("node", "colour", F.least("colour", F.coalesce("near", "colour")).alias("less")), "colour")
            colour = step.select("node", F.col("less").alias("colour"))
            if step.where("less <> colour").isEmpty():
                break
        same = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour")
        same = staged(same, "same")
        reached = staged(colour.where("node = colour"), "reached")
        back = reached
        while not back.isEmpty():
            step = same.join(back.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            back = staged(step.join(reached, ["node", "colour"], "left_anti"), "back")
            reached = staged(reached.unionByName(back), "reached")
        done.append(reached)
        gone = reached.select("node")
        left = staged(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "left")
    if not done:
        return every.withColumn("component", F.col("node"))
    named = reduce(DataFrame.unionByName, done).select("node", F.col("colour").alias("component"))
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def in_cycle(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Nodes that reach themselves: of components of two or more, or with an edge to themselves."""
    parts = strong_components(edges, local_edges)
    large = parts.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    return parts.join(large, "component", "left_semi").select("node").unionByName(loops).distinct()


def _levels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, level) of all edges of a task, by taking off sources."""
    found = list(batches)
    if not found:
        return
    src, dst = (pa.chunked_array([b.column(k) for b in found]).combine_chunks() for k in (0, 1))
    names = pa.concat_arrays([src, dst]).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    heads, tails = codes[: len(src)], codes[len(src) :]
    n = len(names.dictionary)
    order = np.argsort(heads, kind="stable")
    after, first = tails[order], np.searchsorted(heads[order], np.arange(n + 1))
    waits, level = np.bincount(tails, minlength=n), np.full(n, -1)
    ready, at = np.flatnonzero(waits == 0), 0
    while len(ready):
        level[ready] = at
        sizes = first[ready + 1] - first[ready]
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[ready], sizes)
        gone = np.bincount(after[place], minlength=n)
        waits -= gone
        ready, at = np.flatnonzero((waits == 0) & (gone > 0)), at + 1
    done = np.flatnonzero(level >= 0)
    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(done)), pa.array(level[done], pa.int32())], names=["node", "level"])


def levels(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, level): the longest path from a source, for nodes that no cycle leads to.

    Small graphs go through one task; others take off their sources round by round.
    """
    e = staged(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct(), "edges")
    if e.count() <= local_edges:
        return e.repartition(1).mapInArrow(_levels_of, f"node {e.schema['src'].dataType.simpleString()}, level int")
    todo = staged(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    done, level = None, 0
    while True:
        waiting = e.join(todo.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = staged(todo.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            return done if done is not None else ready
        done = ready if done is None else done.unionByName(ready)
        todo = staged(todo.join(ready, "node", "left_anti"), "nodes")
        level += 1


def directory_edges(edges: DataFrame, src_dir: str, dst_dir: str, kind: str) -> DataFrame:
    """Edges between different directories, counted in all and by kind."""
    return edges.where(F.col(src_dir) != F.col(dst_dir)).groupBy(src_dir, dst_dir).agg(F.count("*").alias("total"), F.sort_array(F.collect_set(kind)).alias("kinds"))
