"""Trees of a booster, grown by tasks that keep their rows and run side by side.

The tasks of one barrier stage hold the binned rows, a byte per cell, in files of their own
(memory as far as it reaches) for all rounds. A level of a tree is one pass over them:

- A task adds up the sums of the objective by (feature, node, bin). Only the smaller child of
  a split is counted, the other one is the rest of its parent.
- The sums meet in the shared scratch folder: each task reads its share of the features from
  all tasks, adds them up in the order of the tasks, and names the best split of every node
  among its features; all tasks read these answers and grow the same tree. So a task reads
  and holds a share of the sums, whatever the number of tasks, and the driver gets the trees.
- A sync is a file of each task that the others wait for: a barrier of the scheduler polls
  once a second. Barrier mode starts all tasks at once, and ends all when one fails.

Every ``save_every`` rounds the trees so far are stored; a stage that runs again walks them
and goes on.
"""

from __future__ import annotations

import pickle
import tempfile
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task counts at once: their sums and cells stay in the cache of a core.
CHUNK_ROWS = 1 << 16


@dataclass
class Tree:
    """Nodes as arrays; a node without feature (-1) is a leaf. Cells up to the cut go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1),
                          (self.value, float(value)), (self.cover, float(cover))):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, bin_: int, cut: float, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.cut[node] = feature, bin_, cut
        self.left[node], self.right[node] = left, right

    def steps(self, by_bin: bool, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and cut by node, and the next node by twice the node and one for up to the cut."""
        feature = np.array(self.feature)
        inner = feature >= 0
        # A leaf asks for any cell and stays where it is, whatever the answer.
        at = np.arange(len(feature))
        ways = np.stack([np.where(inner, self.right, at), np.where(inner, self.left, at)], axis=1).ravel()
        cut = np.array(self.bin if by_bin else self.cut)
        return np.where(inner, feature, 0), cut.astype(dtype) if by_bin else cut, ways

    def ends(self, cells: np.ndarray, by_bin: bool) -> np.ndarray:
        """The node of each row; ``cells`` is features x rows, of bins or of values."""
        size = cells.shape[1]
        node = np.zeros(size, np.int64)
        if not size or max(self.feature) < 0:
            return node
        feature, cut, ways = self.steps(by_bin, cells.dtype)
        start = feature * size
        flat, rows = np.ascontiguousarray(cells).ravel(), np.arange(size)
        for _ in range(self._depth()):
            node = ways[2 * node + (flat[start[node] + rows] <= cut[node])]
        return node

    def _depth(self) -> int:
        """Steps of the longest way to a leaf; a child comes after its parent."""
        steps = [0] * len(self.feature)
        for n, f in enumerate(self.feature):
            if f >= 0:
                steps[self.left[n]] = steps[self.right[n]] = steps[n] + 1
        return max(steps)


class Objective(Protocol):
    """What a booster adds up and how it reads the sums."""

    rounds: int
    depth: int
    bins: int
    row_share: float
    seed: int
    base: float
    squares: bool

    def columns(self, round_: int, features: int) -> np.ndarray:
        """The features of a round, ascending."""

    def rows(self, round_: int, margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
        """What is added up per row, None for a count, and the loss of each row."""

    def best(self, sums: np.ndarray, columns: np.ndarray, features: int, round_: int, node: int) -> tuple[float, int, int] | None:
        """Gain, place among the columns and bin of a node's best split; ``sums`` is columns x bins x sums."""

    def value(self, sums: np.ndarray) -> float:
        """The value of a node."""

    def cover(self, sums: np.ndarray) -> float:
        """The weight of a node."""

    def divisible(self, sums: np.ndarray) -> bool:
        """Whether a node may give both sides what they need."""

    def scale(self, round_: int) -> float:
        """What a tree's values are multiplied by in the margin."""


@dataclass
class Grown:
    """A tree, the sums of its nodes, the gains of its splits, and if asked for the weighted squares of its nodes."""

    tree: Tree
    sums: list[np.ndarray]
    gains: dict[int, float] = field(default_factory=dict)
    squares: np.ndarray | None = None


def _held(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a file without a name: what memory has no room for goes to disk, and all with its task."""
    starts = np.concatenate([[0], np.cumsum([-(-a.nbytes // 64) * 64 for a in arrays])])
    with tempfile.TemporaryFile() as file:
        file.truncate(max(int(starts[-1]), 64))
        held = np.memmap(file, np.uint8, "r+").view(np.ndarray)
    out = []
    for a, start in zip(arrays, starts):
        out.append(held[start:start + a.nbytes].view(a.dtype).reshape(a.shape))
        out[-1][...] = a
    return out


class _Chunk:
    """Some of a task's rows with their margins, and in a round their sums, their nodes and whether they are drawn."""

    def __init__(self, blocks: list[list[bytes]], features: int, objective: Objective):
        bins = np.concatenate([np.frombuffer(b[0], np.uint8).reshape(features, -1) for b in blocks], axis=1)
        label, weight = (np.concatenate([np.frombuffer(b[i], np.float64) for b in blocks]) for i in (1, 2))
        row = np.concatenate([np.frombuffer(b[3], np.uint64) for b in blocks])
        n = len(row)
        margin = np.concatenate([np.frombuffer(b[4], np.float64) for b in blocks])
        self.objective, self.size, self.place = objective, n, np.arange(n)
        parts, _ = objective.rows(0, margin[:1], label[:1], weight[:1])
        self.bins, self.label, self.weight, self.row, self.margin, self.node, self.drawn, *sums = _held(
            bins, label, weight, row, margin, np.zeros(n, np.int32), np.ones(n, bool),
            *(np.zeros(n if p is not None else 0) for p in parts))
        self.sums = [s if p is not None else None for s, p in zip(sums, parts)]

    def walk(self, tree: Tree, scale: float) -> None:
        self.margin += scale * np.array(tree.value)[tree.ends(self.bins, True)]

    def begin(self, round_: int) -> np.ndarray:
        """Draw the rows of a round, by a hash of the row and the round; loss and weight of all rows."""
        o = self.objective
        if o.row_share < 1:
            x = self.row + np.uint64((o.seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            self.drawn[...] = (x ^ (x >> np.uint64(31))) < np.uint64(int(o.row_share * 2.0 ** 64))
        parts, loss = o.rows(round_, self.margin, self.label, self.weight)
        for own, now in zip(self.sums, parts):
            if own is not None:
                own[...] = now
        self.node[...] = 0
        return np.array([(loss * self.weight).sum(), self.weight.sum()])

    def count(self, out: np.ndarray, slots: np.ndarray, columns: np.ndarray) -> None:
        """Add the drawn rows of the nodes that have a slot to the sums: columns x sums x cells of slots and bins."""
        slot = slots[self.node]
        rows = np.flatnonzero((slot >= 0) & self.drawn)
        if not len(rows):
            return
        first = slot[rows] * self.objective.bins
        sums = [s if s is None else s[rows] for s in self.sums]
        for c, f in enumerate(columns):
            cells = first + self.bins[f].take(rows)
            for k, s in enumerate(sums):
                out[c, k] += np.bincount(cells, s, out.shape[2])

    def advance(self, tree: Tree) -> None:
        """Rows of nodes that were split go to their children."""
        feature, cut, ways = tree.steps(True, np.uint8)
        flat = self.bins.reshape(-1)
        self.node[...] = ways[2 * self.node + (flat[(feature * self.size)[self.node] + self.place] <= cut[self.node])]

    def squares(self, nodes: int) -> np.ndarray:
        """The first sums squared over the weights, by node of the drawn rows."""
        first, weight = self.sums[0][self.drawn], self.weight[self.drawn]
        return np.bincount(self.node[self.drawn], np.divide(first ** 2, weight, out=np.zeros(len(first)), where=weight > 0), nodes)


def _chunks(batches: Iterable[pa.RecordBatch], features: int, objective: Objective) -> list[_Chunk]:
    out, waiting, rows = [], [], 0
    for batch in batches:
        for block in zip(*(c.to_pylist() for c in batch.columns)):
            waiting.append(block)
            rows += len(block[3]) // 8
            if rows >= CHUNK_ROWS:
                out.append(_Chunk(waiting, features, objective))
                waiting, rows = [], 0
    return out + ([_Chunk(waiting, features, objective)] if waiting else [])


class _Together:
    """What the tasks of a stage tell each other, in files of the shared folder."""

    def __init__(self, folder: str, rank: int, size: int, attempt: str):
        from pyarrow import fs

        self.rank, self.size, self.step = rank, size, 0
        if folder.startswith("file:"):
            folder = "/" + folder[5:].lstrip("/")
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.attempt = attempt
        self.files.create_dir(self.folder, recursive=True)

    def _name(self, step: int, rank: int) -> str:
        return f"{self.folder}/{self.attempt}-{step}-{rank}"

    def store(self, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        with self.files.open_output_stream(f"{name}.part-{self.rank}") as out:
            out.write(data)
        self.files.move(f"{name}.part-{self.rank}", name)

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        with self.files.open_input_file(name) as file:
            return file.read() if size is None else file.read_at(size, start)

    def _tell(self, data: bytes) -> list[str]:
        """Store what this task says and wait for all the others; the names of all files."""
        self.step += 1
        names = [self._name(self.step, r) for r in range(self.size)]
        self.store(names[self.rank], data)
        pause, missing = 0.0005, names
        while missing := [i.path for i in self.files.get_file_info(missing) if not i.is_file]:
            time.sleep(pause)
            pause = min(pause * 1.2, 0.02)
        # Who told this step has read the one before.
        if self.step > 1:
            self.files.delete_file(self._name(self.step - 1, self.rank))
        return names

    def all(self, said):
        """What every task says, in their order."""
        if self.size == 1:
            return [said]
        return [pickle.loads(self.read(name)) for name in self._tell(pickle.dumps(said))]

    def share(self, columns: np.ndarray) -> tuple[int, int]:
        """First and last of the columns whose sums this task adds up."""
        edges = np.linspace(0, len(columns), self.size + 1).round().astype(int)
        return int(edges[self.rank]), int(edges[self.rank + 1])

    def merged(self, own: np.ndarray, first: int, last: int) -> np.ndarray:
        """The sums of all tasks for the share of this one."""
        if self.size == 1:
            return own
        names = self._tell(own.tobytes())
        each = own[0].nbytes if len(own) else 0
        out = np.zeros((last - first, *own.shape[1:]))
        if last > first:
            for name in names:
                out += np.frombuffer(self.read(name, first * each, (last - first) * each)).reshape(out.shape)
        return out


def _first_of_the_best(found: list[tuple | None]) -> tuple | None:
    """The best of several tasks' splits, of equal ones the first feature's."""
    found = [x for x in found if x is not None]
    best = max((x[0] for x in found), default=0.0)
    return next((x for x in found if x[0] >= best - 1e-12 * abs(best)), None)


def _tree(
    chunks: list[_Chunk], together: _Together, objective: Objective, cuts: Sequence[np.ndarray], round_: int,
) -> tuple[Grown, np.ndarray]:
    """One tree, level by level, and loss and weight before it."""
    columns = objective.columns(round_, len(cuts))
    first, last = together.share(columns)
    mine = columns[first:last]
    loss = sum((c.begin(round_) for c in chunks), np.zeros(2))
    parts = len(chunks[0].sums) if chunks else len(objective.rows(0, *np.zeros((3, 1)))[0])
    tree = Tree()
    tree.add(0.0, 0.0)
    grown = Grown(tree, [np.zeros(parts)])
    counted, pairs, level = [0], [], {}
    for depth in range(max(objective.depth, 1)):
        slots = np.full(len(tree.feature), -1)
        slots[counted] = np.arange(len(counted))
        sums = np.zeros((len(columns), parts, len(counted) * objective.bins))
        for chunk in chunks:
            chunk.count(sums, slots, columns)
        sums = together.merged(sums, first, last).reshape(len(mine), parts, len(counted), objective.bins).transpose(2, 0, 3, 1)
        if depth == 0:
            level = {0: sums[0]}
        else:
            level = {
                node: own for slot, (parent, small, large) in enumerate(pairs)
                for node, own in ((small, sums[slot]), (large, level[parent] - sums[slot])) if objective.divisible(grown.sums[node])}
        found = {}
        for node, own in level.items():
            split = objective.best(own, mine, len(cuts), round_, node) if len(mine) and objective.depth else None
            if split is not None:
                gain, k, bin_ = split
                found[node] = gain, int(mine[k]), bin_, own[k, :bin_ + 1].sum(axis=0), own[k, bin_ + 1:].sum(axis=0)
        total = sums[0, 0].sum(axis=0) if depth == 0 and len(mine) else None
        told = together.all((found, total, loss if depth == 0 else None))
        if depth == 0:
            loss = sum((t[2] for t in told), np.zeros(2))
            grown.sums[0] = next((t[1] for t in told if t[1] is not None), grown.sums[0])
            tree.value[0], tree.cover[0] = float(objective.value(grown.sums[0])), float(objective.cover(grown.sums[0]))
        pairs = []
        for node in level:
            best = _first_of_the_best([t[0].get(node) for t in told])
            if best is None:
                continue
            gain, f, bin_, *sides = best
            left, right = (tree.add(objective.value(s), objective.cover(s)) for s in sides)
            grown.sums += sides
            grown.gains[node] = gain
            tree.split(node, f, bin_, float(cuts[f][bin_]), left, right)
            # A node that cannot be divided is a leaf and is not counted.
            if any(objective.divisible(s) for s in sides):
                pairs.append((node, left, right) if tree.cover[left] <= tree.cover[right] else (node, right, left))
        if max(tree.left) >= 0:
            for chunk in chunks:
                chunk.advance(tree)
        if not pairs or depth == objective.depth - 1:
            break
        counted = [p[1] for p in pairs]
    values = objective.scale(round_) * np.array(tree.value)
    for chunk in chunks:
        chunk.margin += values[chunk.node]
    if objective.squares:
        size = len(tree.feature)
        grown.squares = sum(together.all(sum((c.squares(size) for c in chunks), np.zeros(size))), np.zeros(size))
        for node in range(size - 1, -1, -1):
            if tree.left[node] >= 0:
                grown.squares[node] = grown.squares[tree.left[node]] + grown.squares[tree.right[node]]
    return grown, loss


def _stored(together: _Together, folder: str) -> tuple[list[Grown], list[float]]:
    """The trees that an attempt before this one stored, as far as every task sees them."""
    from pyarrow import fs

    names = [i.base_name for i in together.files.get_file_info(fs.FileSelector(together.folder)) if i.base_name.startswith("trees-")]
    seen = max((int(n[6:]) for n in names if n[6:].isdigit()), default=0)
    last = min(together.all(seen))
    return pickle.loads(together.read(f"{together.folder}/trees-{last}")) if last else ([], [])


def _grow(
    batches: Iterable[pa.RecordBatch], together: _Together, objective: Objective, cuts: Sequence[np.ndarray], save_every: int,
) -> tuple[list[Grown], list[float]]:
    """All rounds, as one of the tasks."""
    chunks = _chunks(batches, len(cuts), objective)
    trees, losses = _stored(together, together.folder)
    for round_, grown in enumerate(trees):
        for chunk in chunks:
            chunk.walk(grown.tree, objective.scale(round_))
    for round_ in range(len(trees), objective.rounds):
        grown, (loss, weight) = _tree(chunks, together, objective, cuts, round_)
        trees.append(grown)
        losses.append(float(loss / weight))
        if together.rank == 0 and len(trees) % save_every == 0 and len(trees) < objective.rounds:
            together.store(f"{together.folder}/trees-{len(trees)}", pickle.dumps((trees, losses)))
    # Nobody leaves before all have read what was told last.
    together.all(None)
    return trees, losses


def slots(spark: SparkSession) -> int:
    """Tasks that can run side by side now."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def grow(
    blocks: DataFrame, tasks: int, objective: Objective, cuts: Sequence[np.ndarray], folder: str, save_every: int,
) -> tuple[list[Grown], list[float]]:
    """The trees of a booster over blocks of binned rows, and the loss before each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        # Files of an attempt before this one have another name.
        own = str(context.taskAttemptId())
        together = _Together(folder, context.partitionId(), tasks, context.allGather(own)[0] if tasks > 1 else own)
        grown = _grow(batches, together, objective, cuts, save_every)
        if together.rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grown)], pa.binary())], names=["grown"])

    rows = blocks.repartition(tasks).mapInArrow(run, "grown binary", barrier=True).collect()
    return pickle.loads(rows[0]["grown"])
