"""Boosted trees with native missing values and categories, grown from histograms that Spark adds up.

Every input is cut into at most ``max_bins`` bins, bin 0 for a missing value; a row then is one byte for each input. For the
nodes that may be split next, each task adds its rows' gradients, Hessians and counts into one histogram for a node and
input. Histograms of one input meet in one task after the shuffle, which adds them and finds each node's best split there;
the driver sees one candidate for a node and reducing task, never a histogram or a row. Sums are whole numbers (fixed-point
gradients), so a model does not depend on the order of tasks.

A tree grows best leaf first. All leaves that could still be chosen are measured in one job, so a tree costs about as many
jobs as it is deep; a table of up to ``HELD_ROWS`` rows is held by one task, which grows up to ``HELD_ROUNDS`` trees in one job by
the same sums, with a process for each core of its executor. Margins are stored with the rows; rounds since the last store are
applied on the way. Rounds go on where the last one ended: nothing is trained twice, and the best prefix is a cut of the list of
trees.
"""

from __future__ import annotations

import heapq
import mmap
import os
import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.evaluation import average_precision_of_each, ranking_metrics
from creditloom.sources.intermediate import materialise, release

# Gradients and Hessians are added up as multiples of this, exactly.
_UNIT = 2.0**-28
# Least Hessian of a leaf; smoothing and extra L2 penalty when categories are ordered and split.
LEAST_HESSIAN = 1e-3
CATEGORY_SMOOTHING = 10.0
CATEGORY_L2 = 10.0
# Rows of a task, and rounds after which margins are stored and the early-stop rows are scored.
TASK_ROWS = 250_000
STRETCH = 20
# Rows that one task grows trees on, some 200 MB of bins; rounds it grows in one job, and judged margins of that many rounds.
HELD_ROWS = 2_000_000
HELD_ROUNDS = 100
JUDGED_ROWS = 20_000_000
# Least rows of a process that helps in such a task, and of a task that only scores rows.
MEMBER_ROWS = 16_000
# Bins that a process counts at a time, rows of many inputs' joint cells, cells of them, and nodes exchanged at a time.
_COUNTED = 1 << 17
_BLOCK = 1 << 16
_CELLS = 1 << 12
_EXCHANGED = 16

LOGISTIC, SQUARED = "logistic", "squared"


@dataclass(frozen=True)
class Growth:
    """Parameters of one tree; the defaults are fixed values of a full training run."""

    max_leaves: int = 31
    #: 0 for no limit
    max_depth: int = 0
    min_rows: int = 50
    l1: float = 0.1
    l2: float = 0.1


@dataclass(frozen=True)
class Inputs:
    """The inputs of a model: cut points of numbers, labels of categories (then one bin for all others).

    An input with both has its categories as numbers: their places, -1 for a missing one.
    """

    names: list[str]
    cuts: list[list[float] | None]
    labels: list[list[str] | None]

    @property
    def categorical(self) -> np.ndarray:
        return np.array([c is None for c in self.cuts])

    @property
    def bins(self) -> list[int]:
        """Bins of each input: numbers have one more than cuts, categories one more than labels, and one for missing."""
        return [2 + len(c if c is not None else l) for c, l in zip(self.cuts, self.labels)]

    @property
    def width(self) -> int:
        return max(self.bins)

    def as_numbers(self) -> Inputs:
        """The same inputs with categories as numbers, for rows that interpolation has made."""
        places = [[i - 0.5 for i in range(len(l) + 1)] if l is not None else None for l in self.labels]
        return Inputs(self.names, [c if c is not None else p for c, p in zip(self.cuts, places)], self.labels)

    def columns(self, filled: Mapping[str, float] | None = None) -> list[str]:
        """The inputs as SQL expressions of the raw columns, missing ones null; ``filled`` are values for missing numbers."""
        out = []
        for name, cuts, labels in zip(self.names, self.cuts, self.labels):
            if labels is None:
                number = f"CAST(`{name}` AS DOUBLE)"
                out.append(number if filled is None else f"coalesce({number}, CAST('{filled[name]!r}' AS DOUBLE))")
                continue
            listed = ", ".join(sql_text(l) for l in labels)
            place = f"array_position(array({listed}), `{name}`)" if labels else "0"
            absent = "CAST(NULL AS DOUBLE)" if cuts is None else "-1D"
            out.append(f"CASE WHEN `{name}` IS NULL THEN {absent} ELSE CAST(coalesce(nullif({place}, 0), {len(labels) + 1}) - 1 AS DOUBLE) END")
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        """One byte for each row and input; NaN is missing, a category is its label's place."""
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            column = x[:, j]
            known = ~np.isnan(column)
            found = np.searchsorted(cuts, column[known], side="left") if cuts is not None else column[known].astype(np.int64)
            out[known, j] = found + 1
        return out


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, ``feature`` is -1 at leaves, ``left[node, bin]`` says which way a bin goes."""

    feature: np.ndarray
    left: np.ndarray
    children: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while (inner := np.flatnonzero(self.feature[node] >= 0)).size:
            at = node[inner]
            goes_left = self.left[at, bins[inner, self.feature[at]]]
            node[inner] = self.children[at, np.where(goes_left, 0, 1)]
        return node

    def added(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves_of(bins)]

    def added_by_input(self, bins: np.ndarray) -> np.ndarray:
        """The same for many rows that lie input by input: node by node, so that each reads one input in order."""
        out = np.empty(bins.shape[1])
        open_nodes = [(0, np.arange(bins.shape[1]))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
                continue
            goes_left = self.left[node][bins[self.feature[node]][rows]]
            left, right = self.children[node]
            open_nodes += [(left, rows[goes_left]), (right, rows[~goes_left])]
        return out


def sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass
class BoostedTrees:
    inputs: Inputs
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, rows: DataFrame, kept: Sequence[str], name: str = "margin") -> DataFrame:
        """``kept`` columns of rows with ``x array<double>``, and their margin (log-odds under the logistic loss)."""
        inputs, base, trees = self.inputs, self.base, rows.sparkSession.sparkContext.broadcast(self.trees)
        kinds = dict(rows.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{name}` double"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _by_input(inputs.binned(matrix_of(batch["x"], len(inputs.names))))
                margin = np.full(batch.num_rows, base)
                for tree in trees.value:
                    margin += tree.added_by_input(bins)
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(margin)], [*kept, name])

        return rows.select(*kept, "x").mapInArrow(score, schema)

    def leaves(self, rows: DataFrame, kept: Sequence[str]) -> DataFrame:
        """``kept`` columns of rows with ``x``, the node (``leaf``) of the first tree that each falls into and its ``fitted`` value."""
        inputs, base, tree = self.inputs, self.base, self.trees[0]
        kinds = dict(rows.dtypes)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node = tree.leaves_of(inputs.binned(matrix_of(batch["x"], len(inputs.names))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in kept], pa.array(node.astype(np.float64)), pa.array(base + tree.value[node])], [*kept, "leaf", "fitted"]
                )

        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "leaf double", "fitted double"])
        return rows.select(*kept, "x").mapInArrow(place, schema)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; a null number is NaN."""
    flat = column.flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), width)


# --- histograms --------------------------------------------------------------------------------------------


def _gradients(loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == SQUARED:
        return w * (margin - y), w
    p = 1.0 / (1.0 + np.exp(-margin))
    return w * (p - y), w * p * (1.0 - p)


def _drawn(draw: np.ndarray, number: int, share: float) -> np.ndarray:
    """Which rows a round sees: a hash of the row's own number and the round's."""
    if share >= 1:
        return np.ones(len(draw), bool)
    h = draw.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _bytes_of(batch: pa.RecordBatch, inputs: int) -> np.ndarray:
    column = batch["bins"]
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :]
    return np.frombuffer(held, np.uint8)[ends[0] : ends[batch.num_rows]].reshape(batch.num_rows, inputs)


def _by_input(bins: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bins.T)


class _Sums:
    """Histograms (bins x gradient, Hessian, rows) of chosen inputs for the wanted nodes of the tree so far."""

    def __init__(self, sofar: Tree, wanted: list[int], chosen: np.ndarray, width: int) -> None:
        self.sofar, self.chosen, self.width = sofar, chosen, width
        self.slots = np.full(len(sofar.feature), -1)
        self.slots[wanted] = np.arange(len(wanted))
        self.shape = (len(wanted), len(chosen), width, 3)
        self.sums = np.zeros((3, len(wanted) * len(chosen) * width))

    def add(self, bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> None:
        slot = self.slots[self.sofar.leaves_of(bins)]
        used = slot >= 0
        place = ((slot[used, None] * len(self.chosen) + np.arange(len(self.chosen))) * self.width + bins[used][:, self.chosen]).ravel()
        for i, part in enumerate((gradient, hessian, None)):
            weights = None if part is None else np.repeat(np.rint(part[used] / _UNIT), len(self.chosen))
            self.sums[i] += np.bincount(place, weights, self.sums.shape[1])

    def whole(self) -> np.ndarray:
        return np.ascontiguousarray(self.sums.T.reshape(self.shape).astype(np.int64))


def _histograms(rows: DataFrame, shared, wanted: list[int], width: int, loss: str, number: int, share: float) -> DataFrame:
    """feature, node and the task's histogram for the wanted nodes.

    ``shared`` broadcasts the trees that are not in the stored margins yet, the tree so far and its chosen inputs.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, sofar, chosen, n_inputs = shared.value
        sums = _Sums(sofar, wanted, chosen, width)
        for batch in batches:
            if batch.num_rows:
                bins, gradient, hessian = _sampled(batch, pending, n_inputs, loss, number, share)
                sums.add(bins, gradient, hessian)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(chosen, len(wanted)).astype(np.int32)),
                pa.array(np.repeat(wanted, len(chosen)).astype(np.int32)),
                pa.array([h.tobytes() for node in sums.whole() for h in node], pa.binary()),
            ],
            ["feature", "node", "histogram"],
        )

    return rows.select("draw", "y", "w", "bins", "margin").mapInArrow(add, "feature int, node int, histogram binary")


def _sampled(batch, pending: Sequence[Tree], n_inputs: int, loss: str, number: int, share: float):
    """bins, gradients and Hessians of the rows that a round sees."""
    used = _drawn(batch["draw"].to_numpy(), number, share)
    bins = _bytes_of(batch, n_inputs)[used]
    margin, y, w = (batch[c].to_numpy()[used] for c in ("margin", "y", "w"))
    for tree in pending:
        margin = margin + tree.added(bins)
    return bins, *_gradients(loss, margin, y, w)


def _worth(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return np.maximum(np.abs(g) - l1, 0.0) ** 2 / (h + l2)


def best_splits(histograms: np.ndarray, categorical: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each histogram (bins x 3, bin 0 missing): the best gain (-1 for none), which bins go left, and their sums.

    Numbers keep their order, with missing values before or behind; categories are ordered by gradient over Hessian.
    """
    count, width, _ = histograms.shape
    gain, left, sums = np.full(count, -1.0), np.zeros((count, width), bool), np.zeros((count, 3))
    for kind in (False, True):
        some = np.flatnonzero(categorical == kind)
        if not len(some):
            continue
        own, natural = histograms[some], np.arange(width)
        orders = [np.broadcast_to(natural, (len(some), width))]
        if kind:
            # Categories that no row has come last.
            ratio = own[:, :, 0] / (own[:, :, 1] + CATEGORY_SMOOTHING)
            orders = [np.argsort(np.where(own[:, :, 2] > 0, ratio, np.inf), axis=1, kind="stable")]
            own = np.take_along_axis(own, orders[0][:, :, None], axis=1)
        upto = np.cumsum(own, axis=1)
        sides = [upto]
        if not kind:
            # Without the missing values, which then go right.
            sides.insert(0, upto[:, 1:] - upto[:, :1])
            orders.insert(0, np.broadcast_to(natural[1:], (len(some), width - 1)))
        l2 = growth.l2 + (CATEGORY_L2 if kind else 0.0)
        total = upto[:, -1:]
        whole = _worth(total[..., 0], total[..., 1], growth.l1, l2)
        for l, order in zip(sides, orders):
            r = total - l
            fits = (l[..., 2] >= growth.min_rows) & (r[..., 2] >= growth.min_rows)
            fits &= (l[..., 1] >= LEAST_HESSIAN) & (r[..., 1] >= LEAST_HESSIAN)
            with np.errstate(divide="ignore", invalid="ignore"):
                better = _worth(l[..., 0], l[..., 1], growth.l1, l2) + _worth(r[..., 0], r[..., 1], growth.l1, l2) - whole
            better = np.where(fits, better, -1.0)
            place = better.argmax(axis=1)
            rows = np.arange(len(some))
            found = better[rows, place]
            ahead = found > gain[some]
            ways = np.zeros((int(ahead.sum()), width), bool)
            np.put_along_axis(ways, order[ahead], np.arange(order.shape[1]) <= place[ahead, None], axis=1)
            left[some[ahead]] = ways
            sums[some[ahead]] = l[rows, place][ahead]
            gain[some[ahead]] = found[ahead]
    return gain, left, sums


_CANDIDATE = "node int, feature int, gain double, way binary, split binary, total binary"


def _candidates(histograms: DataFrame, inputs: Inputs, growth: Growth, reducers: int) -> DataFrame:
    """The best split of each node among the inputs that one task holds."""
    categorical, width = inputs.categorical, inputs.width
    dealt = histograms.repartition(reducers, "feature") if reducers > 1 else histograms

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            parts = np.frombuffer(b"".join(batch["histogram"].to_pylist()), np.int64).reshape(batch.num_rows, width, 3)
            for node, feature, part in zip(batch["node"].to_pylist(), batch["feature"].to_pylist(), parts):
                held = sums.get((node, feature))
                sums[node, feature] = part if held is None else held + part
        if not sums:
            return
        keys = np.array(sorted(sums))
        whole = np.stack([sums[node, feature] for node, feature in keys.tolist()]).astype(np.float64)
        whole[:, :, :2] *= _UNIT
        gain, left, split = best_splits(whole, categorical[keys[:, 1]], growth)
        # Of equal gains the first input's stays.
        order = np.lexsort((keys[:, 1], -gain, keys[:, 0]))
        best = order[np.concatenate([[True], keys[order[1:], 0] != keys[order[:-1], 0]])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[best, 0].astype(np.int32)),
                pa.array(keys[best, 1].astype(np.int32)),
                pa.array(gain[best]),
                *[pa.array([a.tobytes() for a in part[best]], pa.binary()) for part in (left, split, whole.sum(axis=1))],
            ],
            ["node", "feature", "gain", "way", "split", "total"],
        )

    return dealt.mapInArrow(find, _CANDIDATE)


# --- one tree ----------------------------------------------------------------------------------------------


@dataclass
class _Node:
    depth: int
    sums: np.ndarray | None = None
    #: gain, feature and way of the best split, once measured
    split: tuple[float, int, np.ndarray, np.ndarray] | None = None
    measured: bool = False
    children: tuple[int, int] | None = None


def _as_tree(nodes: list[_Node], chosen: set[int], width: int, growth: Growth, rate: float) -> Tree:
    """The arrays of the nodes that the chosen splits reach, from the root down."""
    kept, queue = [], [0]
    while queue:
        i = queue.pop(0)
        kept.append(i)
        if i in chosen:
            queue.extend(nodes[i].children)
    place = {i: k for k, i in enumerate(kept)}
    tree = Tree(
        np.full(len(kept), -1), np.zeros((len(kept), width), bool), np.zeros((len(kept), 2), np.int64),
        np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept)),
    )
    for k, i in enumerate(kept):
        node = nodes[i]
        if node.sums is not None:
            g, h, tree.rows[k] = node.sums
            tree.value[k] = -rate * np.sign(g) * max(abs(g) - growth.l1, 0.0) / (h + growth.l2) if h + growth.l2 > 0 else 0.0
        if i in chosen:
            tree.gain[k], tree.feature[k], tree.left[k], _ = node.split
            tree.children[k] = [place[c] for c in node.children]
    return tree


def _best_first(nodes: list[_Node], growth: Growth) -> tuple[set[int], list[int]]:
    """The splits that growing leaf by leaf takes as far as gains are known, and nodes whose gains are asked for."""
    chosen: set[int] = set()
    unknown = [] if nodes[0].measured else [0]
    heap: list[tuple[float, int]] = []

    def offer(i: int) -> None:
        node = nodes[i]
        if growth.max_depth and node.depth >= growth.max_depth or node.sums is not None and node.sums[2] < 2 * growth.min_rows:
            return
        if not node.measured:
            unknown.append(i)
        elif node.split is not None:
            heapq.heappush(heap, (-node.split[0], i))

    if nodes[0].measured:
        offer(0)
    while heap and len(chosen) < growth.max_leaves - 1:
        _, i = heapq.heappop(heap)
        chosen.add(i)
        node = nodes[i]
        if node.children is None:
            node.children = (len(nodes), len(nodes) + 1)
            _, _, _, left = node.split
            nodes.append(_Node(node.depth + 1, left))
            nodes.append(_Node(node.depth + 1, node.sums - left))
        # What the last split leaves behind is a leaf, whatever it could gain.
        if len(chosen) < growth.max_leaves - 1:
            for child in node.children:
                offer(child)
    return chosen, unknown


#: gain, feature, way, the sums that go left and the node's sums
_Found = tuple[float, int, np.ndarray, np.ndarray, np.ndarray]


def _grown(width: int, growth: Growth, rate: float, measure: Callable[[list[_Node], list[int]], dict[int, _Found]]) -> Tree:
    """One tree, best leaf first; ``measure`` gives the best splits of the asked nodes, all in one go."""
    nodes = [_Node(0)]
    while True:
        taken, asked = _best_first(nodes, growth)
        if not asked:
            return _as_tree(nodes, taken, width, growth, rate)
        found = measure(nodes, asked)
        for i in asked:
            nodes[i].measured = True
            if i in found:
                gain, feature, way, left, nodes[i].sums = found[i]
                if gain > 0:
                    nodes[i].split = (gain, feature, way, left)


def grow_tree(
    rows: DataFrame, inputs: Inputs, growth: Growth, loss: str, pending: Sequence[Tree] = (), chosen: Sequence[int] | None = None,
    rate: float = 1.0, number: int = 0, row_share: float = 1.0, tasks: int = 1,
) -> Tree:
    """One tree on stored rows (draw, y, w, bins, margin), all asked leaves in one job."""
    features = np.arange(len(inputs.names)) if chosen is None else np.array(sorted(chosen))
    context = rows.sparkSession.sparkContext
    rows = rows.coalesce(tasks)

    def measure(nodes: list[_Node], asked: list[int]) -> dict[int, _Found]:
        # Every split made so far, chosen now or not, says where rows stand.
        made = {i for i, node in enumerate(nodes) if node.children is not None}
        at = {place: i for i, place in _places(nodes, made).items()}
        wanted = sorted(place for place, i in at.items() if i in asked)
        sofar = _as_tree(nodes, made, inputs.width, growth, rate)
        shared = context.broadcast((list(pending), sofar, features, len(inputs.names)))
        histograms = _histograms(rows, shared, wanted, inputs.width, loss, number, row_share)
        best: dict[int, tuple] = {}
        for r in _candidates(histograms, inputs, growth, min(tasks, len(features))).collect():
            if r["node"] not in best or (-r["gain"], r["feature"]) < (-best[r["node"]]["gain"], best[r["node"]]["feature"]):
                best[r["node"]] = r
        shared.destroy()
        numbers = lambda raw: np.frombuffer(raw, np.float64)
        return {
            at[n]: (r["gain"], r["feature"], np.frombuffer(r["way"], bool), numbers(r["split"]), numbers(r["total"])) for n, r in best.items()
        }

    return _grown(inputs.width, growth, rate, measure)


class _Team:
    """The processes of one task, which share out its rows and inputs and keep in step.

    The task's own process is the first; helpers are forked, so that they have its rows without a copy. A process that ends
    closes its pipes, which ends the others as well.
    """

    def __init__(self, size: int) -> None:
        self.size, self.place = size, 0
        self._pids: list[int] = []
        self._from: list[int] = []
        self._to: list[int] = []

    def share(self, count: int, place: int | None = None) -> slice:
        """What of ``count`` things a process has, its own if not said."""
        i = self.place if place is None else place
        return slice(count * i // self.size, count * (i + 1) // self.size)

    def run(self, work: Callable[[], list[Tree]]) -> list[Tree]:
        """The result of the work that all of them do together."""
        to_first, from_first = ([os.pipe() for _ in range(self.size - 1)] for _ in range(2))
        for i in range(1, self.size):
            pid = os.fork()
            if not pid:
                self._help(i, to_first, from_first, work)
            self._pids.append(pid)
        self._from, self._to = [r for r, _ in to_first], [w for _, w in from_first]
        for fd in [*[w for _, w in to_first], *[r for r, _ in from_first]]:
            os.close(fd)
        try:
            return work()
        finally:
            for fd in [*self._from, *self._to]:
                os.close(fd)
            for pid in self._pids:
                os.waitpid(pid, 0)

    def _help(self, place: int, to_first: list[tuple[int, int]], from_first: list[tuple[int, int]], work: Callable[[], list[Tree]]) -> None:
        """The life of a helper, which never returns to the code of the task."""
        failed = 1
        try:
            self.place, self._from, self._to = place, [from_first[place - 1][0]], [to_first[place - 1][1]]
            for fd in {fd for pipe in [*to_first, *from_first] for fd in pipe} - {*self._from, *self._to}:
                os.close(fd)
            work()
            failed = 0
        except BaseException:  # noqa: BLE001
            traceback.print_exc()
        finally:
            os._exit(failed)

    def meet(self) -> None:
        """Returns once all have called it."""
        if self.place:
            os.write(self._to[0], b".")
        for fd in self._from:
            if not os.read(fd, 1):
                raise RuntimeError("a process of this task has ended")
        if not self.place:
            for fd in self._to:
                os.write(fd, b".")


def _members(rows: int, inputs: int, cores: int) -> int:
    """Processes that share a task's work."""
    return max(1, min(cores, len(os.sched_getaffinity(0)), rows // MEMBER_ROWS, inputs))


def _cores(spark: SparkSession) -> int:
    """Cores of one executor, 1 where the session does not tell."""
    context = spark.sparkContext
    if context.master.startswith("local-cluster"):
        return int(context.master.split(",")[1])
    return context.defaultParallelism if context.master.startswith("local") else int(context.getConf().get("spark.executor.cores", "1"))


class _Room:
    """Memory of all processes: histograms of some nodes by process, and each one's best splits."""

    def __init__(self, members: int, inputs: int, width: int, nodes: int) -> None:
        self.sums = self._shared((members, min(_EXCHANGED, nodes), inputs, width, 3), np.int64)
        self.gain, self.feature = self._shared((members, nodes), np.float64), self._shared((members, nodes), np.int64)
        self.way = self._shared((members, nodes, width), bool)
        self.left, self.total = self._shared((members, nodes, 3), np.float64), self._shared((members, nodes, 3), np.float64)

    @staticmethod
    def _shared(shape: tuple[int, ...], kind: type) -> np.ndarray:
        count = int(np.prod(shape))
        return np.frombuffer(mmap.mmap(-1, max(count * np.dtype(kind).itemsize, 1)), kind, count).reshape(shape)


def _grouped(sizes: Sequence[int]) -> list[list[int]]:
    """Inputs that are counted together, since their joint bins are at most ``_CELLS``."""
    groups: list[tuple[int, list[int]]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = [k for k, (cells, _) in enumerate(groups) if cells * sizes[i] <= _CELLS]
        if fitting:
            cells, members = groups[fitting[0]]
            groups[fitting[0]] = (cells * sizes[i], [*members, i])
        else:
            groups.append((sizes[i], [i]))
    return [members for _, members in groups]


class _Held:
    """A process's rows of one round by node, their bins input by input, and its share of the nodes' histograms (input, bin, sums)."""

    def __init__(
        self, bins: np.ndarray, used: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, chosen: np.ndarray, inputs: Inputs, growth: Growth,
        team: _Team, room: _Room,
    ) -> None:
        self.bins, self.chosen, self.width, self.growth, self.team, self.room = bins, chosen, inputs.width, growth, team, room
        self.weights = [np.zeros(bins.shape[1]) for _ in range(2)]
        for weights, part in zip(self.weights, (gradient, hessian)):
            weights[used] = np.rint(part / _UNIT)
        self.sizes = [inputs.bins[k] for k in chosen]
        self.groups = _grouped(self.sizes)
        self.own, self.exchanged = team.share(len(chosen)), room.sums[:, :, : len(chosen)]
        self.categorical = inputs.categorical[chosen[self.own]]
        self.rows = {0: used}
        self.sums: dict[int, np.ndarray] = {}

    def measure(self, nodes: list[_Node], asked: list[int]) -> dict[int, _Found]:
        """The best splits of nodes, which every process learns."""
        self._add_up(nodes, set(asked))
        whole = np.stack([self.sums[i] for i in asked]).astype(np.float64)
        whole[..., :2] *= _UNIT
        parts = best_splits(whole.reshape(-1, self.width, 3), np.tile(self.categorical, len(asked)), self.growth)
        gain, way, left = (part.reshape(len(asked), -1, *part.shape[1:]) for part in parts)
        at, best = np.arange(len(asked)), gain.argmax(axis=1)
        room, place = self.room, self.team.place
        for there, found in (
            (room.gain, gain[at, best]), (room.feature, self.chosen[self.own][best]), (room.way, way[at, best]), (room.left, left[at, best]),
            (room.total, whole[:, 0].sum(axis=1)),
        ):
            there[place, : len(asked)] = found
        self.team.meet()
        # Of equal gains the first input's stays; inputs are shared out in order.
        first = room.gain[:, : len(asked)].argmax(axis=0)
        return {
            node: (float(room.gain[m, i]), int(room.feature[m, i]), room.way[m, i].copy(), room.left[m, i].copy(), room.total[0, i].copy())
            for i, (node, m) in enumerate(zip(asked, first))
        }

    def _add_up(self, nodes: list[_Node], asked: set[int]) -> None:
        """The histograms of asked nodes: of two children the one with fewer rows is counted, the other has what is left."""
        counted: list[tuple[int, int | None, int | None]] = [] if self.sums else [(0, None, None)]
        for i, node in enumerate(nodes):
            if node.children is None or i not in self.rows or not asked.intersection(node.children):
                continue
            _, feature, way, _ = node.split
            rows = self.rows.pop(i)
            goes_left = way[self.bins[feature].take(rows)]
            left, right = node.children
            self.rows[left], self.rows[right] = rows[goes_left], rows[~goes_left]
            few, many = (left, right) if nodes[left].sums[2] <= nodes[right].sums[2] else (right, left)
            counted.append((few, many, i))
        for first in range(0, len(counted), _EXCHANGED):
            lot = counted[first : first + _EXCHANGED]
            if first:
                self.team.meet()  # what was exchanged before is read
            for k, (few, _, _) in enumerate(lot):
                self._count(self.rows[few], self.exchanged[self.team.place, k])
            self.team.meet()
            for k, (few, many, parent) in enumerate(lot):
                self.sums[few] = self.exchanged[:, k, self.own].sum(axis=0)
                if many is not None:
                    self.sums[many] = self.sums.pop(parent) - self.sums[few]

    def _count(self, rows: np.ndarray, out: np.ndarray) -> None:
        out[:] = 0
        if len(rows) < _CELLS:
            self._count_apart(rows, out)
            return
        for first in range(0, len(rows), _BLOCK):
            block = rows[first : first + _BLOCK]
            weights = [*[part.take(block) for part in self.weights], None]
            for group in self.groups:
                # One cell for each combination of the group's bins, from which every input's own sums are taken.
                code, shape = 0, [self.sizes[i] for i in group]
                for i in group:
                    code = code * np.uint16(self.sizes[i]) + self.bins[self.chosen[i]].take(block).astype(np.uint16)
                code = code.astype(np.intp)
                for part, given in enumerate(weights):
                    cells = np.bincount(code, given, int(np.prod(shape))).astype(np.int64).reshape(shape)
                    for axis, i in enumerate(group):
                        out[i, : shape[axis], part] += cells.sum(axis=tuple(a for a in range(len(group)) if a != axis))

    def _count_apart(self, rows: np.ndarray, out: np.ndarray) -> None:
        weights = [part.take(rows) for part in self.weights]
        # Few rows: many inputs in one go, as many as stay in a core's cache.
        lot = max(1, _COUNTED // max(len(rows), 1))
        for first in range(0, len(self.chosen), lot):
            own = self.bins[self.chosen[first : first + lot, None], rows].astype(np.intp)
            own += np.arange(len(own))[:, None] * self.width
            for i, part in enumerate((*weights, None)):
                repeated = part if part is None or len(own) == 1 else np.tile(part, len(own))
                out[first : first + lot, :, i] = np.bincount(own.ravel(), repeated, len(own) * self.width).reshape(len(own), self.width)


def _grow_in_one_task(
    rows: DataFrame, inputs: Inputs, growth: Growth, plan: Sequence[tuple[int, Sequence[int]]], rate: float, row_share: float, cores: int = 1
) -> DataFrame:
    """The trees of several rounds (number, arrays), grown by the same steps inside the one task that all rows make up.

    ``plan`` holds each round's number and chosen inputs. A table of up to ``HELD_ROWS`` rows needs no shuffle, and so no job
    for every level of a tree; the sums are the same whole numbers, and so are the trees. Up to ``cores`` processes add up
    shares of the rows and find the splits of shares of the inputs; all of them see the same candidates and so grow the same trees.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, columns = [], []
        for batch in batches:
            if batch.num_rows:
                parts.append(_bytes_of(batch, len(inputs.names)))
                columns.append([batch[c].to_numpy() for c in ("margin", "y", "w", "draw")])
        if not parts:
            return
        # Input by input, without another copy of the rows.
        bins = np.empty((len(inputs.names), sum(map(len, parts))), np.uint8)
        np.concatenate([part.T for part in parts], axis=1, out=bins)
        parts.clear()
        columns = [np.concatenate(c) for c in zip(*columns)]
        chosen = [np.array(sorted(c)) for _, c in plan]
        team = _Team(_members(bins.shape[1], min(map(len, chosen), default=1), cores))
        room = _Room(team.size, max(map(len, chosen), default=1), inputs.width, 2 * growth.max_leaves)

        def work() -> list[Tree]:
            own = team.share(bins.shape[1])
            mine, (margin, y, w, draw) = bins[:, own], [c[own] for c in columns]
            done: list[Tree] = []
            for (number, _), features in zip(plan, chosen):
                used = np.flatnonzero(_drawn(draw, number, row_share))
                held = _Held(mine, used, *_gradients(LOGISTIC, margin[used], y[used], w[used]), features, inputs, growth, team, room)
                done.append(_grown(inputs.width, growth, rate, held.measure))
                margin = margin + done[-1].added_by_input(mine)
            return done

        done = team.run(work)
        made = [[tree_columns(t)[c] for t in done] for c in _TREE_COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([number for number, _ in plan], pa.int32()), *map(pa.array, made)], ["number", *_TREE_COLUMNS])

    return rows.coalesce(1).mapInArrow(grow, "number int, " + ", ".join(f"{c} binary" for c in _TREE_COLUMNS))


_TREE_COLUMNS = {"feature": "int64", "left": "bool", "children": "int64", "value": "float64", "rows": "float64", "gain": "float64"}


def tree_columns(tree: Tree | None = None) -> dict[str, bytes]:
    """A tree's arrays as bytes; without a tree, the names alone."""
    return {c: getattr(tree, c).astype(kind).tobytes() if tree else b"" for c, kind in _TREE_COLUMNS.items()}


def tree_of(row, width: int) -> Tree:
    """A tree from its arrays' bytes."""
    parts = {c: np.frombuffer(row[c], kind) for c, kind in _TREE_COLUMNS.items()}
    return Tree(**parts | {"left": parts["left"].reshape(-1, width), "children": parts["children"].reshape(-1, 2)})


def _places(nodes: list[_Node], made: set[int]) -> dict[int, int]:
    """Places of the nodes in the arrays of ``_as_tree``."""
    kept, queue = [], [0]
    while queue:
        i = queue.pop(0)
        kept.append(i)
        if i in made:
            queue.extend(nodes[i].children)
    return {i: k for k, i in enumerate(kept)}


# --- rounds ------------------------------------------------------------------------------------------------


def binned_rows(rows: DataFrame, inputs: Inputs, base: float, weight: float | None = None) -> DataFrame:
    """draw, y, w, bins and margin of rows with id, y and x, dealt into tasks of bounded size and stored."""
    w = F.lit(1.0) if weight is None else F.when(F.col("y") == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
    ready = rows.select(F.xxhash64("id", "x").alias("draw"), F.col("y").cast("double").alias("y"), w.alias("w"), "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = inputs.binned(matrix_of(batch["x"], len(inputs.names)))
            yield pa.RecordBatch.from_arrays(
                [batch["draw"], batch["y"], batch["w"], pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(np.full(len(bins), base))],
                ["draw", "y", "w", "bins", "margin"],
            )

    return ready.mapInArrow(cut, "draw long, y double, w double, bins binary, margin double")


def _in_tasks(rows: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """Rows stored in as many files as tasks should read them, that number and the rows'.

    Tasks of at most ``HELD_ROWS`` rows are only scored side by side, and keep every core busy.
    """
    stored = materialise(rows, label)
    count = stored.count()
    tasks = -(-count // TASK_ROWS) or 1
    if count <= HELD_ROWS:
        tasks = max(tasks, min(count // MEMBER_ROWS, rows.sparkSession.sparkContext.defaultParallelism))
    dealt = materialise(stored.repartition(tasks, "draw"), label)
    release(stored)
    return dealt, tasks, count


def _staged(rows: DataFrame, trees: list[Tree], n_inputs: int) -> DataFrame:
    """round (from 0), y and margin after each of the trees."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, margin = _by_input(_bytes_of(batch, n_inputs)), batch["margin"].to_numpy()
                for number, tree in enumerate(shared.value):
                    margin = margin + tree.added_by_input(bins)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, number, np.int32)), batch["y"], pa.array(margin)], ["round", "y", "margin"]
                    )

    return rows.select("y", "bins", "margin").mapInArrow(stage, "round int, y double, margin double")


def _advanced(rows: DataFrame, trees: list[Tree], n_inputs: int, tasks: int, label: str) -> DataFrame:
    """The rows with margins that include the trees, stored; the former copy is released."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, margin = _by_input(_bytes_of(batch, n_inputs)), batch["margin"].to_numpy()
                for tree in shared.value:
                    margin = margin + tree.added_by_input(bins)
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    moved = materialise(rows.mapInArrow(move, rows.schema).coalesce(tasks), label)
    release(rows)
    return moved


def _base(positive: int, rows: int, weight: float | None) -> float:
    """The log-odds of all rows."""
    weighed = positive * (weight or 1.0)
    share = min(max(weighed / max(weighed + rows - positive, 1), 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def fit_boosting(
    train: DataFrame, judged: DataFrame | None, inputs: Inputs, growth: Growth, rounds: int, rate: float, patience: int,
    row_share: float = 1.0, feature_share: float = 1.0, weight: float | None = None, seed: int = 42,
) -> tuple[BoostedTrees, list[float]]:
    """Boosted trees on rows of id, y (0 or 1) and x, and the judged rows' average precision after every round.

    Rounds end when ``patience`` of them brought no better average precision on the judged rows, and the best prefix is kept;
    without judged rows all are. ``weight`` counts a positive row so many times.
    """
    counts = train.agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    model = BoostedTrees(inputs, _base(counts["pos"] or 0, counts["n"], weight))
    n_inputs = len(inputs.names)
    rows, tasks, count = _in_tasks(binned_rows(train, inputs, model.base, weight), "boosting")
    watched, watch_tasks, judges = _in_tasks(binned_rows(judged, inputs, model.base), "watched") if judged is not None else (None, 1, 0)
    # More rounds than patience asks for are not grown at once.
    ahead = min(HELD_ROUNDS, patience, JUDGED_ROWS // max(judges, 1)) if watched is not None else HELD_ROUNDS
    lot = STRETCH * max(ahead // STRETCH, 1) if count <= HELD_ROWS else STRETCH
    cores = _cores(train.sparkSession)
    draws = np.random.default_rng(seed)
    kept = max(1, round(feature_share * n_inputs))
    history: list[float] = []
    while len(model.trees) < rounds:
        first = len(model.trees)
        plan = [(i, draws.choice(n_inputs, kept, replace=False)) for i in range(first, min(first + lot, rounds))]
        if count <= HELD_ROWS:
            found = _grow_in_one_task(rows, inputs, growth, plan, rate, row_share, cores).collect()
            pending = [tree_of(r, inputs.width) for r in sorted(found, key=lambda r: r["number"])]
        else:
            pending = []
            for number, features in plan:
                pending.append(grow_tree(rows, inputs, growth, LOGISTIC, pending, features, rate, number, row_share, tasks))
        if watched is not None:
            staged = _staged(watched, pending, n_inputs)
            if judges <= HELD_ROWS:
                found = average_precision_of_each(staged, ["round"], score="margin")
            else:
                found = ranking_metrics(staged, score="margin", by=["round"])
            by_round = {r["round"]: r["average_precision"] for r in found.collect()}
        ended = False
        for start in range(0, len(pending), STRETCH):
            stretch = pending[start : start + STRETCH]
            model.trees += stretch
            if watched is not None:
                history += [by_round.get(start + i) or 0.0 for i in range(len(stretch))]
                ended = int(np.argmax(history)) + 1 + patience <= len(history)
            # Also after a whole stretch that found no split.
            ended = ended or all(tree.feature[0] < 0 for tree in stretch)
            if ended:
                break
        if ended or not pending or len(model.trees) >= rounds:
            break
        if watched is not None:
            watched = _advanced(watched, pending, n_inputs, watch_tasks, "watched")
        rows = _advanced(rows, pending, n_inputs, tasks, "boosting")
    release(rows)
    if watched is not None:
        release(watched)
    if history:
        model.trees = model.trees[: int(np.argmax(history)) + 1]
    return model, history


@dataclass
class Fit:
    """What one of several models learns from: rows of id, y and x, rows that judge it, and the weight of a positive row."""

    train: DataFrame
    judged: DataFrame
    inputs: Inputs
    weight: float | None = None


def _of_each(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The parts of a batch by their fit."""
    fit = batch["fit"].to_numpy()
    for i in np.unique(fit).tolist():
        yield i, batch.filter(pa.array(fit == i))


def _staged_side_by_side(rows: DataFrame, trees: Mapping[int, list[Tree]], fits: Sequence[Fit]) -> DataFrame:
    """fit, round (from 0), y and margin after each of its fit's trees."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, [len(f.inputs.names) for f in fits]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n_inputs = shared.value
        for batch in batches:
            for i, part in _of_each(batch):
                bins, margin = _by_input(_bytes_of(part, n_inputs[i])), part["margin"].to_numpy()
                for number, tree in enumerate(trees[i]):
                    margin = margin + tree.added_by_input(bins)
                    columns = [part["fit"], pa.array(np.full(part.num_rows, number, np.int32)), part["y"], pa.array(margin)]
                    yield pa.RecordBatch.from_arrays(columns, ["fit", "round", "y", "margin"])

    return rows.select("fit", "y", "bins", "margin").mapInArrow(stage, "fit int, round int, y double, margin double")


def _advanced_side_by_side(rows: DataFrame, trees: Mapping[int, list[Tree]], fits: Sequence[Fit], label: str) -> DataFrame:
    """The rows of the fits that go on, with margins that include their trees, stored; the former copy is released."""
    shared = rows.sparkSession.sparkContext.broadcast((trees, [len(f.inputs.names) for f in fits]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n_inputs = shared.value
        for batch in batches:
            for i, part in _of_each(batch):
                bins, margin = _by_input(_bytes_of(part, n_inputs[i])), part["margin"].to_numpy()
                for tree in trees[i]:
                    margin = margin + tree.added_by_input(bins)
                yield part.set_column(part.schema.get_field_index("margin"), "margin", pa.array(margin))

    moved = materialise(rows.filter(F.col("fit").isin(list(trees))).mapInArrow(move, rows.schema), label, by="fit")
    release(rows)
    return moved


def fit_side_by_side(
    fits: Sequence[Fit], growth: Growth, rounds: int, rate: float, patience: int, row_share: float = 1.0, feature_share: float = 1.0,
    seed: int = 42,
) -> list[tuple[BoostedTrees, list[float]]]:
    """What ``fit_boosting`` gives for each of several fits of at most ``HELD_ROWS`` rows (judged ones as well), stretch by stretch together.

    The tasks that grow the fits' next trees run side by side; one ranking judges the rounds of all fits, and one job each
    moves the margins on. A fit leaves when its patience ends.
    """
    spark = fits[0].train.sparkSession
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    counted = union([f.train.select(F.lit(i).alias("fit"), "y") for i, f in enumerate(fits)]).groupBy("fit")
    found = {r["fit"]: r for r in counted.agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    models = [BoostedTrees(f.inputs, _base(found[i]["pos"], found[i]["n"], f.weight) if i in found else _base(0, 0, f.weight)) for i, f in enumerate(fits)]
    trained = [binned_rows(f.train, f.inputs, m.base, f.weight).withColumn("fit", F.lit(i)) for i, (f, m) in enumerate(zip(fits, models))]
    judging = [binned_rows(f.judged, f.inputs, m.base).withColumn("fit", F.lit(i)) for i, (f, m) in enumerate(zip(fits, models))]
    rows, watched = materialise(union(trained), "boosting", by="fit"), materialise(union(judging), "watched", by="fit")
    draws, cores = [np.random.default_rng(seed) for _ in fits], _cores(spark)
    courses: list[list[float]] = [[] for _ in fits]
    going, first = list(range(len(fits))), 0
    while going and first < rounds:
        plans = {}
        for i in going:
            n_inputs = len(fits[i].inputs.names)
            kept = max(1, round(feature_share * n_inputs))
            plans[i] = [(n, draws[i].choice(n_inputs, kept, replace=False)) for n in range(first, min(first + STRETCH, rounds))]

        def grow(i: int) -> list[Tree]:
            own = rows.filter(F.col("fit") == i)
            found = _grow_in_one_task(own, fits[i].inputs, growth, plans[i], rate, row_share, cores // len(going)).collect()  # noqa: B023
            return [tree_of(r, fits[i].inputs.width) for r in sorted(found, key=lambda r: r["number"])]

        with ThreadPoolExecutor(len(going)) as pool:
            pending = dict(zip(going, pool.map(inheritable_thread_target(spark)(grow), going)))
        staged = _staged_side_by_side(watched.filter(F.col("fit").isin(going)), pending, fits)
        judged = average_precision_of_each(staged, ["fit", "round"], score="margin").collect()
        reached = {(r["fit"], r["round"]): r["average_precision"] for r in judged}
        for i in list(going):
            models[i].trees += pending[i]
            courses[i] += [reached.get((i, n)) or 0.0 for n in range(len(pending[i]))]
            waited = not courses[i] or int(np.argmax(courses[i])) + 1 + patience <= len(courses[i])
            if waited or all(tree.feature[0] < 0 for tree in pending[i]):
                going.remove(i)
        first += STRETCH
        if going and first < rounds:
            moved = {i: pending[i] for i in going}
            rows, watched = (_advanced_side_by_side(t, moved, fits, label) for t, label in ((rows, "boosting"), (watched, "watched")))
    release(rows)
    release(watched)
    for model, course in zip(models, courses):
        model.trees = model.trees[: int(np.argmax(course)) + 1] if course else []
    return list(zip(models, courses))


def fit_regression_tree(rows: DataFrame, inputs: Inputs, max_depth: int, min_rows: int) -> BoostedTrees:
    """One tree of least squares on rows of id, y (any number) and x: leaves hold means."""
    mean = float(rows.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0)
    stored, tasks, _ = _in_tasks(binned_rows(rows, inputs, mean), "surrogate")
    growth = Growth(max_leaves=1 << max_depth, max_depth=max_depth, min_rows=min_rows, l1=0.0, l2=0.0)
    tree = grow_tree(stored, inputs, growth, SQUARED, tasks=tasks)
    release(stored)
    return BoostedTrees(inputs, mean, [tree])
