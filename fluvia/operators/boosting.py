"""Gradient-boosted trees for every station and horizon at once.

Features become bins (cut points of each station; a missing value has a bin of its own and goes to the side that gains
more, so nothing is imputed). Rows are kept as chunks: a station and a stretch of time, its bins as bytes. One pass over the
chunks grows one level of one tree of *all* models: tasks add up gradients by (station, horizon, node, feature, bin), Spark
adds these sums, and each station's best splits join its trees. The number of passes follows trees and depth, not stations,
and what a task holds follows the chunk and the tree. Stations of bounded length (``TASK_ROWS``) needn't wait for passes:
the same steps run over their chunks inside one task each, all stations side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written
from .align import KEY, step_of

BINS = 31
CHUNK_STEPS = 4096
HELD_CELLS = 4_000_000
#: Rows of a station that one task may hold: 30 years of hours, some 20 MB of bins.
TASK_ROWS = 1 << 18
_SUMS = [f"s{i}" for i in range(3 * (BINS + 1))]
STATE = f"{KEY} string, base binary, split binary, leaf binary, err binary, done binary, grown int"
CHUNK = f"{KEY} string, ts binary, x binary, y binary, part binary, w binary"


@dataclass(frozen=True)
class Settings:
    """trees and depth of a model, share of a tree that counts, fewest training rows of a leaf, trees without gain on held-out rows before a model stops."""

    trees: int = 30
    depth: int = 4
    rate: float = 0.15
    least: int = 20
    patience: int = 4

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


def _table(columns: dict, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us"), "long": pa.int64()}
    fields = [tuple(f.split()) for f in schema.split(", ")]
    return pa.table([pa.array(columns[n], kinds[k]) for n, k in fields], schema=pa.schema([(n, kinds[k]) for n, k in fields]))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)


def _chunk_key(step_seconds: int):
    return F.floor(step_of(step_seconds) / CHUNK_STEPS).alias("_chunk")


def cut_points(rows: DataFrame, names: list[str], known) -> DataFrame:
    """(station_id, cuts): up to BINS - 1 quantiles of each feature among the training rows; exact where a station has under 10,000."""
    points = F.array(*(F.lit(k / BINS) for k in range(1, BINS)))
    each = [F.percentile_approx(F.when(known, F.col(n)), points, 10_000).alias(f"_q{i}") for i, n in enumerate(names)]
    return rows.groupBy(KEY).agg(*each).select(KEY, F.array(*(F.coalesce(f"_q{i}", F.array().cast("array<double>")) for i in range(len(names)))).alias("cuts"))


def chunks(rows: DataFrame, names: list[str], cuts: DataFrame, targets: list[str] = (), parts: list[str] = (), weight: str | None = None, step_seconds: int = 86400) -> DataFrame:
    """Binned rows of each station and stretch of time. parts: 1 where a row trains the target's model, 0 where it is held out, null where neither."""

    def pack(key, table: pa.Table, cut: pa.Table) -> pa.Table:
        if not table.num_rows or not cut.num_rows:
            return _table(dict.fromkeys([f.split()[0] for f in CHUNK.split(", ")], []), CHUNK)
        x = np.empty((table.num_rows, len(names)), np.uint8)
        for i, (name, points) in enumerate(zip(names, cut.column("cuts")[0].as_py(), strict=True)):
            v = _numbers(table, name)
            x[:, i] = np.where(np.isnan(v), BINS, np.searchsorted(np.unique(points), v))
        y = np.stack([_numbers(table, t) for t in targets], 1) if targets else np.zeros((table.num_rows, 0))
        p = np.stack([_numbers(table, t) for t in parts], 1) if parts else np.zeros((table.num_rows, 0))
        p = np.where(np.isnan(p) | np.isnan(y), 2, p).astype(np.uint8)
        w = _numbers(table, weight) if weight else np.ones(table.num_rows)
        ts = table.column("ts").cast(pa.int64()).to_numpy()
        one = {KEY: [key[0].as_py()], "ts": [ts.tobytes()], "x": [x.tobytes()], "y": [y.tobytes()], "part": [p.tobytes()], "w": [w.tobytes()]}
        return _table(one, CHUNK)

    keyed = rows.select(KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), *dict.fromkeys([*names, *targets, *parts, *([weight] if weight else [])]), _chunk_key(step_seconds))
    theirs = keyed.select(KEY, "_chunk").distinct().join(cuts, KEY).select(F.col(KEY).alias("_k"), F.col("_chunk").alias("_c"), "cuts")
    return keyed.groupBy(KEY, "_chunk").cogroup(theirs.groupBy("_k", "_c")).applyInArrow(pack, CHUNK)


class Trees:
    """The trees of one station: arrays by horizon, tree and node (children of n: 2n + 1 and 2n + 2)."""

    def __init__(self, s: Settings, n_targets: int, row: dict | None = None, base: np.ndarray | None = None):
        shape, read = (n_targets, s.trees, s.nodes), lambda name, kind, size: np.frombuffer(row[name], kind).reshape(size).copy()
        self.s = s
        self.base = read("base", "f8", n_targets) if row else base
        self.split = read("split", "i4", (*shape, 3)) if row else np.full((*shape, 3), -1, np.int32)
        self.leaf = read("leaf", "f8", shape) if row else np.zeros(shape)
        self.err = read("err", "f8", (n_targets, s.trees + 1)) if row else np.full((n_targets, s.trees + 1), np.nan)
        self.done = read("done", "i4", n_targets) if row else np.where(np.isnan(base), 0, -1).astype(np.int32)

    def row(self, station: str, grown: int) -> dict:
        return {KEY: station, "base": self.base.tobytes(), "split": self.split.tobytes(), "leaf": self.leaf.tobytes(), "err": self.err.tobytes(), "done": self.done.tobytes(), "grown": grown}

    def place(self, x: np.ndarray, h: int, t: int) -> np.ndarray:
        """The node of tree t that each row has come to."""
        node, at = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.s.depth):
            feature, cut, null_left = self.split[h, t, node].T
            b = x[at, np.maximum(feature, 0)]
            right = np.where(b == BINS, null_left == 0, b > cut)
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        return node

    def predict(self, x: np.ndarray, h: int, trees: int) -> np.ndarray:
        out = np.full(len(x), self.base[h])
        for t in range(trees):
            out += self.s.rate * self.leaf[h, t, self.place(x, h, t)]
        return out

    def kept(self, h: int) -> int:
        """Trees that count: up to the least held-out error where there was one."""
        return int(self.done[h]) if self.done[h] >= 0 else self.s.trees

    def mae(self, h: int) -> float:
        e = self.err[h, self.kept(h)]
        return 0.0 if np.isnan(e) else float(e)


def best_split(sums: np.ndarray, least: int) -> tuple[float, int, int, int, float, float]:
    """(gain, feature, cut, null_left, left value, right value) of a node; sums: (features, bins and missing, gradient/weight/rows). Gain 0: none.

    Rows in bins up to the cut go left. Ties take the smaller feature, then cut, then missing values to the right.
    """
    upto = np.cumsum(sums[:, :BINS], 1)[:, : BINS - 1]
    total, null = sums.sum(1), sums[:, BINS]
    left = np.stack([upto, upto + null[:, None]], 2)  # missing right, missing left
    right = total[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - (total[:, 0] ** 2 / total[:, 1])[:, None, None]
    gain[(left[..., 2] < least) | (right[..., 2] < least) | ~np.isfinite(gain)] = 0
    gain[gain < 1e-12] = 0
    top = int(np.argmax(gain))
    f, cut, side = np.unravel_index(top, gain.shape)
    a, b = left[f, cut, side], right[f, cut, side]
    return float(gain.flat[top]), int(f), int(cut), int(side), a[0] / max(a[1], 1e-300), b[0] / max(b[1], 1e-300)


def add_up(trees: Trees, x: np.ndarray, y: np.ndarray, part: np.ndarray, w: np.ndarray, tree: int, level: int, known: dict[int, np.ndarray] | None = None) -> tuple[dict, dict]:
    """(sums of gradient, weight and rows by node of the level, feature and bin; held-out error and rows), each by horizon. known: predictions of the trees before."""
    s, width, first, m = trees.s, BINS + 1, 2**level - 1, x.shape[1]
    cells, errors = {}, {}
    for h in map(int, np.flatnonzero(trees.done < 0)):
        rows = np.flatnonzero(part[:, h] < 2)
        gap = y[rows, h] - (known[h][rows] if known else trees.predict(x[rows], h, tree))
        if level == 0 and (out := part[rows, h] == 0).any():
            errors[h] = np.array([np.abs(gap[out]).sum(), out.sum()])
        if tree == s.trees:
            continue
        keep = part[rows, h] == 1
        rows, gap = rows[keep], gap[keep]
        node = trees.place(x[rows], h, tree) - first
        at = np.flatnonzero(node >= 0)
        rows, gap, node = rows[at], gap[at], node[at]
        if len(rows):
            cell = ((node[:, None] * m + np.arange(m)) * width + x[rows]).ravel()
            size = 2**level * m * width
            add = [np.bincount(cell, np.repeat(v, m), size) for v in (gap * w[rows], w[rows])] + [np.bincount(cell, minlength=size)]
            cells[h] = np.stack(add, 1).reshape(2**level, m, width, 3)
    return cells, errors


def grow(trees: Trees, cells: dict, errors: dict, tree: int, level: int) -> None:
    """Adds the level's best splits, and closes models whose held-out error no longer falls."""
    s, first = trees.s, 2**level - 1
    for h, e in errors.items():
        seen = trees.err[h]
        seen[tree] = e[0] / e[1]
        if tree - int(np.nanargmin(seen)) >= s.patience or tree == s.trees:
            trees.done[h] = int(np.nanargmin(seen))
    for h, sums in cells.items():
        if trees.done[h] >= 0 or tree >= s.trees:
            continue
        for node in np.flatnonzero(sums[:, 0, :, 2].sum(1)):
            n = first + int(node)
            if level == 0:
                total = sums[0, 0].sum(0)
                trees.leaf[h, tree, 0] = total[0] / total[1]
            gain, f, cut, side, a, b = best_split(sums[node], s.least)
            if gain > 0:
                trees.split[h, tree, n] = f, cut, side
                trees.leaf[h, tree, 2 * n + 1], trees.leaf[h, tree, 2 * n + 2] = a, b


def _arrays(row: dict, n_targets: int, n_features: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(row["x"], np.uint8).reshape(-1, n_features)
    y, part = (np.frombuffer(row[c], k).reshape(len(x), n_targets) for c, k in (("y", "f8"), ("part", "u1")))
    return x, y, part, np.frombuffer(row["w"], "f8")


def _whole(s: Settings, n_targets: int, n_features: int):
    """All trees of a station whose chunks fit a task."""

    def run(packed: pa.Table, state: pa.Table) -> pa.Table:
        if not packed.num_rows or not state.num_rows:
            return _table({f.split()[0]: [] for f in STATE.split(", ")}, STATE)
        row = state.to_pylist()[0]
        trees = Trees(s, n_targets, row)
        parts = [_arrays(r, n_targets, n_features) for r in sorted(packed.to_pylist(), key=lambda r: r["ts"])]
        x, y, part, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        margin = {h: np.full(len(x), trees.base[h]) for h in range(n_targets)}
        for tree in range(s.trees + 1):
            for level in range(s.depth if tree < s.trees else 1):
                grow(trees, *add_up(trees, x, y, part, w, tree, level, margin), tree, level)
            if tree < s.trees:
                for h in np.flatnonzero(trees.done < 0):
                    margin[int(h)] += s.rate * trees.leaf[h, tree, trees.place(x, h, tree)]
        return _table({k: [v] for k, v in trees.row(row[KEY], 0).items()}, STATE)

    return run


def _sums(s: Settings, n_targets: int, n_features: int, tree: int, level: int):
    """Gradient sums of the level's nodes by feature and bin; feature -1 holds the held-out error."""
    width, first = BINS + 1, 2**level - 1
    names = [KEY, "h", "node", "feature", *_SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        errors: dict[tuple[str, int], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            keys, blocks = [], []
            for (station, h), cells in held.items():
                for node in np.flatnonzero(cells[:, 0, :, 2].sum(1)):
                    keys += [(station, h, first + int(node), f) for f in range(n_features)]
                    blocks.append(cells[node].transpose(0, 2, 1).reshape(n_features, 3 * width))
            for (station, h), e in errors.items():
                keys.append((station, h, 0, -1))
                blocks.append(np.pad(e, (0, 3 * width - 2))[None])
            data = np.concatenate(blocks) if blocks else np.zeros((0, 3 * width))
            held.clear()
            errors.clear()
            a, b, c, d = zip(*keys, strict=True) if keys else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), *(pa.array(k, pa.int32()) for k in (b, c, d)), *(pa.array(np.ascontiguousarray(data[:, i])) for i in range(3 * width))], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                for own, found in zip((held, errors), add_up(Trees(s, n_targets, row), *_arrays(row, n_targets, n_features), tree, level), strict=True):
                    for h, v in found.items():
                        own[row[KEY], h] = own.get((row[KEY], h), 0) + v
                if sum(c.size for c in held.values()) > HELD_CELLS:
                    yield flush()
        yield flush()

    return run, f"{KEY} string, h int, node int, feature int, " + ", ".join(f"{c} double" for c in _SUMS)


def _grow(s: Settings, n_targets: int, n_features: int, tree: int, level: int):
    """A station's trees with the level's splits, from its sums."""
    width, first = BINS + 1, 2**level - 1

    def run(sums: pa.Table, state: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        trees = Trees(s, n_targets, row)
        h, node, feature = (sums.column(c).to_numpy() if sums.num_rows else np.zeros(0, np.int32) for c in ("h", "node", "feature"))
        data = np.stack([sums.column(c).to_numpy() for c in _SUMS], 1) if sums.num_rows else np.zeros((0, 3 * width))
        errors = {int(h[i]): data[i, :2] for i in np.flatnonzero(feature < 0)}
        cells = {int(k): np.zeros((2**level, n_features, width, 3)) for k in np.unique(h[feature >= 0])}
        for i in np.flatnonzero(feature >= 0):
            cells[int(h[i])][node[i] - first, feature[i]] = data[i].reshape(3, width).T
        grow(trees, cells, errors, tree, level)
        grown = int((trees.done < 0).any() and tree < s.trees)
        return _table({k: [v] for k, v in trees.row(row[KEY], grown).items()}, STATE)

    return run


@dataclass
class Boosted:
    """Fitted trees of every station: a row a station in ``table``, beside its cut points."""

    names: list[str]
    targets: list[str]
    settings: Settings
    table: DataFrame
    cuts: DataFrame

    def predict(self, rows: DataFrame, step_seconds: int = 86400) -> DataFrame:
        """(station_id, ts, target, pred, mae) for each row and target; stations without a model have no row."""
        return self.predict_chunks(chunks(rows, self.names, self.cuts, step_seconds=step_seconds))

    def predict_chunks(self, packed: DataFrame) -> DataFrame:
        s, names, targets, n_features = self.settings, f"{KEY} string, ts timestamp_ntz, target string, pred double, mae double", self.targets, len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    trees = Trees(s, len(targets), row)
                    x, ts = np.frombuffer(row["x"], np.uint8).reshape(-1, n_features), np.frombuffer(row["ts"], "i8")
                    for h, target in enumerate(targets):
                        if not np.isnan(trees.base[h]):
                            one = {KEY: [row[KEY]] * len(x), "ts": ts.view("M8[us]"), "target": [target] * len(x), "pred": trees.predict(x, h, trees.kept(h)), "mae": np.full(len(x), trees.mae(h))}
                            yield from _table(one, names).to_batches()

        return packed.select(KEY, "ts", "x").join(self.table, KEY).mapInArrow(run, names)

    def importance(self) -> DataFrame:
        """(station_id, target, feature, splits): how many nodes of the trees that count ask for each feature."""
        s, names, targets, schema = self.settings, self.names, self.targets, f"{KEY} string, target string, feature string, splits long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    trees, out = Trees(s, len(targets), row), []
                    for h, target in enumerate(targets):
                        used = trees.split[h, : trees.kept(h), :, 0]
                        out += [(row[KEY], target, names[f], int(n)) for f, n in zip(*np.unique(used[used >= 0], return_counts=True), strict=True)]
                    if out:
                        yield from _table(dict(zip((KEY, "target", "feature", "splits"), zip(*out, strict=True), strict=True)), schema).to_batches()

        return self.table.mapInArrow(run, schema)


def fit(rows: DataFrame, names: list[str], targets: list[str], parts: list[str], weight: str | None = None, settings: Settings | None = None, step_seconds: int = 86400, task_rows: int = TASK_ROWS) -> Boosted:
    """A model for each station and target. Stations of more than ``task_rows`` rows grow a level a pass, the others in one task; the trees are the same.

    rows: station_id, ts, the features (null where missing), targets and, for each target, a part: 1 trains, 0 is held out to
    stop early and to measure the mean absolute error, null is unused. A model without training rows is left out.
    """
    s = settings or Settings()
    n, m = len(targets), len(names)
    known = F.greatest(*(F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)) == 1
    w = F.col(weight) if weight else F.lit(1.0)
    cuts = written(cut_points(rows, names, known), "cuts")
    packed = written(chunks(rows, names, cuts, targets, parts, weight, step_seconds), "chunks")
    train = [(F.col(p) == 1) & F.col(t).isNotNull() for t, p in zip(targets, parts, strict=True)]
    means = rows.groupBy(KEY).agg(F.array(*(F.sum(F.when(k, F.col(t) * w)) / F.sum(F.when(k, w)) for k, t in zip(train, targets, strict=True))).alias("m"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = np.array([np.nan if v is None else v for v in row["m"]])
                yield from _table({k: [v] for k, v in Trees(s, n, base=base).row(row[KEY], int((~np.isnan(base)).any())).items()}, STATE).to_batches()

    begun = written(means.mapInArrow(begin, STATE), "trees")
    size = packed.groupBy(KEY).agg(F.sum(F.length("ts") / 8).alias("_n"))
    small, long = (written(begun.join(size.where(c), KEY).select(begun.columns), "trees") for c in (F.col("_n") <= task_rows, F.col("_n") > task_rows))
    done = packed.groupBy(KEY).cogroup(small.select(*(F.col(c).alias(c) for c in small.columns)).groupBy(KEY)).applyInArrow(_whole(s, n, m), STATE)
    state = long
    if not long.isEmpty():
        for tree in range(s.trees + 1):  # the last pass only measures
            for level in range(s.depth if tree < s.trees else 1):
                work, schema = _sums(s, n, m, tree, level)
                both = packed.join(state.where("grown = 1"), KEY)
                sums = both.mapInArrow(work, schema).groupBy(KEY, "h", "node", "feature").agg(*(F.sum(c).alias(c) for c in _SUMS))
                alone = state.select(*(F.col(c).alias(c) for c in state.columns))  # the sums read the same table
                grown = sums.groupBy(KEY).cogroup(alone.groupBy(KEY)).applyInArrow(_grow(s, n, m, tree, level), STATE)
                before, state = state, written(grown, "trees")
                discard(before)
            if state.where("grown = 1").isEmpty():
                break
    table = written(done.unionByName(state), "trees")
    for over in (begun, small, state, packed):
        discard(over)
    return Boosted(names, targets, s, table, cuts)
