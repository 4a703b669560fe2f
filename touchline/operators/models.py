"""Logistic models with the reference's fitting recipe, as Spark jobs.

Recipe to match: impute 0, standardise with the population standard deviation,
L2-regularised logistic regression with C = 1 on the summed loss, intercept
unpenalised; a label with one value predicts that value for every row.
Constant features carry no weight.

Spark form: Newton steps. A pass over the rows sums, in every task, the loss,
its gradient and its second derivatives; the sums are added up by a tree
reduction and the driver solves one system, whose size is that of the inputs,
not of the rows. A few passes reach the least point. One-hot inputs stay
codes: their sums are counts per code and pair of codes, so no pass handles a
wide row. Centring the numeric inputs does not change the fit (the intercept
absorbs it) and keeps the sums accurate. The rows are written as blocks, the
inputs of some thousand rows in one packed binary value each: a pass hands them
to numpy as they are, and no pass takes a row's values one by one.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

MAX_ITER = 100
#: A fit ends with the step that promises to lower the summed loss by less.
TOL = 1e-8
#: Bytes of the inputs of a block; a writer looks at its buffers after every block.
BLOCK_BYTES = 8 << 20
#: Rows of a block whose products are summed at once.
CACHED_ROWS = 1024
BLOCKS = "size int, inputs binary, codes binary, labels binary, moments binary, kept binary"
BLOCK_FILES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)} | {
    f"parquet.{of}.size.row.check.{end}": "1" for of in ("page", "block") for end in ("min", "max")}


def fit_predict(df: DataFrame, inputs: list[str], label: str, out: str,
                keep: list[str]) -> DataFrame:
    """Fit on ``df`` and return ``keep`` + ``out`` (P(label = 1)) for every row
    (see :func:`fit_predict_all`)."""
    return fit_predict_all(df, inputs, {label: out}, keep)


def fit_predict_all(df: DataFrame, inputs: list[str], targets: dict[str, str], keep: list[str],
                    codes: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Fit a model for each label of ``targets`` (label -> output column) in the
    same passes and return ``keep`` and the outputs for every row.

    ``inputs`` are numeric columns; null and NaN count as 0. ``codes`` names
    integer columns and, for each, the 0/1 inputs of every value (values x
    inputs); a null or a value out of range has none of them.

    The inputs are written once, in blocks, to the shared folder: a pass reads
    them as they are and derives nothing. A block also holds its own moments,
    which need no pass over the inputs then, and its columns of ``keep``.
    """
    codes = codes or {}
    outs = list(targets.values())
    path = scratch_path(df.sparkSession, f"fit-{uuid.uuid4().hex}")
    packed = df.select(*keep, F.array(*[_number(F.col(c)) for c in inputs]).alias("x_inputs"),
                       *[F.col(c).cast("int").alias(f"x_code{i}") for i, c in enumerate(codes)],
                       *[F.col(c).cast("double").alias(f"x_label{i}") for i, c in enumerate(targets)])
    shape = Shape(len(inputs), [len(e) for e in codes.values()], len(targets))
    kept = len(keep)
    packed.mapInArrow(lambda batches: shape.blocks(batches, kept), BLOCKS).write.options(**BLOCK_FILES).parquet(path)
    table = df.sparkSession.read.schema(BLOCKS).parquet(path)
    total = _reduced(table.select("moments"), _summed, _merged)
    if total is None:
        return df.select(*keep, *[F.lit(None).cast("double").alias(o) for o in outs])
    rows = table.select("size", "inputs", "codes", "labels")
    design = Design(shape, list(codes.values()), total)
    fitted = [i for i in range(len(targets)) if total["low"][i] != total["high"][i]]
    found = dict(zip(fitted, _fit(rows, design, fitted, total["y"], outs)))
    schema = T.StructType([*packed.schema.fields[:kept], *[T.StructField(f"p{i}", T.DoubleType()) for i in fitted]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches):
            z, at = shape.read(block, design.mean, design.scale)
            probs = [_probability(design.margin(found[i], z, at)) for i in fitted]
            own = pa.ipc.open_stream(block["kept"]).read_next_batch()
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(p) for p in probs]], names=schema.fieldNames())

    done = table.select("size", "inputs", "codes", "kept").mapInArrow(score, schema)
    return done.select(*keep, *[F.col(f"p{i}").alias(o) if i in found else F.lit(float(total["low"][i])).alias(o)
                                for i, o in enumerate(outs)])


def _number(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def _probability(margin: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(margin))
    return np.where(margin >= 0, 1.0, e) / (1.0 + e)


class Shape:
    """How many numeric inputs, code values and labels a row has, and how blocks are made and read."""

    def __init__(self, width: int, values: list[int], labels: int):
        self.width, self.values, self.targets = width, values, labels
        # a code's last place counts the rows without a value
        self.starts = np.cumsum([width, *[v + 1 for v in values]])
        self.size = int(self.starts[-1])
        self.place = np.dtype(np.int16 if max(values, default=0) < 32_000 else np.int32)

    def blocks(self, batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
        """The rows as blocks (see ``BLOCKS``); their first ``kept`` columns stay Arrow."""
        most = max(1, BLOCK_BYTES // (8 * max(self.width, 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                own = batch.slice(start, most)
                x = own.column("x_inputs").flatten().to_numpy().reshape(own.num_rows, self.width)
                at = np.empty((len(self.values), own.num_rows), self.place)
                for i, n in enumerate(self.values):
                    c = own.column(f"x_code{i}").fill_null(-1).to_numpy(zero_copy_only=False)
                    at[i] = np.where((c < 0) | (c >= n), n, c)
                y = np.empty((self.targets, own.num_rows))
                for i in range(self.targets):
                    y[i] = own.column(f"x_label{i}").to_numpy(zero_copy_only=False)
                sink = pa.BufferOutputStream()
                rest = pa.RecordBatch.from_arrays(own.columns[:kept], names=[f"c{i}" for i in range(kept)])
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest)
                cells = (*(pa.compress(v.tobytes(), "lz4", asbytes=True) for v in (x, at, y)), pickle.dumps(self.moments(x, at, y)), sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([own.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]],
                                                 names=[f.split()[0] for f in BLOCKS.split(", ")])

    def read(self, block: dict, mean=0.0, scale=1.0) -> tuple[np.ndarray, np.ndarray]:
        """Standardised numeric inputs (rows x inputs) and the place of each code."""
        at = _plain(block["codes"], self.place, len(self.values), block["size"])
        x = _plain(block["inputs"], np.dtype(float), block["size"], self.width)
        z = x - mean
        z *= scale
        return z, at

    def labels(self, block: dict) -> np.ndarray:
        return _plain(block["labels"], np.dtype(float), self.targets, block["size"])

    def moments(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict:
        """Counts, means and squared deviations of the inputs, sums and ranges of the labels."""
        mean = x.mean(0)
        return {"n": len(x), "mean": mean, "square": ((x - mean) ** 2).sum(0), "least": x.min(0), "most": x.max(0),
                "seen": [np.bincount(c, minlength=n + 1).astype(float) for c, n in zip(at, self.values)],
                "y": y.sum(1), "low": y.min(1), "high": y.max(1)}

    def sums(self, batches: Iterator[pa.RecordBatch], design: "Design", points: dict[int, np.ndarray]) -> np.ndarray:
        """For each label: loss, gradient and second derivatives at its point, over the places of the row."""
        d, s, size = self.width, self.starts, self.size
        out = np.zeros((len(points), 1 + (size + 1) * (size + 2)))
        for block in _each(batches):
            z, at = self.read(block, design.mean, design.scale)
            targets, weights = self.labels(block), []
            for own, (label, point) in zip(out, points.items()):
                y, margin = targets[label], design.margin(point, z, at)
                p = _probability(margin)
                r, w = p - y, p * (1.0 - p)
                weights.append((w, np.sqrt(w)))
                own[0] += (np.logaddexp(0.0, margin) - y * margin).sum()
                g, h = own[1:size + 2], own[size + 2:].reshape(size + 1, size + 1)
                g[:d] += r @ z
                g[size] += r.sum()
                h[:d, size] += w @ z
                h[size, size] += w.sum()
                for i, c in enumerate(at):
                    n, a = self.values[i] + 1, s[i]
                    g[a:a + n] += np.bincount(c, r, n)
                    h[a:a + n, size] += np.bincount(c, w, n)
                    for j in range(i):
                        m, b = self.values[j] + 1, s[j]
                        h[a:a + n, b:b + m] += np.bincount(c.astype(np.int64) * m + at[j], w, n * m).reshape(n, m)
            # the numeric inputs with each other and with the codes, in parts that stay in the processor's cache
            for start in range(0, len(z), CACHED_ROWS):
                part = slice(start, start + CACHED_ROWS)
                of_codes = []
                for i, c in enumerate(at):
                    o = np.argsort(c[part], kind="stable")
                    c = c[part][o]
                    head = np.flatnonzero(np.diff(c, prepend=-1))
                    of_codes.append((o, head, s[i] + c[head].astype(int), z[part][o]))
                for own, (w, root) in zip(out, weights):
                    h = own[size + 2:].reshape(size + 1, size + 1)
                    scaled = z[part] * root[part, None]
                    h[:d, :d] += scaled.T @ scaled
                    for o, head, rows, zs in of_codes:
                        h[rows, :d] += np.add.reduceat(zs * w[part][o][:, None], head, axis=0)
        return out


class Design:
    """The model's inputs as combinations of a row's places: scaled numeric
    inputs and, for each code, the scaled 0/1 inputs of its values."""

    def __init__(self, shape: Shape, marks: list[np.ndarray], total: dict):
        n = total["n"]
        self.shape, self.n = shape, n
        spread = np.sqrt(total["square"] / n)
        varies = (total["least"] != total["most"]) & (spread > 0)
        self.mean = np.where(varies, total["mean"], total["least"])
        self.scale = np.where(varies, 1.0 / np.where(varies, spread, 1.0), 0.0)
        inputs = [np.zeros((shape.size + 1, shape.width))]
        inputs[0][:shape.width] = np.eye(shape.width)
        for a, own, seen in zip(shape.starts, marks, total["seen"]):
            share = seen[:-1] @ own / n
            some = (share > 0) & (share < 1)
            wide = np.zeros((shape.size + 1, own.shape[1]))
            wide[a:a + len(own)] = own * np.where(some, 1.0 / np.sqrt(np.where(some, share * (1.0 - share), 1.0)), 0.0)
            inputs.append(wide)
        last = np.zeros((shape.size + 1, 1))
        last[-1] = 1.0  # the intercept, the one parameter without a penalty
        self.inputs = np.concatenate([*inputs, last], 1)
        self.penalty = np.ones(self.inputs.shape[1])
        self.penalty[-1] = 0.0

    def margin(self, point: np.ndarray, z: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        weight = self.inputs @ point
        out = z @ weight[:self.shape.width] + weight[-1]
        for a, n, c in zip(self.shape.starts, self.shape.values, at):
            out += weight[a:a + n + 1][c]
        return out

    def derivatives(self, sums: np.ndarray, point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Penalised loss, gradient and second derivatives by the model's parameters."""
        size, starts = self.shape.size, self.shape.starts
        h = sums[size + 2:].reshape(size + 1, size + 1).copy()
        for a, n in zip(starts, self.shape.values):
            h[np.arange(a, a + n + 1), np.arange(a, a + n + 1)] = h[a:a + n + 1, size]
        d = self.shape.width
        full = np.tril(h, -1) + np.triu(h, 1).T  # each pair of places was summed once
        full[:d, :d] = np.tril(h[:d, :d], -1)
        full = full + full.T + np.diag(np.diag(h))
        return (sums[0] + 0.5 * (self.penalty * point) @ point,
                self.inputs.T @ sums[1:size + 2] + self.penalty * point,
                self.inputs.T @ full @ self.inputs + np.diag(self.penalty))


def _fit(rows: DataFrame, design: Design, labels: list[int], positives: np.ndarray, names: list[str]) -> list[np.ndarray]:
    """The least points of the labels' losses, by Newton steps with step halving."""
    points = {}
    for i in labels:
        points[i] = np.zeros(design.inputs.shape[1])
        share = min(max(positives[i] / design.n, 1e-9), 1.0 - 1e-9)
        points[i][-1] = np.log(share / (1.0 - share))
    best: dict[int, tuple] = {}  # label -> (point, loss, step, promised gain)
    found: dict[int, np.ndarray] = {}
    for _ in range(MAX_ITER):
        if not points:
            break
        sums = _reduced(rows, lambda batches, now=dict(points): design.shape.sums(batches, design, now), np.add)
        for own, i in zip(sums, list(points)):
            loss, g, h = design.derivatives(own, points[i])
            if i in best and loss > best[i][1] + 1e-12 * abs(best[i][1]):
                point, least, step, gain = best[i]
                best[i] = point, least, step / 2, gain
                points[i] = point + step / 2
                continue
            step = -np.linalg.solve(h, g)
            gain = -0.5 * g @ step
            if gain < TOL:
                found[i] = points.pop(i) + step
                continue
            best[i] = points[i], loss, step, gain
            points[i] = points[i] + step
    if points:
        raise RuntimeError(f"the fit of {', '.join(names[i] for i in points)} did not converge in {MAX_ITER} iterations")
    return [found[i] for i in labels]


def _plain(packed: pa.Buffer, of: np.dtype, *shape: int) -> np.ndarray:
    """The array of a block's binary value."""
    return np.frombuffer(pa.decompress(packed, int(np.prod(shape)) * of.itemsize, "lz4"), of).reshape(shape)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The blocks of the batches, one after the other: their size, and a buffer for each binary column."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() if n == "size" else c[i].as_buffer() for n, c in zip(batch.schema.names, batch.columns)}


def _summed(batches: Iterator[pa.RecordBatch]) -> dict | None:
    """Moments of a task's blocks together."""
    total = None
    for block in _each(batches):
        total = _merged(total, pickle.loads(block["moments"]))
    return total


def _merged(a: dict | None, b: dict | None) -> dict | None:
    if a is None or b is None:
        return b if a is None else a
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    return {"n": n, "mean": a["mean"] + gap * (b["n"] / n), "square": a["square"] + b["square"] + gap ** 2 * (a["n"] * b["n"] / n),
            "least": np.minimum(a["least"], b["least"]), "most": np.maximum(a["most"], b["most"]),
            "seen": [u + v for u, v in zip(a["seen"], b["seen"])], "y": a["y"] + b["y"],
            "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}


def _reduced(rows: DataFrame, one, merge):
    """``one(batches)`` of every task, merged by a tree reduction: the driver
    gets a few results of bounded size, whatever the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([pickle.dumps(one(batches))], pa.binary())})

    parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: pickle.loads(r[0]))
    return parts.treeReduce(merge)
