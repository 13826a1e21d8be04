"""Patches predicted from neighbourhoods: a transformer with given weights, and a least-squares fit.

Both take a point's k nearest neighbours in rank order. The neighbourhood join is a Spark plan; the vector function runs over Arrow
batches, its weights closed over (their size is the model's, not the data's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours

NAMES = ("a00", "a01", "a10", "a11", "a02", "a20")
#: Bias of an untrained output layer: the patch of a unit sphere.
BIAS = np.array([0, 0, 0, 0, -0.5, -0.5])


def neighbourhoods(cloud: DataFrame, k: int) -> DataFrame:
    """(pid, hood array<struct<rank, px, py, pz, nx, ny, nz>>), each point's k nearest in rank order, itself first."""
    got = neighbours.nearest_lists(cloud.select("pid", "x", "y", "z"), cloud.select("pid", "x", "y", "z", "nx", "ny", "nz"), k, ("x", "y", "z", "nx", "ny", "nz"))
    hood = F.transform("near", lambda s, i: F.struct((i + 1).alias("rank"), *[s[c].alias(f"p{c}") for c in "xyz"], *[s[c].alias(c) for c in ("nx", "ny", "nz")]))
    return got.select("pid", hood.alias("hood"))


def _basis(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = n / np.maximum(np.linalg.norm(n, axis=-1, keepdims=True), 1e-10)
    u = np.where(np.abs(n[..., :1]) > 0.9, np.array([0.0, 1.0, 0.0]), np.array([1.0, 0.0, 0.0]))
    s = np.cross(n, u)
    s = s / np.maximum(np.linalg.norm(s, axis=-1, keepdims=True), 1e-10)
    return s, np.cross(n, s), n


def features(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(batch, k, 6) offsets and normals in the frame of the first point, in units of the median distance, and that unit."""
    s, t, m = _basis(n[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=-1, keepdims=True), 1e-10)
    d = p - p[:, :1]
    unit = np.maximum(np.median(np.linalg.norm(d, axis=-1), axis=1), 1e-10)
    axes = np.stack([s, t, m], -1)
    return np.concatenate([np.einsum("bki,bij->bkj", d / unit[:, None, None], axes), np.einsum("bki,bij->bkj", n, axes)], -1), unit


def _normed(x, scale, bias):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-6) * scale + bias


def _gelu(x):
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def untrained(dim: int = 128, layers: int = 4, heads: int = 4, mlp: int = 256, seed: int = 0) -> dict:
    """Weights as a fresh model has them: random inside, zero in the last layer, whose bias is the unit sphere's patch."""
    rng = np.random.default_rng(seed)
    lin = lambda a, b: (rng.normal(0, a**-0.5, (a, b)), np.zeros(b))
    ln = lambda: (np.ones(dim), np.zeros(dim))
    blocks = [{"ln1": ln(), "q": lin(dim, dim), "k": lin(dim, dim), "v": lin(dim, dim), "o": lin(dim, dim), "ln2": ln(), "up": lin(dim, mlp), "down": lin(mlp, dim)} for _ in range(layers)]
    return {"heads": heads, "embed": lin(6, dim), "ln0": ln(), "blocks": blocks, "ln": ln(), "out": (np.zeros((dim, 6)), BIAS.copy())}


def seeded(dim: int = 128, layers: int = 4, heads: int = 4, mlp: int = 256, seed: int = 0) -> dict:
    """A stand-in for trained weights: random everywhere, small in the last layer, so that patches vary about the unit sphere's."""
    rng = np.random.default_rng(seed + 1)
    w = untrained(dim, layers, heads, mlp, seed)
    near = lambda pair, by: tuple(a + rng.normal(0, by, a.shape) for a in pair)
    blocks = [{n: near(pair, 0.05) for n, pair in b.items()} for b in w["blocks"]]
    return w | {"blocks": blocks} | {n: near(w[n], 0.05) for n in ("embed", "ln0", "ln", "out")}


_BLOCK = ("ln1", "q", "k", "v", "o", "ln2", "up", "down")


def named(w: dict) -> dict[str, np.ndarray]:
    """The arrays of a model by name: kernel and bias of a layer as .0 and .1."""
    layers = {n: w[n] for n in ("embed", "ln0", "ln", "out")} | {f"blocks.{i}.{n}": b[n] for i, b in enumerate(w["blocks"]) for n in _BLOCK}
    return {"heads": np.array([w["heads"]])} | {f"{n}.{i}": np.asarray(a) for n, pair in layers.items() for i, a in enumerate(pair)}


def assembled(arrays: dict[str, np.ndarray]) -> dict:
    """The model of such arrays, whose shapes must fit each other."""
    depth = len({n.split(".")[1] for n in arrays if n.startswith("blocks.")})
    want = {"heads", *(f"{n}.{i}" for n in ("embed", "ln0", "ln", "out", *(f"blocks.{k}.{n}" for k in range(depth) for n in _BLOCK)) for i in (0, 1))}
    if wrong := want ^ set(arrays):
        raise ValueError(f"arrays missing or unknown: {', '.join(sorted(wrong))}")
    inputs, dim = arrays["embed.0"].shape
    heads = int(arrays["heads"][0])
    if inputs != 6:
        raise ValueError(f"embed.0 takes {inputs} features of a neighbour; there are 6")
    if heads < 1 or dim % heads:
        raise ValueError(f"{dim} features can't be dealt to {heads} heads")
    mlp = arrays["blocks.0.up.0"].shape[-1] if depth else 0
    sizes = {"embed": (6, dim), "out": (dim, 6), "up": (dim, mlp), "down": (mlp, dim)} | {n: (dim, dim) for n in "qkvo"} | {n: (dim,) for n in ("ln0", "ln", "ln1", "ln2")}
    for name in want - {"heads"}:
        layer, part = name.split(".")[-2:]
        shape = sizes[layer] if part == "0" else sizes[layer][-1:]
        if arrays[name].shape != shape:
            raise ValueError(f"{name} has shape {arrays[name].shape}, not {shape}")
    pair = lambda n: (arrays[f"{n}.0"], arrays[f"{n}.1"])
    return {"heads": heads, "blocks": [{n: pair(f"blocks.{i}.{n}") for n in _BLOCK} for i in range(depth)]} | {n: pair(n) for n in ("embed", "ln0", "ln", "out")}


def forward(w: dict, x: np.ndarray) -> np.ndarray:
    """Pre-norm transformer over a neighbourhood; the first token's output."""
    x = _normed(x @ w["embed"][0] + w["embed"][1], *w["ln0"])
    h = w["heads"]
    for b in w["blocks"]:
        y = _normed(x, *b["ln1"])
        q, k, v = (np.moveaxis((y @ b[c][0] + b[c][1]).reshape(*y.shape[:2], h, -1), 2, 1) for c in "qkv")
        a = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
        a = np.exp(a - a.max(-1, keepdims=True))
        y = np.moveaxis((a / a.sum(-1, keepdims=True)) @ v, 1, 2).reshape(x.shape)
        x = x + y @ b["o"][0] + b["o"][1]
        y = _normed(x, *b["ln2"])
        x = x + _gelu(y @ b["up"][0] + b["up"][1]) @ b["down"][0] + b["down"][1]
    return _normed(x[:, 0], *w["ln"]) @ w["out"][0] + w["out"][1]


def transformer(w: dict):
    """Offsets scale with the unit of length, slopes not at all, second-order terms inversely."""

    def patch(p, n):
        x, unit = features(p, n)
        return forward(w, x) * np.stack([unit, np.ones_like(unit), np.ones_like(unit), 1 / unit, 1 / unit, 1 / unit], -1)

    return patch


def least_squares(p, n):
    """Quadric through the neighbourhood in the point's own frame."""
    x, unit = features(p, n)
    u, v, h = x[..., 0], x[..., 1], x[..., 2]
    a = np.stack([np.ones_like(u), v, u, u * v, v * v, u * u], -1)
    at = np.swapaxes(a, -1, -2)
    c = np.linalg.solve(at @ a + 1e-9 * np.eye(6), at @ h[..., None])[..., 0]
    return c * np.stack([unit, np.ones_like(unit), np.ones_like(unit), 1 / unit, 1 / unit, 1 / unit], -1)


def coefficients(cloud: DataFrame, patch, k: int = 64) -> DataFrame:
    """(pid, a00 .. a20) of every point; ``patch`` maps (batch, k, 3) positions and normals to (batch, 6). A cloud smaller than k has
    smaller neighbourhoods."""

    def work(batches):
        for b in batches:
            hood = b.column(1)
            flat = hood.flatten()
            sizes = np.diff(hood.offsets.to_numpy())
            values = np.stack([flat.field(c).to_numpy() for c in ("px", "py", "pz", "nx", "ny", "nz")], -1)
            if len(sizes):
                got = patch(*np.split(values.reshape(len(sizes), sizes[0], 6), 2, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i]) for i in range(6))], names=["pid", *NAMES])

    return neighbourhoods(cloud, k).mapInArrow(work, "pid bigint, " + ", ".join(f"{n} double" for n in NAMES))


def _clipped(poly: np.ndarray, n: np.ndarray, m: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (b, v, 2), of n corners each, cut to p . m <= half; a cut adds a corner at most. A half of 0 or less cuts nothing."""
    at = np.arange(poly.shape[1])
    there = at < n[:, None]
    side = np.where((half > 0)[:, None], half[:, None] - np.einsum("bvi,bi->bv", poly, m), 1.0)
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    far, beyond = np.take_along_axis(side, after, 1), np.take_along_axis(poly, after[..., None], 1)
    inside = side >= 0
    crosses = there & (inside != (far >= 0))
    share = np.where(crosses, side, 0.0) / np.where(crosses, side - far, 1.0)
    both = np.stack([poly, poly + (beyond - poly) * share[..., None]], 2).reshape(len(poly), -1, 2)
    kept = np.stack([there & inside, crosses], 2).reshape(len(poly), -1)
    order = np.argsort(~kept, 1, kind="stable")[:, : poly.shape[1] + 1]
    return np.take_along_axis(both, order[..., None], 1), kept.sum(1)


def _cells(q: np.ndarray) -> np.ndarray:
    """Areas of the cells of the origin among (b, k, 2) others, all of a batch cut by each neighbour in turn, nearest first."""
    b, k = q.shape[:2]
    if not k:
        return np.zeros(b)
    d2 = (q**2).sum(-1)
    poly = np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]]) * (2 * np.sqrt(d2.max(1)))[:, None, None]
    n = np.full(b, 4)
    for j in np.argsort(d2, 1, kind="stable").T:
        poly, n = _clipped(poly, n, np.take_along_axis(q, j[:, None, None], 1)[:, 0], np.take_along_axis(d2, j[:, None], 1)[:, 0] / 2)
    at = np.arange(poly.shape[1])
    after = np.take_along_axis(poly, np.where(at + 1 < n[:, None], at + 1, 0)[..., None], 1)
    turns = poly[..., 0] * after[..., 1] - poly[..., 1] * after[..., 0]
    return 0.5 * np.abs(np.where(at < n[:, None], turns, 0.0).sum(1))


def areas(cloud: DataFrame, k: int = 20) -> DataFrame:
    """(pid, area): the cell of each point among its neighbours in the tangent plane, cut by the bisectors (a local Voronoi cell), bounded
    by a square of twice the farthest neighbour's distance. A point alone has area 0."""

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten()
            size = len(flat) // b.num_rows  # all neighbourhoods have k points, or all of the cloud's
            p, n = (np.stack([flat.field(prefix + c).to_numpy() for c in "xyz"], -1).reshape(b.num_rows, size, 3) for prefix in "pn")
            s, t, _ = _basis(n[:, 0])
            d = p[:, 1:] - p[:, :1]
            q = np.stack([np.einsum("bki,bi->bk", d, s), np.einsum("bki,bi->bk", d, t)], -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_cells(q))], names=["pid", "area"])

    return neighbourhoods(cloud, k).mapInArrow(work, "pid bigint, area double")
