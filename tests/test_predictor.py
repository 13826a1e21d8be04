"""The predictor against a forward pass written out token by token, and models through files."""

import math

import numpy as np
import pytest

from pointfield.operators import predictor
from pointfield.plans import catalog
from pointfield.sources import files

from .conftest import SF


def normed(v, scale, bias):
    m = sum(v) / len(v)
    s = math.sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-6)
    return np.array([(x - m) / s * a + b for x, a, b in zip(v, scale, bias, strict=True)])


def patch(w, p, n):
    """Six numbers of one neighbourhood: (k, 3) places and normals, the point itself first."""
    n = [v / np.linalg.norm(v) for v in n]
    up = n[0]
    u = np.array([0.0, 1.0, 0.0]) if abs(up[0]) > 0.9 else np.array([1.0, 0.0, 0.0])
    s = np.cross(up, u) / np.linalg.norm(np.cross(up, u))
    t = np.cross(up, s)
    off = [q - p[0] for q in p]
    unit = float(np.median([np.linalg.norm(o) for o in off]))
    tokens = []
    for o, m in zip(off, n, strict=True):
        f = np.array([o @ s / unit, o @ t / unit, o @ up / unit, m @ s, m @ t, m @ up])
        tokens.append(normed(f @ w["embed"][0] + w["embed"][1], *w["ln0"]))
    h = w["heads"]
    for b in w["blocks"]:
        y = [normed(x, *b["ln1"]) for x in tokens]
        q, k, v = ([x @ b[c][0] + b[c][1] for x in y] for c in "qkv")
        size = len(q[0]) // h
        mixed = []
        for i in range(len(tokens)):
            parts = []
            for head in range(h):
                at = slice(head * size, (head + 1) * size)
                e = np.array([math.exp(q[i][at] @ k[j][at] / math.sqrt(size)) for j in range(len(tokens))])
                parts.append(sum(e[j] / e.sum() * v[j][at] for j in range(len(tokens))))
            mixed.append(np.concatenate(parts))
        tokens = [x + m @ b["o"][0] + b["o"][1] for x, m in zip(tokens, mixed, strict=True)]
        for i, x in enumerate(tokens):
            z = normed(x, *b["ln2"]) @ b["up"][0] + b["up"][1]
            g = np.array([0.5 * a * (1 + math.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a**3))) for a in z])
            tokens[i] = x + g @ b["down"][0] + b["down"][1]
    out = normed(tokens[0], *w["ln"]) @ w["out"][0] + w["out"][1]
    return out * np.array([unit, 1, 1, 1 / unit, 1 / unit, 1 / unit])


def test_saved_model_equals_a_forward_pass_token_by_token(spark):
    w = predictor.seeded(32, 2, 4, 64)
    cloud = catalog.QUERIES["s02_obj_cloud_round_trip"](spark, SF).orderBy("pid").collect()
    at, up = np.array([[r.x, r.y, r.z] for r in cloud]), np.array([[r.nx, r.ny, r.nz] for r in cloud])
    got = {r.pid: r for r in catalog.QUERIES["n03_saved_model"](spark, SF).collect()}
    assert len(got) == len(cloud)
    values = []
    for i in range(0, len(cloud), 13):
        d = ((at - at[i]) ** 2).sum(1)
        near = sorted(range(len(cloud)), key=lambda j: (round(d[j], 10), j))[:16]
        want = patch(w, at[near], up[near])
        values.append(want)
        assert [got[cloud[i].pid][c] for c in predictor.NAMES] == pytest.approx(list(want), abs=2e-4)
    assert np.ptp(np.array(values), axis=0).min() > 1e-3  # the weights tell


def test_models_through_files(spark, tmp_path):
    for w in (predictor.seeded(16, 3, 2, 24), predictor.untrained(8, 0, 1, 8)):
        files.write_model(spark, w, f"{tmp_path}/m")
        back = predictor.named(files.read_model(spark, f"{tmp_path}/m"))
        want = predictor.named(w)
        assert back.keys() == want.keys() and all((back[n] == want[n]).all() for n in want)


@pytest.mark.parametrize("spoil, said", [(lambda a: a.pop("ln.1"), "ln.1"), (lambda a: a.update(more=np.zeros(1)), "more"), (lambda a: a.update({"out.0": np.zeros((16, 5))}), "out.0"), (lambda a: a.update({"embed.0": np.zeros((24, 16))}), "24 features"), (lambda a: a.update(heads=np.array([3])), "3 heads")])
def test_models_that_do_not_fit_are_refused(spoil, said):
    arrays = predictor.named(predictor.seeded(16, 2, 2, 24))
    spoil(arrays)
    with pytest.raises(ValueError, match=said):
        predictor.assembled(arrays)


def cell(q):
    """One cell, cut edge by edge."""
    r = 2 * np.linalg.norm(q, axis=1).max()
    poly = [np.array(c) * r for c in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))]
    for m in q[np.argsort((q**2).sum(1), kind="stable")]:
        half = m @ m / 2
        if half <= 0:
            continue
        kept = []
        for p, o in zip(poly, poly[1:] + poly[:1], strict=True):
            a, b = half - p @ m, half - o @ m
            if a >= 0:
                kept.append(p)
            if (a >= 0) != (b >= 0):
                kept.append(p + (o - p) * a / (a - b))
        poly = kept
    x, y = np.array(poly).T
    return 0.5 * abs(x @ np.roll(y, -1) - y @ np.roll(x, -1))


def test_cells_of_a_batch_equal_cells_one_by_one():
    rng = np.random.default_rng(5)
    q = rng.normal(size=(300, 12, 2))
    q[::7, 3] = 0  # a point at the same place
    q[::5, 4] = q[::5, 5]
    q[::11, :6] = np.abs(q[::11, :6])  # open to one side
    ring = np.stack([np.cos(np.arange(12) * np.pi / 6), np.sin(np.arange(12) * np.pi / 6)], -1)
    q[10] = ring
    assert predictor._cells(q) == pytest.approx([cell(x) for x in q])
    assert predictor._cells(q)[10] == pytest.approx(12 * 0.25 * math.tan(math.pi / 12))
    assert (predictor._cells(np.zeros((3, 0, 2))) == 0).all()
