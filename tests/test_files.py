import numpy as np
import pytest

from pointfield.plans.fixtures import frame
from pointfield.sources import files

from .conftest import SF


def test_ply_round_trips(spark, tmp_path):
    cloud = frame(spark, SF, "cloud_sphere").selectExpr("pid", "x", "y", "z", "nx", "ny", "nz", "0.5e0 AS r", "1e0 AS g", "0e0 AS b")
    want = np.array([tuple(r)[1:] for r in cloud.orderBy("pid").collect()])
    for ascii in (True, False):
        path = tmp_path / f"{ascii}.ply"
        path.write_bytes(files.ply_bytes(cloud, ascii))
        got = files.read_cloud(spark, str(path)).orderBy("pid").collect()
        assert np.abs(np.array([tuple(r)[2:] for r in got]) - want).max() < 0.01


def test_obj_text(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 1 2 3\nv 4 5 6\nvn 0 0 2\nvn 3 0 0\nvc 0.1 0.2 0.3\n")
    got = files.read_cloud(spark, str(tmp_path / "a.obj")).orderBy("pid").collect()
    assert [(r.x, r.nz, r.nx, r.r) for r in got] == [(1, 1, 0, 0.1), (4, 0, 1, None)]
    (tmp_path / "b.obj").write_text("v 1 2 3\nf 1/2/3 1//3 1\n")
    with pytest.raises(Exception, match="neither normals nor colours"):
        files.read_cloud(spark, str(tmp_path / "b.obj")).collect()
    vertices, faces = files.read_obj_mesh(spark, str(tmp_path / "b.obj"))
    assert vertices.count() == 1 and [tuple(r) for r in faces.collect()] == [(0, 0, 0, 0)]


def test_stl(spark, tmp_path):
    kind = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    t = np.zeros(2, kind)
    t["v"] = [[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [1, 1, 0], [0, 1, 0]]]
    (tmp_path / "m.stl").write_bytes(bytes(80) + (2).to_bytes(4, "little") + t.tobytes())
    vertices, faces = files.read_stl_mesh(spark, str(tmp_path / "m.stl"))
    assert vertices.count() == 4 and sorted(map(tuple, faces.collect())) == [(0, 0, 1, 2), (1, 1, 3, 2)]


def test_shape_description():
    assert files.read_shape("r 0.5\nv 1 2\n", "x/circle_3.txt") == ("circle", {"r": 0.5, "v": (1.0, 2.0)})
