"""Clouds, queries, meshes and rays derived from the star-schema tables; one text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



#: Rows of quads around a tube, ``across`` of them, and as many along it as there are parts for.
_QUADS = """(select p_partkey, i, j, along, across, (i + 1) % along as i1, (j + 1) % across as j1
  from (select p_partkey, cast(floor(p_partkey/across) as bigint) as i, p_partkey % cast(across as bigint) as j, cast(across as bigint) as across, cast(floor(n/across) as bigint) as along
        from {part} cross join (select count(*) as n, 20e0*greatest(1e0, floor(sqrt(count(*)/2e3))) as across from {part}) c) r where i < along) q"""
_HALVES = ((("i", "j"), ("i1", "j"), ("i1", "j1")), (("i", "j"), ("i1", "j1"), ("i", "j1")))
_CORNERS = (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz"))


def _tube(i: str, j: str) -> tuple[str, str, str]:
    """A bumpy torus."""
    u, v = f"(2e0*pi()*{i}/along)", f"(2e0*pi()*{j}/across)"
    r = f"(0.4e0 + 0.04e0*sin(5e0*{u} + 3e0*{v}))"
    return f"(1e0 + {r}*cos({v}))*cos({u})", f"(1e0 + {r}*cos({v}))*sin({u})", f"{r}*sin({v})"


def _torus_mesh() -> str:
    def half(k: int) -> str:
        named = [f"{e} as {n}" for names, at in zip(_CORNERS, _HALVES[k], strict=True) for n, e in zip(names, _tube(*at), strict=True)]
        return f"select 2*p_partkey + {k} as fid, {', '.join(named)} from {_QUADS}"

    return f"\n{half(0)} union all\n{half(1)}"


def _torus_vertices() -> str:
    return f"\nselect p_partkey as vid, {', '.join(f'{e} as {c}' for c, e in zip('xyz', _tube('i', 'j'), strict=True))} from {_QUADS}"


def _torus_faces() -> str:
    half = lambda k: f"select 2*p_partkey + {k} as fid, {', '.join(f'{i}*across + {j} as v{n}' for n, (i, j) in enumerate(_HALVES[k]))} from {_QUADS}"
    return f"\n{half(0)} union all\n{half(1)}"


def _cube_mesh() -> str:
    """The cube of half-extent 1/2, every side cut into as many squares as there are parts for, outward."""
    quads = """(select p_partkey, m, cast(floor(p_partkey/(m*m)) as bigint) as side, cast(floor((p_partkey % (m*m))/m) as bigint) as i, p_partkey % m as j,
      cast(floor((p_partkey % (m*m))/m) as bigint) + 1 as i1, p_partkey % m + 1 as j1
      from {part} cross join (select cast(floor(sqrt(count(*)/6e0)) as bigint) as m from {part}) c where p_partkey < 6*m*m) q"""

    def at(i: str, j: str) -> list[str]:
        s, t, w = f"(-0.5e0 + {i}*1e0/m)", f"(-0.5e0 + {j}*1e0/m)", "(CASE WHEN side < 3 THEN -0.5e0 ELSE 0.5e0 END)"
        # The two axes after a side's own, in turn.
        return [f"CASE side % 3 WHEN {k} THEN {w} WHEN {(k + 2) % 3} THEN {s} ELSE {t} END" for k in range(3)]

    def half(k: int) -> str:
        a, b, c = _HALVES[k]
        named = [f"{e} as {n}" for n, e in zip(_CORNERS[0], at(*a), strict=True)]
        for names, one, other in ((_CORNERS[1], b, c), (_CORNERS[2], c, b)):  # sides that face down are turned round
            named += [f"CASE WHEN side < 3 THEN {o} ELSE {e} END as {n}" for n, e, o in zip(names, at(*one), at(*other), strict=True)]
        return f"select 2*p_partkey + {k} as fid, {', '.join(named)} from {quads}"

    return f"\n{half(0)} union all\n{half(1)}"


TEXT = {
    # Unit sphere on a Fibonacci lattice; true distance |q| - 1.
    "cloud_sphere": """
select pid, sin(ph)*cos(th) as x, sin(ph)*sin(th) as y, cos(ph) as z, sin(ph)*cos(th) as nx, sin(ph)*sin(th) as ny, cos(ph) as nz,
       4e0*pi()/n as area, (p_size % 17) = 0 as outlier
from (select p_partkey as pid, p_size, n, acos(1e0 - 2e0*(p_partkey + 0.5e0)/n) as ph,
             2e0*pi()*(p_partkey*0.6180339887498949e0 - floor(p_partkey*0.6180339887498949e0)) as th
      from {part} cross join (select count(*) as n from {part}) c) a""",
    # Torus with radii 1 and 0.4.
    "cloud_torus": """
select pid, (1e0+0.4e0*cos(v))*cos(u) as x, (1e0+0.4e0*cos(v))*sin(u) as y, 0.4e0*sin(v) as z, cos(v)*cos(u) as nx, cos(v)*sin(u) as ny,
       sin(v) as nz, (1e0+0.4e0*cos(v))*0.4e0*4e0*pi()*pi()/n as area, (pid % 23) = 0 as outlier
from (select o_orderkey as pid, n, 2e0*pi()*(o_orderkey + 0.5e0)/n as v,
             2e0*pi()*(o_orderkey*0.6180339887498949e0 - floor(o_orderkey*0.6180339887498949e0)) as u
      from {orders} cross join (select count(*) as n from {orders}) c) a""",
    "coeffs_sphere": "select p_partkey as pid, 0e0 as a00, 0e0 as a10, 0e0 as a01, -0.5e0 as a20, 0e0 as a11, -0.5e0 as a02 from {part}",
    "coeffs_generic": """
select p_partkey as pid, 1e-3*((p_partkey*31) % 19 - 9) as a00, -1e-2*((p_partkey*41) % 29 + 1) as a10, 1e-2*((p_partkey*37) % 23 + 1) as a01,
       -0.3e0 + 1e-2*((p_partkey*53) % 11) as a20, 5e-2*((p_partkey*43) % 7 + 1) as a11, -0.5e0 - 1e-2*((p_partkey*47) % 13) as a02
from {part}""",
    "queries": """
select c_custkey as qid, -1.7e0 + 3.4e0*((c_custkey*7919 + 13) % 10007)/1.0007e4 as x,
       -1.7e0 + 3.4e0*((c_custkey*6101 + 977) % 10009)/1.0009e4 as y, -1.7e0 + 3.4e0*((c_custkey*4447 + 5003) % 10037)/1.0037e4 as z
from {customer}""",
    "queries_few": """
select s_suppkey as qid, -1.7e0 + 3.4e0*((s_suppkey*7919 + 13) % 10007)/1.0007e4 as x,
       -1.7e0 + 3.4e0*((s_suppkey*6101 + 977) % 10009)/1.0009e4 as y, -1.7e0 + 3.4e0*((s_suppkey*4447 + 5003) % 10037)/1.0037e4 as z
from {supplier}""",
    # Cube of half-extent 1/2, outward triangles.
    "mesh_cube": """
select fid, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by_, b.z as bz, c.x as cx, c.y as cy, c.z as cz
from (values (0,0,2,1),(1,0,3,2),(2,4,5,6),(3,4,6,7),(4,0,1,5),(5,0,5,4),(6,3,7,6),(7,3,6,2),(8,0,4,7),(9,0,7,3),(10,1,2,6),(11,1,6,5)) f(fid,i,j,k)
join (values (0,-0.5e0,-0.5e0,-0.5e0),(1,0.5e0,-0.5e0,-0.5e0),(2,0.5e0,0.5e0,-0.5e0),(3,-0.5e0,0.5e0,-0.5e0),
             (4,-0.5e0,-0.5e0,0.5e0),(5,0.5e0,-0.5e0,0.5e0),(6,0.5e0,0.5e0,0.5e0),(7,-0.5e0,0.5e0,0.5e0)) a(vid,x,y,z) on a.vid=i
join (values (0,-0.5e0,-0.5e0,-0.5e0),(1,0.5e0,-0.5e0,-0.5e0),(2,0.5e0,0.5e0,-0.5e0),(3,-0.5e0,0.5e0,-0.5e0),
             (4,-0.5e0,-0.5e0,0.5e0),(5,0.5e0,-0.5e0,0.5e0),(6,0.5e0,0.5e0,0.5e0),(7,-0.5e0,0.5e0,0.5e0)) b(vid,x,y,z) on b.vid=j
join (values (0,-0.5e0,-0.5e0,-0.5e0),(1,0.5e0,-0.5e0,-0.5e0),(2,0.5e0,0.5e0,-0.5e0),(3,-0.5e0,0.5e0,-0.5e0),
             (4,-0.5e0,-0.5e0,0.5e0),(5,0.5e0,-0.5e0,0.5e0),(6,0.5e0,0.5e0,0.5e0),(7,-0.5e0,0.5e0,0.5e0)) c(vid,x,y,z) on c.vid=k""",
    # Closed and outward, some 2 triangles a part.
    "mesh_torus": _torus_mesh(),
    "torus_vertices": _torus_vertices(),
    "torus_faces": _torus_faces(),
    "mesh_fine_cube": _cube_mesh(),
    # Nodes of a cubic grid, as many a side as there are parts for, with the distance from a sphere that is bent along x.
    "grid_nodes": """
select pid, n, i, j, k, x, y, z, sqrt(x*x + y*y + z*z) - 1.03e0 - 0.2e0*sin(3e0*x) as v
from (select p_partkey as pid, n, i, j, k, -1.5e0 + 3e0*i/(n - 1) as x, -1.5e0 + 3e0*j/(n - 1) as y, -1.5e0 + 3e0*k/(n - 1) as z
      from (select p_partkey, n, cast(floor(p_partkey/(n*n)) as bigint) as i, cast(floor(p_partkey/n) as bigint) % n as j, p_partkey % n as k
            from {part} cross join (select cast(floor(power(count(*) + 0.5e0, 1e0/3e0)) as bigint) as n from {part}) c where p_partkey < n*n*n) a) b""",
    "rays": """
select rid, ox, oy, oz, (tx-ox)/l as dx, (ty-oy)/l as dy, (tz-oz)/l as dz
from (select *, sqrt((tx-ox)*(tx-ox)+(ty-oy)*(ty-oy)+(tz-oz)*(tz-oz)) as l
      from (select s_suppkey as rid, 3e0*cos(s_suppkey*0.7e0)*sin(1e0+s_suppkey*0.3e0) as ox, 3e0*sin(s_suppkey*0.7e0)*sin(1e0+s_suppkey*0.3e0) as oy,
                   3e0*cos(1e0+s_suppkey*0.3e0) as oz, 0.9e0*sin(s_suppkey*1.3e0) as tx, 0.8e0*cos(s_suppkey*1.7e0) as ty, 0.2e0 as tz from {supplier}) a) b""",
    "grid2d": """
select event_id as qid, -1.21e0 + 2.4e0*(event_id % 100)/99e0 as x, -1.19e0 + 2.4e0*(cast(floor(event_id/1e2) as bigint) % 100)/99e0 as y,
       -0.7e0 + 1.4e0*((event_id * 37) % 101)/1.01e2 as z
from {events}""",
}


def sql(name: str) -> str:
    """The fixture as a parenthesised query over the plain table names."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", TEXT[name]) + ")"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", TEXT[name]))}
    return spark.sql(TEXT[name], **tables)
