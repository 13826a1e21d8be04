"""The jobs as queries over the given tables: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import clean_cloud, probe_stream
from jobs.common import config, derived_sql
from pointfield.functions import torus
from pointfield.functions.expr import Program, vec
from pointfield.operators import fields
from pointfield.operators.fields import Evaluation
from pointfield.plans import catalog  # noqa: F401  (first: the modules below register with it)
from pointfield.plans.field_queries import field_sql, pairs_sql, rounded_frame
from pointfield.plans.session import scratch_dir

CLEAN, PROBE = config("clean_cloud.json"), config("probe_stream.json")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        points = clean_cloud.run(spark, f"{sf_dir}/part.parquet", out, CLEAN)
    return rounded_frame(points)


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe with the totals of its day."""
    out = _folder(spark, "job2")
    for _ in range(2):
        found = probe_stream.run(spark, f"{sf_dir}/part.parquet", f"{sf_dir}/events.parquet", out, PROBE)
    return rounded_frame(found.drop("batch").join(probe_stream.daily(spark, out), "day"))


def _clean_sql() -> str:
    cloud = derived_sql("part", CLEAN["derive"])
    near = pairs_sql("(SELECT pid AS i, x, y, z, nx AS inx, ny AS iny, nz AS inz FROM alone)", "(SELECT pid, x, y, z, nx, ny, nz FROM alone)", CLEAN["neighbours"] + 1, q="i")
    r = lambda c: f"(round({c}, 6) + 0e0) AS {c}"
    return f"""
WITH cloud AS MATERIALIZED (SELECT pid, x, y, z, nx, ny, nz, pid > min(pid) OVER (PARTITION BY x, y, z) AS again FROM {cloud}),
alone AS MATERIALIZED (SELECT * FROM cloud WHERE NOT again),
hood AS MATERIALIZED (SELECT i, avg(d) AS spacing, avg(CASE WHEN inx*nx + iny*ny + inz*nz > 0e0 THEN 1e0 ELSE 0e0 END) AS same_side FROM {near} WHERE i <> pid GROUP BY i),
judged AS (SELECT c.*, h.spacing, h.same_side, CASE WHEN again THEN 'duplicate'
                  WHEN spacing > (SELECT avg(spacing) + {CLEAN['spread']!r}e0 * stddev_pop(spacing) FROM hood) THEN 'outlier'
                  WHEN same_side < {CLEAN['same_side']!r}e0 THEN 'turned' ELSE 'kept' END AS verdict
           FROM cloud c LEFT JOIN hood h ON h.i = c.pid)
SELECT pid, {', '.join(map(r, 'xyz'))}, {', '.join(f"(round(CASE WHEN verdict = 'turned' THEN -{c} ELSE {c} END, 6) + 0e0) AS {c}" for c in ('nx', 'ny', 'nz'))},
       {r('spacing')}, {r('same_side')}, verdict, CAST(floor(z / {CLEAN['slab']!r}e0) AS INTEGER) AS slab
FROM judged"""


def _probe_sql() -> str:
    how = Evaluation(k=PROBE["k"])
    tori = Program(**torus.fit(vec(""), vec("n"), torus.coefficients())).sql(derived_sql("part", PROBE["cloud"]), *probe_stream.CLOUD)
    probes = f"(SELECT qid, x, y, z, day FROM {derived_sql('events', PROBE['probes'])})"
    found = field_sql(how, tori, f"(SELECT qid, x, y, z FROM {probes})", fields.terms(how, True), fields.results(how, True), tuple(probe_stream.VALUES))
    r = lambda c: f"(round({c}, 6) + 0e0) AS {c}"
    verdict = f"CASE WHEN distance IS NULL THEN 'unknown' WHEN abs(distance) <= {PROBE['near']!r}e0 THEN 'near' WHEN distance < 0e0 THEN 'inside' ELSE 'outside' END"
    said = lambda v: f"sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) OVER (PARTITION BY day)"
    return f"""
WITH found AS MATERIALIZED ({found}), j AS (SELECT p.qid, p.x, p.y, p.z, p.day, f.distance, f.gx, f.gy, f.gz, {verdict} AS verdict FROM {probes} p LEFT JOIN found f ON f.qid = p.qid)
SELECT qid, {', '.join(map(r, (*'xyz', *probe_stream.VALUES)))}, verdict, day, count(*) OVER (PARTITION BY day) AS probes,
       {', '.join(f'CAST({said(v)} AS BIGINT) AS {v}' for v in ('inside', 'near', 'outside'))},
       min(distance) OVER (PARTITION BY day) AS least, max(distance) OVER (PARTITION BY day) AS most
FROM j"""


QUERIES = {"job1_clean_cloud": clean, "job2_probe_stream": probe}
SQL = {"job1_clean_cloud": _clean_sql(), "job2_probe_stream": _probe_sql()}
