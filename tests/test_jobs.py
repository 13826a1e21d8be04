"""The two jobs: against SQL, against plain Python, over growing input, and run again after a cut."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from jobs import clean_cloud, probe_stream, queries
from jobs.common import config

from .conftest import SF


def shaped(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    before = spark.conf.getAll
    df = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert shaped(map(tuple, df.collect()), df.columns) == shaped(want.fetchall(), names)
    assert spark.conf.getAll == before


# Cleaning.

PLAIN = {"derive": [], "neighbours": 3, "spread": 2.0, "same_side": 0.5, "slab": 0.5}
CLOUD = "pid bigint, x double, y double, z double, nx double, ny double, nz double, verdict string, i int, d double"


def plane(n=8):
    """A grid in the plane, normals up, with a far point, a turned one, a repeated place and incomplete rows."""
    rows = [(i * n + j, float(i), float(j), 0.0, 0.0, 0.0, 1.0) for i in range(n) for j in range(n)]
    rows[27] = (*rows[27][:4], 0.0, 0.0, -1.0)
    rows += [(500, 100.0, 100.0, 0.0, 0.0, 0.0, 1.0), (501, 3.0, 3.0, 0.0, 0.0, 0.0, 1.0), (9, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    rows += [(600, None, 1.0, 1.0, 0.0, 0.0, 1.0), (601, 1.0, math.nan, 1.0, 0.0, 0.0, 1.0), (None, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0), (602, 1.0, 1.0, 1.0, None, 0.0, 1.0)]
    return [(*r, "clash", 1, 2.0) for r in rows]


def expected(rows, conf):
    sound = [r for r in rows if r[0] is not None and not any(v is None or math.isnan(v) for v in r[1:7])]
    first = {}
    for r in sound:
        first[r[1:4]] = min(r[0], first.get(r[1:4], r[0]))
    alone = {r[0]: r for r in sound if first[r[1:4]] == r[0]}
    at, up = np.array([r[1:4] for r in alone.values()]), np.array([r[4:7] for r in alone.values()])
    spacing, same = {}, {}
    for k, (pid, r) in enumerate(alone.items()):
        d = np.sqrt(((at - at[k]) ** 2).sum(1))
        near = [j for _, _, j in sorted((d[j], p, j) for j, p in enumerate(alone))][: conf["neighbours"] + 1]
        near = [j for j in near if j != k]
        spacing[pid] = d[near].mean()
        same[pid] = (up[near] @ up[k] > 0).mean()
    s = np.array(list(spacing.values()))
    limit = s.mean() + conf["spread"] * s.std()
    out = []
    for r in rows:
        if r not in sound:
            out.append((r[0], "incomplete"))
        elif first[r[1:4]] != r[0]:
            out.append((r[0], "duplicate"))
        else:
            out.append((r[0], "outlier" if spacing[r[0]] > limit else "turned" if same[r[0]] < conf["same_side"] else "kept"))
    return sorted(out, key=repr)


def test_cleaning_equals_brute_force_on_odd_rows(spark, tmp_path):
    rows = plane()
    spark.createDataFrame(rows, CLOUD).write.parquet(f"{tmp_path}/cloud")
    got = clean_cloud.run(spark, f"{tmp_path}/cloud", f"{tmp_path}/out", PLAIN).collect()
    assert sorted(((r.pid, r.verdict) for r in got), key=repr) == expected(rows, PLAIN)
    by = {r.pid: r for r in got}
    assert by[27].verdict == "turned" and by[27].nz == 1.0 and by[500].verdict == "outlier" and by[501].verdict == "duplicate"
    counts = spark.read.json(f"{tmp_path}/out/counts").groupBy("verdict").sum("points").collect()
    assert {r[0]: r[1] for r in counts} == {v: sum(r.verdict == v for r in got) for v in {r.verdict for r in got}}


def test_cleaning_again_and_on_a_smaller_table(spark, tmp_path):
    rows = plane()
    spark.createDataFrame(rows, CLOUD).write.parquet(f"{tmp_path}/cloud")
    run = lambda: sorted(map(repr, clean_cloud.run(spark, f"{tmp_path}/cloud", f"{tmp_path}/out", PLAIN).collect()))
    assert run() == run()
    fewer = rows[:64]
    spark.createDataFrame(fewer, CLOUD).write.mode("overwrite").parquet(f"{tmp_path}/cloud")
    got = clean_cloud.run(spark, f"{tmp_path}/cloud", f"{tmp_path}/out", PLAIN).collect()
    assert sorted(((r.pid, r.verdict) for r in got), key=repr) == expected(fewer, PLAIN)
    assert not {r.verdict for r in got} & {"duplicate", "incomplete"}  # what is no longer there has no partition left
    spark.createDataFrame([], CLOUD).write.mode("overwrite").parquet(f"{tmp_path}/cloud")
    assert clean_cloud.run(spark, f"{tmp_path}/cloud", f"{tmp_path}/out", PLAIN).count() == 0


# Streaming.


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def rows_of(df):
    return {tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.drop("batch").collect()}


def test_two_runs_over_growing_input(spark, tmp_path):
    """What one run over everything gives, two runs give, each taking only what is new; days that both touch are added up."""
    conf = config("probe_stream.json")
    part, late = f"{SF}/part.parquet", "event_id % 3 = 0"
    all_, grow = f"{tmp_path}/all", f"{tmp_path}/grow"
    events(spark).write.parquet(all_)
    events(spark).where(f"NOT {late}").coalesce(2).write.parquet(grow)
    want = probe_stream.run(spark, part, all_, f"{tmp_path}/out_all", conf)
    first = probe_stream.run(spark, part, grow, f"{tmp_path}/out", conf)
    assert first.count() == events(spark).where(f"NOT {late}").count()
    files = {f: os.path.getmtime(f) for f in data_files(tmp_path / "out" / "distances")}
    events(spark).where(late).coalesce(1).write.mode("append").parquet(grow)
    second = probe_stream.run(spark, part, grow, f"{tmp_path}/out", conf)
    assert rows_of(second) == rows_of(want) and second.count() == events(spark).count()
    assert {r.batch for r in second.select("batch").distinct().collect()} == {0, 1}
    assert second.where("batch = 1").count() == events(spark).where(late).count()
    assert all(os.path.getmtime(f) == t for f, t in files.items())  # what was written stands
    assert rows_of(probe_stream.daily(spark, f"{tmp_path}/out")) == rows_of(probe_stream.daily(spark, f"{tmp_path}/out_all"))
    files = data_files(tmp_path / "out" / "distances")
    assert rows_of(probe_stream.run(spark, part, grow, f"{tmp_path}/out", conf)) == rows_of(want)  # nothing new
    assert data_files(tmp_path / "out" / "distances") == files


def data_files(folder):
    return sorted(f for f in map(str, folder.rglob("*.parquet")))


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    conf = config("probe_stream.json")
    part, grow = f"{SF}/part.parquet", f"{tmp_path}/grow"
    events(spark).write.parquet(grow)
    first = rows_of(probe_stream.run(spark, part, grow, f"{tmp_path}/out", conf))
    days = rows_of(probe_stream.daily(spark, f"{tmp_path}/out"))
    for f in os.listdir(tmp_path / "out" / "checkpoint" / "commits"):  # as if the run had been cut off before it said so
        os.remove(tmp_path / "out" / "checkpoint" / "commits" / f)
    again = probe_stream.run(spark, part, grow, f"{tmp_path}/out", conf)
    assert rows_of(again) == first and again.count() == events(spark).count()
    assert rows_of(probe_stream.daily(spark, f"{tmp_path}/out")) == days


def test_probes_without_place_or_day_and_empty_files(spark, tmp_path):
    conf = config("probe_stream.json") | {"probes": []}
    kinds = "qid bigint, x double, y double, z double, day string, distance double, batch string"
    odd = [(1, None, 0.0, 0.0, "2024-01-01", 9.0, "b"), (2, 0.1, 0.1, 0.1, None, 9.0, "b"), (3, 3.0, 0.0, 0.0, "2024-01-01", 9.0, "b")]
    spark.createDataFrame([], kinds).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert probe_stream.run(spark, f"{SF}/part.parquet", f"{tmp_path}/in", f"{tmp_path}/out", conf).count() == 0
    spark.createDataFrame(odd, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.qid: r for r in probe_stream.run(spark, f"{SF}/part.parquet", f"{tmp_path}/in", f"{tmp_path}/out", conf).collect()}
    assert (got[1].distance, got[1].verdict, got[2].verdict, got[2].day, got[3].verdict) == (None, "unknown", "inside", "none", "outside")
    assert abs(got[3].distance - 2) < 0.2


def test_command_line(tmp_path):
    """In a session of its own, on a copy of the tables."""
    shutil.copy(f"{SF}/part.parquet", tmp_path / "part.parquet")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.clean_cloud", "--cloud", f"{tmp_path}/part.parquet", "--out", f"{tmp_path}/out"], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "200 points" in done.stderr
    assert {p.name for p in (tmp_path / "out" / "points").iterdir() if p.is_dir()} >= {"verdict=kept", "verdict=duplicate"}
