"""Vectors of any length, dotted runs of any length, streams whose state stays small."""

from __future__ import annotations

import datetime
import random
import shutil

import duckdb
import pytest

from tests.test_catalog import DATA, TABLES, canonical
from tidemill.operators.sentences import sentences_of
from tidemill.plans import catalog
from tidemill.streaming import ingest

BY_LENGTH = ["latent_geometry", "layer_mean_pool", "topk_delta_corr", "counterfactual_metrics", "perturbed_summary", "reconstruction_self_consistency"]


@pytest.fixture(scope="module", params=[3, 65])
def folder(request, spark, tmp_path_factory):
    where = tmp_path_factory.mktemp(f"vectors{request.param}")
    for t in TABLES:
        if t != "embeddings":
            shutil.copy(f"{DATA}/{t}.parquet", where / f"{t}.parquet")
    rng = random.Random(request.param)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(request.param)], i % 3) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(str(where / "embeddings.parquet"))
    return request.param, str(where)


@pytest.mark.parametrize("name", BY_LENGTH)
def test_queries_read_every_component(spark, folder, name):
    length, where = folder
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet{'/*.parquet' if t == 'embeddings' else ''}')")
    df = catalog.queries()[name](spark, where)
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)
    if name == "layer_mean_pool":
        assert df.selectExpr("max(i)").first()[0] == length


def test_rows_of_initials_of_any_length_end_no_sentence():
    for n in (20, 36, 400):
        run = "a." * n
        assert sentences_of(f"See {run} then go. Now stop.") == [f"See {run} then go.", "Now stop."]
    assert sentences_of(("x" * 200 + ".") + " next.") == ["x" * 200 + ".", "next."]


def test_state_of_a_stream_does_not_grow(spark, tmp_path):
    start, want = datetime.datetime(2024, 1, 1), {}
    for day in range(10):
        rows = [(i, start + datetime.timedelta(days=day, minutes=i), "ab"[i % 2]) for i in range(40)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(str(tmp_path / f"day{day}"))
        for file in (tmp_path / f"day{day}").glob("*.parquet"):
            file.rename(tmp_path / f"events{day}.parquet")
        want |= {(start + datetime.timedelta(days=day), kind): 20 for kind in "ab"}
    seen = []
    schema = spark.read.parquet(str(tmp_path / "events0.parquet")).schema
    counted = ingest.windowed_counts(spark, str(tmp_path), schema, "events*.parquet", "ts", "event_type", "1 day", "1 hour", 1, lambda q: seen.extend(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators))
    assert {(r["begin"], r["event_type"]): r["n"] for r in counted.collect()} == want
    assert len(seen) >= 10 and max(seen[3:]) <= 6
