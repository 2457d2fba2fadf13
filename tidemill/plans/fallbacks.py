"""Pages that find their document by one name after the other; vectors moved on by a matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import dynamics, waterfall
from ..sources.tables import table

_PATH = r"^[a-z]+://[^/]+/"


def _paths(spark, sf_dir):
    """A page's path as it stands, without query and fragment, then its number under any language."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", _PATH, "").alias("whole"))
    pages = pages.withColumn("bare", F.regexp_extract("whole", "^[^?#]*", 0)).withColumn("number", F.concat(F.lit("any/"), F.regexp_extract("bare", "([0-9]+)$", 1)))
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.concat_ws("/", "lang", F.col("doc_id").cast("string")), F.concat(F.lit("any/"), F.col("doc_id").cast("string")))).alias("name"))
    return waterfall.waterfall_join(pages, ["whole", "bare", "number"], names, "name").select("page_id", "matched_by", "doc_id")


_PATHS_ORACLE = """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS whole FROM pages), b AS (SELECT *, regexp_extract(whole, '^[^?#]*') AS bare FROM p),
  k AS (SELECT page_id, 1 AS r, 'whole' AS matched_by, whole AS name FROM b UNION ALL SELECT page_id, 2, 'bare', bare FROM b UNION ALL SELECT page_id, 3, 'number', 'any/' || regexp_extract(bare, '([0-9]+)$', 1) FROM b),
  n AS (SELECT doc_id, lang || '/' || CAST(doc_id AS VARCHAR) AS name FROM documents UNION ALL SELECT doc_id, 'any/' || CAST(doc_id AS VARCHAR) FROM documents),
  m AS (SELECT page_id, matched_by, doc_id, row_number() OVER (PARTITION BY page_id ORDER BY r, doc_id) AS place FROM k JOIN n USING (name))
  SELECT p.page_id, matched_by, doc_id FROM p LEFT JOIN m ON m.page_id = p.page_id AND place = 1"""


def _law(size):
    """0.9 on the diagonal, 0.05 to its right, -0.02 to its left (round the corner), and 0.01 besides."""
    one = np.eye(size)
    return 0.9 * one + 0.05 * np.roll(one, 1, axis=1) - 0.02 * np.roll(one, -1, axis=1), np.full(size, 0.01)


def _rollout(spark, sf_dir):
    """Vectors of 64 components: three matrix steps, and one four-stage step of half a unit of time."""
    rows, (matrix, bias) = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _law(64)
    far = dynamics.linear_rollout(rows, ["vec_id"], "embedding", matrix, bias, 3).withColumnRenamed("embedding", "far")
    flow = dynamics.linear_flow(rows, ["vec_id"], "embedding", matrix, bias, 0.5, 1).withColumnRenamed("embedding", "flow")
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda n, x: n + x), 6)
    return far.join(flow, "vec_id").select("vec_id", total("far").alias("far"), total("flow").alias("flow"), F.round(F.get("far", F.lit(0)), 8).alias("far_first"), F.round(F.get("flow", F.lit(63)), 8).alias("flow_last"))


def _stepped(z):
    return f"list_transform(range(1, 65), lambda i: 0.9::DOUBLE * {z}[i] + 0.05::DOUBLE * {z}[i % 64 + 1] - 0.02::DOUBLE * {z}[(i + 62) % 64 + 1] + 0.01::DOUBLE)"


def _plus(z, k, h):
    return f"list_transform(range(1, 65), lambda i: {z}[i] + {h}::DOUBLE * {k}[i])"


_ROLLOUT_ORACLE = f"""WITH z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings WHERE len(embedding) = 64), a AS (SELECT vec_id, z, {_stepped("z")} AS k1 FROM z), b AS (SELECT *, {_stepped("k1")} AS s2, {_plus("z", "k1", 0.25)} AS y2 FROM a), c AS (SELECT *, {_stepped("s2")} AS s3, {_stepped("y2")} AS k2 FROM b),
  d AS (SELECT *, {_plus("z", "k2", 0.25)} AS y3 FROM c), e AS (SELECT *, {_stepped("y3")} AS k3 FROM d), f AS (SELECT *, {_plus("z", "k3", 0.5)} AS y4 FROM e), g AS (SELECT *, {_stepped("y4")} AS k4 FROM f),
  w AS (SELECT vec_id, s3 AS far, list_transform(range(1, 65), lambda i: z[i] + 0.5::DOUBLE / 6 * (k1[i] + 2 * k2[i] + 2 * k3[i] + k4[i])) AS flow FROM g)
  SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: far[i] * i)), 6) AS far, round(list_sum(list_transform(range(1, 65), lambda i: flow[i] * i)), 6) AS flow, round(far[1], 8) AS far_first, round(flow[64], 8) AS flow_last FROM w"""

QUERIES = {"page_path_fallback": (_paths, _PATHS_ORACLE), "matrix_rollout": (_rollout, _ROLLOUT_ORACLE)}
