"""One query per operator over the grids of the driver's tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import components, contingency, distance, evaluation, graph, morphology, pointwise, relabel, resample, stats, stencil, stitching, views, watershed
from voxmill.plans import grids
from voxmill.plans.durable import materialize
from voxmill.volume import Volume, grid, write_masked

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_G2 = "g AS (SELECT vec_id AS y, CAST(unnest(range(64)) AS BIGINT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"
_LAB = _G2 + ", l AS (SELECT y, x, v, CAST(floor((v + 0.6) * 8) AS BIGINT) AS a, CAST(floor((v + 0.6) * 4) AS BIGINT) + label % 2 AS b FROM g)"
_M = _G2 + ", m AS (SELECT *, (y BETWEEN 10 AND 299 AND x BETWEEN 5 AND 39) AS inside FROM g)"
_G3 = "g AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS z, l_suppkey AS y, CAST(CAST(l_quantity AS INT) - 1 AS BIGINT) AS x, count(*) AS v FROM lineitem GROUP BY ALL)"
_GE = "g AS (SELECT user_id AS y, CAST(day(ts) - 1 AS BIGINT) AS x, count(*) AS v FROM events GROUP BY ALL)"
_P = _LAB + ", p AS (SELECT a AS label_a, b AS label_b, count(*) AS c FROM l GROUP BY ALL), q AS (SELECT *, CAST(sum(c) OVER (PARTITION BY label_a) AS BIGINT) AS sa, CAST(sum(c) OVER (PARTITION BY label_b) AS BIGINT) AS sb FROM p)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = "WITH RECURSIVE " + sql if sql.lstrip().startswith(("g AS", "l AS")) else sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to six places; zero has no sign."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"round({expr}, 6) + CAST(0 AS DOUBLE)"


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else r6(c).alias(c) for c in df.columns])


def img(s, d):
    return grids.image(s, d)


# -- grids, views and copies --------------------------------------------------------------------

query(f"{_G2} SELECT y, x, v FROM g", "grid2d")(lambda s, d: img(s, d).df)
query(f"{_G3} SELECT z, y, x, v FROM g", "grid3d")(lambda s, d: grids.volume3d(s, d).df)
query(f"{_GE} SELECT y, x, v FROM g", "grid_events")(lambda s, d: grids.events_grid(s, d).df)
query(f"{_G2} SELECT y - 20 AS y, x - 10 AS x, v FROM g WHERE y >= 20 AND y < 200 AND x >= 10 AND x < 54", "roi")(lambda s, d: views.roi(img(s, d), (slice(20, 200), slice(10, -10))).df)
query(f"{_G2} SELECT y AS axis0, v FROM g WHERE x = 63", "roi_squeeze")(lambda s, d: img(s, d)[:, -1].df)
query(f"{_G2}, n AS (SELECT max(y) + 1 AS h FROM g) SELECT i AS y, j AS x, coalesce(g.v, 0.0::DOUBLE) AS v FROM (SELECT CAST(unnest(range(h + 3)) AS BIGINT) AS i FROM n) a CROSS JOIN (SELECT CAST(unnest(range(69)) AS BIGINT) AS j) b LEFT JOIN g ON g.y = i AND g.x = j", "pad")(lambda s, d: views.pad(img(s, d), (3, 5)).df)
query(f"{_G2}, n AS (SELECT max(y) AS h FROM g) SELECT i AS y, j AS x, g.v FROM (SELECT CAST(unnest(range(h + 4)) AS BIGINT) AS i FROM n) a CROSS JOIN (SELECT CAST(unnest(range(69)) AS BIGINT) AS j) b, n JOIN g ON TRUE WHERE g.y = least(i, n.h) AND g.x = least(j, 63)", "pad_edge")(lambda s, d: views.pad(img(s, d), (3, 5), mode="edge").df)
query(f"{_G2} SELECT CAST(0 AS BIGINT) AS z, y, x, v FROM g", "expand_dims")(lambda s, d: views.expand_dims(img(s, d), 0).df)
query(f"{_G2} SELECT y, x, CAST(v AS FLOAT) AS v FROM g", "copy_cast")(lambda s, d: pointwise.copy(img(s, d), dtype="float32").df)
query(f"{_M} SELECT y, x, CASE WHEN inside THEN v ELSE 0 END AS v FROM m", "copy_masked")(lambda s, d: pointwise.copy(img(s, d), mask=grids.mask(s, d)).df)
query(f"{_G2} SELECT y, x, v > 0.1 AS v FROM g", "threshold")(lambda s, d: views.threshold(img(s, d), 0.1).df)
query(f"{_G2}, b AS (SELECT *, y // 50 AS i, x // 16 AS j FROM g) SELECT y, x, {s6('(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-6)')} AS v FROM b WINDOW w AS (PARTITION BY i, j)", "normalize_block")(lambda s, d: rounded(views.normalize(img(s, d), "float64", (50, 16)).df, "y", "x"))
query(f"{_G2} SELECT y, x, {s6('v * 2 + 1')} AS v FROM g", "simple_transformation")(lambda s, d: rounded(views.transform(img(s, d), lambda v: v * 2 + 1).df, "y", "x"))
query(f"{_G2} SELECT y, x, {s6('v + y * 0.5 - x')} AS v FROM g", "coordinate_transformation")(lambda s, d: rounded(views.transform_with_coordinates(img(s, d), lambda v, y, x: v + y * 0.5 - x).df, "y", "x"))
query(f"{_LAB} SELECT y, x, a * 10 + b AS v FROM l", "multi_transformation")(lambda s, d: views.transform_many(lambda a, b: a * 10 + b, grids.labels_a(s, d), grids.labels_b(s, d)).df)

# -- reductions -----------------------------------------------------------------------------------


def _stat(name: str):
    cols = {"stats_max": ["max"], "stats_min": ["min"], "stats_min_max": ["min", "max"], "stats_mean_std": ["mean", "std"], "stats_mean": ["mean"], "stats_std": ["std"]}[name]
    sql = {"max": "max(v)", "min": "min(v)", "mean": "avg(v)", "std": "stddev_pop(v)"}
    what = ", ".join(f"{s6(sql[c])} AS {c}" for c in cols)
    query(f"{_G2} SELECT {what} FROM g", name)(lambda s, d: rounded(stats.summary(img(s, d)).select(*cols)))
    query(f"{_M} SELECT {what} FROM m WHERE inside", name + "_masked")(lambda s, d: rounded(stats.summary(img(s, d), grids.mask(s, d)).select(*cols)))


for _n in ("stats_max", "stats_min", "stats_min_max", "stats_mean_std", "stats_mean", "stats_std"):
    _stat(_n)
query(f"{_LAB} SELECT DISTINCT a AS v FROM l", "unique")(lambda s, d: stats.unique(grids.labels_a(s, d)))
query(f"{_LAB} SELECT a AS v, count(*) AS count FROM l GROUP BY a", "unique_counts")(lambda s, d: stats.unique(grids.labels_a(s, d), True))
query(f"{_LAB} SELECT a AS v, count(*) AS count FROM l WHERE y BETWEEN 10 AND 299 AND x BETWEEN 5 AND 39 GROUP BY a", "unique_masked")(lambda s, d: stats.unique(grids.labels_a(s, d), True, grids.mask(s, d)))

# -- pointwise --------------------------------------------------------------------------------------


def _op(name: str, sql: str, exact: bool = False):
    def run(s, d):
        g = img(s, d)
        out = pointwise.apply_operation(g, 0.25, name).df
        return out if exact else rounded(out, "y", "x")

    query(f"{_G2} SELECT y, x, {sql if exact else s6(sql)} AS v FROM g", "op_" + name)(run)


for _n, _s in (("add", "v + 0.25"), ("subtract", "v - 0.25"), ("multiply", "v * 0.25"), ("divide", "v / 0.25"), ("minimum", "least(v, 0.25)"), ("maximum", "greatest(v, 0.25)")):
    _op(_n, _s)
for _n, _s in (("greater", "v > 0.25"), ("greater_equal", "v >= 0.25"), ("less", "v < 0.25"), ("less_equal", "v <= 0.25"), ("equal", "v = 0.25"), ("not_equal", "v <> 0.25")):
    _op(_n, _s, True)
query(f"{_LAB} SELECT y, x, a + b AS v FROM l", "op_array_array")(lambda s, d: pointwise.add(grids.labels_a(s, d), grids.labels_b(s, d)).df)
query(f"{_LAB} SELECT y, x, ((a * 100 % 256) + 256) % 256 AS v FROM l", "op_wrap")(lambda s, d: pointwise.multiply(pointwise.copy(grids.labels_a(s, d), dtype="uint8"), 100).df.withColumn("v", F.col("v").cast("bigint")))
query(f"{_G2} SELECT g.y, g.x, {s6('g.v - f.v')} AS v FROM g JOIN g f ON f.y = 0 AND f.x = g.x", "op_broadcast")(lambda s, d: rounded(pointwise.subtract(img(s, d), img(s, d)[0:1]).df, "y", "x"))
query(f"{_M} SELECT y, x, {s6('CASE WHEN inside THEN v + 1 ELSE 0 END')} AS v FROM m", "op_masked")(lambda s, d: rounded(pointwise.add(img(s, d), 1.0, mask=grids.mask(s, d)).df, "y", "x"))
query(f"{_G2} SELECT y, x, {s6('exp(v)')} AS v FROM g", "op_unary_exp")(lambda s, d: rounded(pointwise.apply_operation(img(s, d), None, "exp").df, "y", "x"))
query(f"{_G2} SELECT y, x, {s6('v * v - 0.5')} AS v FROM g", "op_callable")(lambda s, d: rounded(pointwise.apply_operation(img(s, d), 0.5, lambda a, b: a * a - b).df, "y", "x"))
query(f"{_LAB} SELECT y, x, a IN (1, 3, 5, 7) AS v FROM l", "isin")(lambda s, d: pointwise.isin(grids.labels_a(s, d), [1, 3, 5, 7]).df)

# -- contingency and metrics --------------------------------------------------------------------------


def table(s, d):
    return contingency.contingency_table(grids.labels_a(s, d), grids.labels_b(s, d))


query(f"{_P} SELECT label_a, label_b, c AS count FROM p", "contingency")(lambda s, d: table(s, d).pairs)
query(f"{_P} SELECT label_a, label_b, c AS count FROM p WHERE label_a <> 4 AND label_b NOT IN (1, 3)", "contingency_drop_ignore")(lambda s, d: table(s, d).drop_ignore([4], [1, 3]).pairs)
query(f"{_LAB} SELECT a AS label_a, b AS label_b, count(*) AS count FROM l WHERE y BETWEEN 10 AND 299 AND x BETWEEN 5 AND 39 GROUP BY ALL", "contingency_masked")(lambda s, d: contingency.contingency_table(grids.labels_a(s, d), grids.labels_b(s, d), grids.mask(s, d)).pairs)
query(f"{_P} SELECT DISTINCT label_a AS label, sa AS size FROM q", "contingency_marginal")(lambda s, d: table(s, d).sizes_a)

_VI = _P + """, n AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM p), h AS (SELECT
 (SELECT -sum(s / n * log2(s / n)) FROM (SELECT DISTINCT label_a, sa AS s FROM q), n) AS ha,
 (SELECT -sum(s / n * log2(s / n)) FROM (SELECT DISTINCT label_b, sb AS s FROM q), n) AS hb,
 (SELECT -sum(c / n * log2(c / n)) FROM p, n) AS hab),
 vi AS (SELECT hab - hb AS vi_split, hab - ha AS vi_merge FROM h),
 sq AS (SELECT (SELECT sum(CAST(c AS DOUBLE) * c) FROM p) AS c2, (SELECT sum(CAST(s AS DOUBLE) * s) FROM (SELECT DISTINCT label_a, sa AS s FROM q)) AS a2, (SELECT sum(CAST(s AS DOUBLE) * s) FROM (SELECT DISTINCT label_b, sb AS s FROM q)) AS b2, n FROM n),
 ra AS (SELECT 1 - 2 * (c2 / a2) * (c2 / b2) / (c2 / a2 + c2 / b2) AS adapted_rand_error, 1 - (a2 + b2 - 2 * c2) / (n * n) AS rand_index FROM sq)"""
query(f"{_VI} SELECT {s6('vi_split')} AS vi_split, {s6('vi_merge')} AS vi_merge FROM vi", "vi")(lambda s, d: rounded(evaluation.vi_scores(table(s, d))))
query(f"{_VI} SELECT {s6('adapted_rand_error')} AS adapted_rand_error, {s6('rand_index')} AS rand_index FROM ra", "rand")(lambda s, d: rounded(evaluation.rand_scores(table(s, d))))
query(f"{_VI} SELECT {s6('sqrt(adapted_rand_error * (vi_split + vi_merge))')} AS cremi FROM vi, ra", "cremi")(lambda s, d: rounded(evaluation.cremi_scores(table(s, d)).select("cremi")))
query(f"{_P} SELECT label_b AS label, {s6('sum(-(c / sb) * log2(c / sa))')} AS vi_split, {s6('sum(-(c / sb) * log2(c / sb))')} AS vi_merge FROM (SELECT label_b, CAST(c AS DOUBLE) AS c, sa, sb FROM q) GROUP BY label_b", "object_vi")(lambda s, d: rounded(evaluation.object_vi_scores(table(s, d)), "label"))


@query(f"{_VI} SELECT {s6('vi_split')} AS vi_split, {s6('vi_merge')} AS vi_merge, {s6('adapted_rand_error')} AS adapted_rand_error, {s6('rand_index')} AS rand_index FROM vi, ra")
def vi_rand(s, d):
    """The flagship: image to labels, contingency table, VI and rand scores. The labels lie in one row, so no join is needed."""
    rows = grids.image_rows(s, d).select(F.floor((F.col("v") + 0.6) * 8).alias("a"), (F.floor((F.col("v") + 0.6) * 4) + F.col("label") % 2).alias("b"))
    t = contingency.ContingencyTable(materialize(contingency.from_labels(rows, "a", "b").pairs, "pairs"))
    return rounded(evaluation._one_row(evaluation.vi_scores(t), evaluation.rand_scores(t)))


_SC = _P + ", sc AS (SELECT label_a, label_b, c, sa, sb, CAST(c AS DOUBLE) / (sa + sb - c) AS iou, CAST(c AS DOUBLE) / sa AS iot, CAST(c AS DOUBLE) / sb AS iop, 2.0 * c / (sa + sb) AS dice FROM q WHERE label_a <> 0 AND label_b <> 0), k AS (SELECT count(DISTINCT CASE WHEN label_a <> 0 THEN label_a END) AS na, count(DISTINCT CASE WHEN label_b <> 0 THEN label_b END) AS nb FROM p)"


def _rates(tp: str) -> str:
    return f"SELECT {s6('CASE WHEN tp > 0 THEN tp / na ELSE 0 END')} AS precision, {s6('CASE WHEN tp > 0 THEN tp / nb ELSE 0 END')} AS recall, {s6('CASE WHEN tp > 0 THEN tp / (na + nb - tp) ELSE 0 END')} AS segmentation_accuracy, {s6('CASE WHEN tp > 0 THEN 2 * tp / (na + nb) ELSE 0 END')} AS f1 FROM (SELECT CAST(({tp}) AS DOUBLE) AS tp, na, nb FROM k)"


query(f"{_SC} {_rates('SELECT count(*) FROM sc WHERE iou >= 0.51')}", "matching_iou_051")(lambda s, d: rounded(evaluation.matching_scores(table(s, d), 0.51)))
query(None, "matching_iou_020")(lambda s, d: rounded(evaluation.matching_scores(table(s, d), 0.2)))
query(f"{_SC} {_rates('SELECT count(DISTINCT label_b) FROM sc WHERE iot >= 0.6')}", "matching_iot")(lambda s, d: rounded(evaluation.matching_scores(table(s, d), 0.6, "iot")))
query(f"{_SC} {_rates('SELECT count(DISTINCT label_a) FROM sc WHERE iop >= 0.6')}", "matching_iop")(lambda s, d: rounded(evaluation.matching_scores(table(s, d), 0.6, "iop")))
_T = [0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
query(f"{_SC}, t AS (SELECT unnest({_T}) AS t), u AS (SELECT t, CAST((SELECT count(*) FROM sc WHERE iou >= t.t) AS DOUBLE) AS tp, na, nb FROM t, k) SELECT {s6('avg(tp / (na + nb - tp))')} AS mean_accuracy FROM u", "msa")(lambda s, d: rounded(evaluation.mean_segmentation_accuracy_scores(table(s, d), _T).select("mean_accuracy")))
query(f"{_SC}, da AS (SELECT avg(b) AS v FROM (SELECT label_a, max(CASE WHEN label_b <> 0 THEN 2.0 * c / (sa + sb) ELSE 0 END) AS b FROM q WHERE label_a <> 0 GROUP BY label_a)), db AS (SELECT avg(b) AS v FROM (SELECT label_b, max(CASE WHEN label_a <> 0 THEN 2.0 * c / (sa + sb) ELSE 0 END) AS b FROM q WHERE label_b <> 0 GROUP BY label_b)) SELECT {s6('least(da.v, db.v)')} AS symmetric_best_dice FROM da, db", "sbd")(lambda s, d: rounded(evaluation.best_dice_scores(table(s, d))))
query(f"{_LAB} SELECT {s6('2 * sum(p * q) / (sum(p) + sum(q) + 1e-7)')} AS dice FROM (SELECT CAST(a > 5 AS INT) AS p, CAST(b > 2 AS INT) AS q FROM l)", "dice")(lambda s, d: rounded(evaluation.dice_score(grids.labels_a(s, d), grids.labels_b(s, d), 5, 2)))
query(f"{_LAB} SELECT {s6('2 * sum(a * b) / (sum(a) + sum(b) + 1e-7)')} AS dice FROM l", "dice_soft")(lambda s, d: rounded(evaluation.dice_score(grids.labels_a(s, d), grids.labels_b(s, d), None, None)))

# -- objects ----------------------------------------------------------------------------------------

_AX2 = ", ".join([f"{s6('avg(y)')} AS com_y, {s6('avg(x)')} AS com_x, min(y) AS bb_min_y, min(x) AS bb_min_x, max(y) + 1 AS bb_max_y, max(x) + 1 AS bb_max_x"])
query(f"{_LAB} SELECT a AS label, count(*) AS size, {_AX2} FROM l WHERE a <> 0 GROUP BY a", "morphology")(lambda s, d: rounded(morphology.morphology(grids.labels_a(s, d)), "label", "size", "bb_min_y", "bb_min_x", "bb_max_y", "bb_max_x"))
query(f"{_G3} SELECT v AS label, count(*) AS size, {s6('avg(z)')} AS com_z, {_AX2}, min(z) AS bb_min_z, max(z) + 1 AS bb_max_z FROM g GROUP BY v", "morphology_3d")(lambda s, d: rounded(morphology.morphology(grids.volume3d(s, d)), "label", "size", *[f"bb_{m}_{a}" for m in ("min", "max") for a in "zyx"]))
_E = "sqrt((var_pop(y * 2.0) - var_pop(x)) ** 2 + 4 * covar_pop(y * 2.0, x) ** 2)"
query(f"{_LAB} SELECT a AS label, count(*) AS n_voxels, {s6('count(*) * 2.0')} AS area, {s6('count(*)::DOUBLE / ((max(y) + 1 - min(y)) * (max(x) + 1 - min(x)))')} AS extent, {s6('sqrt(8.0 * count(*) / pi())')} AS equivalent_diameter_area, {s6(f'4 * sqrt((var_pop(y * 2.0) + var_pop(x) + {_E}) / 2)')} AS axis_major_length FROM l WHERE a <> 0 GROUP BY a", "regionprops_2d")(lambda s, d: rounded(morphology.regionprops(grids.labels_a(s, d), resolution=(2.0, 1.0)).select("label", "n_voxels", "area", "extent", "equivalent_diameter_area", "axis_major_length"), "label", "n_voxels"))
query(None, "regionprops_3d_surface")(lambda s, d: rounded(morphology.regionprops(grids.volume3d(s, d), resolution=(3.0, 1.0, 1.0), compute_surface=True), "label", "n_voxels"))


def _relabel_map(labels: Volume) -> Volume:
    """By a table of the ids that occur, whatever they are; Spark's remainder has the sign of the id, as in SQL."""
    ids = stats.unique(labels).select(F.col("v").alias("old"), ((F.col("v") * 7 + 3) % 101).alias("new"))
    return relabel.relabel(labels, ids, dtype="int64")


query(f"{_LAB} SELECT y, x, (a * 7 + 3) % 101 AS v FROM l", "relabel_map")(lambda s, d: _relabel_map(grids.labels_a(s, d)).df)
query(f"{_LAB} SELECT y, x, CASE WHEN a = 0 THEN 0 ELSE CAST(dense_rank() OVER (ORDER BY a) AS BIGINT) END AS v FROM l", "relabel_consecutive")(lambda s, d: relabel.relabel_consecutive(grids.labels_a(s, d), 1)[0].df)
_SF = _LAB + ", z AS (SELECT a, dense_rank() OVER (ORDER BY a) AS r FROM (SELECT a FROM l GROUP BY a HAVING count(*) BETWEEN 100 AND 9000 AND a <> 0))"
query(f"{_SF} SELECT y, x, CAST(coalesce(r, 0) AS BIGINT) AS v FROM l LEFT JOIN z USING (a)", "size_filter")(lambda s, d: relabel.size_filter(grids.labels_a(s, d), 100, 9000).df)
query(f"{_SF} SELECT y, x, CASE WHEN r IS NULL THEN 0 ELSE a END AS v FROM l LEFT JOIN z USING (a)", "size_filter_no_relabel")(lambda s, d: relabel.size_filter(grids.labels_a(s, d), 100, 9000, relabel=False).df)
query(f"{_LAB} SELECT y, x, CASE WHEN a > 5 THEN a ELSE 0 END AS v FROM l", "segmentation_filter")(lambda s, d: relabel.segmentation_filter(grids.labels_a(s, d), lambda a, m: np.where(a > 5, a, 0), (128, 64)).df)

_CC = """, f AS (SELECT y * 64 + x AS i, y, x FROM g WHERE v > 0.15),
 e AS (SELECT a.i AS u, b.i AS w FROM f a JOIN f b ON (a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1){more}),
 b AS (SELECT u, w FROM e UNION ALL SELECT w, u FROM e),
 r AS (SELECT i, i AS j FROM f UNION SELECT r.i, b.w FROM r JOIN b ON r.j = b.u),
 c AS (SELECT i, min(j) AS root FROM r GROUP BY i)"""
_DIAG = " OR (b.y = a.y + 1 AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x - 1)"
query(f"{_G2}{_CC.format(more='')} SELECT i // 64 AS y, i % 64 AS x, root FROM c", "label_roots")(lambda s, d: components.label_roots(img(s, d), 0.15))
query(f"{_G2}{_CC.format(more='')} SELECT i // 64 AS y, i % 64 AS x, CAST(dense_rank() OVER (ORDER BY root) AS BIGINT) AS v FROM c", "label")(lambda s, d: components.label(img(s, d), 0.15).df)
query(f"{_G2}{_CC.format(more=_DIAG)} SELECT n AS size, count(*) AS components FROM (SELECT root, count(*) AS n FROM c GROUP BY root) GROUP BY n", "label_connectivity_2")(lambda s, d: components.label_roots(img(s, d), 0.15, 2).groupBy("root").count().groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("components")))

# -- resampling ---------------------------------------------------------------------------------------

query(f"{_G2} SELECT y // 2 AS y, x // 2 AS x, v FROM g WHERE y % 2 = 0 AND x % 2 = 0", "downsample_2x_nearest")(lambda s, d: resample.downsample(img(s, d), 2).df)
query(f"{_G2} SELECT y, x // 4 AS x, v FROM g WHERE x % 4 = 0", "downsample_aniso")(lambda s, d: resample.downsample(img(s, d), (1, 4)).df)
query(f"{_G2}, n AS (SELECT max(y) + 1 AS h FROM g), o AS (SELECT CAST(unnest(range(2 * h)) AS BIGINT) AS i FROM n), p AS (SELECT CAST(unnest(range(128)) AS BIGINT) AS j), k AS (SELECT i, j, least(i * 0.5, h - 1.0)::DOUBLE AS cy, least(j * 0.5, 63.0)::DOUBLE AS cx, h FROM o, p, n), t AS (SELECT i, j, cy, cx, least(floor(cy), h - 2)::BIGINT AS y0, least(floor(cx), 62)::BIGINT AS x0 FROM k) SELECT i AS y, j AS x, {s6('sum(g.v * (1 - abs(cy - g.y)) * (1 - abs(cx - g.x)))')} AS v FROM t JOIN (SELECT unnest([0, 1]) AS dy) a ON TRUE JOIN (SELECT unnest([0, 1]) AS dx) b ON TRUE JOIN g ON g.y = y0 + dy AND g.x = x0 + dx GROUP BY i, j", "resize_linear")(lambda s, d: rounded(resample.resize(img(s, d), (2 * img(s, d).shape[0], 128), 1).df, "y", "x"))
query(f"{_G2}, o AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, i * 0.75 + 10.25 AS cy, j * 0.5 + 3.5 AS cx FROM range(100) a(i), range(60) b(j)), t AS (SELECT i, j, cy::DOUBLE AS cy, cx::DOUBLE AS cx, floor(cy)::BIGINT AS y0, floor(cx)::BIGINT AS x0 FROM o) SELECT i AS y, j AS x, {s6('sum(g.v * (1 - abs(cy - g.y)) * (1 - abs(cx - g.x)))')} AS v FROM t JOIN (SELECT unnest([0, 1]) AS dy) a ON TRUE JOIN (SELECT unnest([0, 1]) AS dx) b ON TRUE JOIN g ON g.y = y0 + dy AND g.x = x0 + dx GROUP BY i, j", "affine_linear")(lambda s, d: rounded(resample.affine(img(s, d), (100, 60), scale=[0.75, 0.5], translation=[10.25, 3.5], order=1).df, "y", "x"))
query(None, "affine_rotation_cubic")(lambda s, d: rounded(resample.affine(img(s, d), (80, 50), rotation=[30.0], translation=[40.0, 10.0], order=3).df, "y", "x"))
query(f"{_G2} SELECT CAST(i AS BIGINT) AS y, CAST(j AS BIGINT) AS x, {s6('sum(g.v * w)')} AS v FROM (SELECT i, j, (i * 2) AS yy, j // 2 + k AS xx, CASE WHEN j % 2 = 0 THEN 1.0 - k ELSE 0.5 END AS w FROM range(100) a(i), range(120) b(j), range(2) c(k)) t JOIN g ON g.y = yy AND g.x = xx GROUP BY i, j", "transform_coordinates")(lambda s, d: rounded(resample.transform_subvolume_coordinates(img(s, d), s.range(12000).select(F.floor(F.col("id") / 120).alias("y"), (F.col("id") % 120).alias("x")).withColumns({"at_y": F.col("y") * 2.0, "at_x": F.col("x") * 0.5}), (100, 120), 1).df, "y", "x"))

# -- stencils -----------------------------------------------------------------------------------------

_B = (128, 64)


def _mirror(c: str, n: str) -> str:
    return f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN 2 * {n} - 1 - ({c}) ELSE {c} END"


def _separable(terms: list[tuple[int, int]], final: str, sigma: float) -> str:
    """SQL of a gaussian family filter: one weighted offset join per axis, for each (order y, order x)."""
    names, ctes = [], [_G2, "n AS (SELECT max(y) + 1 AS h FROM g)"]
    for order in {o for t in terms for o in t}:
        k = stencil.gaussian_kernel(sigma, order)
        r = len(k) // 2
        ctes.append(f"k{order} AS (SELECT unnest({list(range(-r, r + 1))}) AS o, unnest({[float(w) for w in k]}) AS w)")
    for i, (oy, ox) in enumerate(terms):
        # the kernel is a convolution: the target is the source plus the offset
        ctes.append(f"a{i} AS (SELECT t.y, t.x, sum(s.v * w) AS v FROM (SELECT g.y, g.x, {_mirror('g.x - o', '64')} AS sx, w FROM g, k{ox}) t JOIN g s ON s.y = t.y AND s.x = t.sx GROUP BY t.y, t.x)")
        ctes.append(f"b{i} AS (SELECT t.y, t.x, sum(s.v * w) AS v FROM (SELECT a{i}.y, a{i}.x, {_mirror(f'a{i}.y - o', 'n.h')} AS sy, w FROM a{i}, k{oy}, n) t JOIN a{i} s ON s.x = t.x AND s.y = t.sy GROUP BY t.y, t.x)")
        names.append(f"b{i}")
    joins = " ".join(f"JOIN {n} USING (y, x)" for n in names[1:])
    return f"{', '.join(ctes)} SELECT y, x, {s6(final)} AS v FROM {names[0]} {joins}"


query(_separable([(0, 0)], "b0.v", 1.0), "gaussian")(lambda s, d: rounded(stencil.gaussian_smoothing(img(s, d), 1.0, block_shape=_B).df, "y", "x"))
query(_separable([(1, 0), (0, 1)], "sqrt(b0.v * b0.v + b1.v * b1.v)", 1.0), "grad_magnitude")(lambda s, d: rounded(stencil.gaussian_gradient_magnitude(img(s, d), 1.0, block_shape=_B).df, "y", "x"))
query(_separable([(2, 0), (0, 2)], "b0.v + b1.v", 1.0), "laplacian")(lambda s, d: rounded(stencil.laplacian_of_gaussian(img(s, d), 1.0, block_shape=_B).df, "y", "x"))
query(_separable([(2, 0), (0, 2), (1, 1)], "(b0.v + b1.v) / 2 + sqrt(((b0.v - b1.v) / 2) ** 2 + b2.v * b2.v)", 1.0), "hessian_ev")(lambda s, d: rounded(stencil.apply_filter(img(s, d), "hessian_of_gaussian_eigenvalues", 1.0, return_channel=0, block_shape=_B).df, "y", "x"))
query(None, "structure_tensor_ev")(lambda s, d: rounded(stencil.apply_filter(img(s, d), "structure_tensor_eigenvalues", 1.0, outer_scale=2.0, block_shape=_B).df, "z", "y", "x"))
query(f"{_G2}, t AS (SELECT *, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mx FROM g), u AS (SELECT *, max(mx) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS my FROM t) SELECT y, x, v FROM u WHERE v = my AND v > 0.2 AND x BETWEEN 3 AND 60 AND y >= 3 AND y <= (SELECT max(y) FROM g) - 3", "local_maxima")(lambda s, d: stencil.find_local_maxima(img(s, d), 3, 0.2))
_FG = _G2 + ", f AS (SELECT y, x, v < 0.2 AS fg FROM g), bg AS (SELECT y, x FROM f WHERE NOT fg)"
_EDT = f"{_FG}, near AS (SELECT f.y, f.x, min((f.y - bg.y) ** 2 + (f.x - bg.x) ** 2) AS d2 FROM f JOIN bg ON bg.y BETWEEN f.y - 8 AND f.y + 8 AND bg.x BETWEEN f.x - 8 AND f.x + 8 GROUP BY f.y, f.x) SELECT y, x, CAST(d2 AS BIGINT) AS d2 FROM near WHERE d2 <= 64"


def _edt(s, d):
    fg = img(s, d).with_values(F.col("v") < 0.2, "bool")
    out = distance.distance_transform(fg, halo=8, block_shape=_B)
    return out.df.select("y", "x", F.rint(F.col("v").cast("double") * F.col("v")).cast("double").alias("d")).where("d <= 64").select("y", "x", F.col("d").cast("bigint").alias("d2"))


query(_EDT, "edt")(_edt)
query(_EDT, "edt_exact")(lambda s, d: distance.exact_distance_transform(img(s, d).with_values(F.col("v") < 0.2, "bool")).df.select("y", "x", F.rint(F.col("v").cast("double") * F.col("v")).alias("d")).where("d <= 64").select("y", "x", F.col("d").cast("bigint").alias("d2")))


def _seeds(s, d) -> Volume:
    return img(s, d).with_values(F.when((F.col("y") % 8 == 4) & (F.col("x") % 8 == 4), F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).otherwise(0), "int64")


query(None, "edt_indices")(lambda s, d: distance.distance_transform(img(s, d).with_values(F.col("v") < 0.2, "bool"), halo=8, return_distances=False, return_indices=True, block_shape=_B).df)
query(None, "watershed")(lambda s, d: watershed.watershed(img(s, d), _seeds(s, d), halo=8, block_shape=_B).df)
query(f"{_LAB}, o AS (SELECT y, x, a AS label FROM l WHERE a >= 7), p AS (SELECT DISTINCT CAST(i * 17 AS BIGINT) AS id, CAST((i * 37) % 480 AS BIGINT) AS py, CAST((i * 23) % 64 AS BIGINT) AS px FROM range(200) t(i)), c AS (SELECT id, o.label, (o.y - py) ** 2 + (o.x - px) ** 2 AS d2, o.y * 64 + o.x AS i FROM p JOIN o ON o.y BETWEEN py - 6 AND py + 6 AND o.x BETWEEN px - 6 AND px + 6), w AS (SELECT id, label, d2, row_number() OVER (PARTITION BY id ORDER BY d2, i) AS k FROM c WHERE d2 <= 36) SELECT p.id, coalesce(w.label, 0) AS label, CAST(coalesce(w.d2, -1) AS BIGINT) AS d2 FROM p LEFT JOIN w ON w.id = p.id AND k = 1", "map_points")(
    lambda s, d: distance.map_points_to_objects(grids.labels_a(s, d).with_values(F.when(F.col("v") >= 7, F.col("v")).otherwise(0), "int64"), s.range(200).select((F.col("id") * 17).alias("id"), ((F.col("id") * 37) % 480).alias("y"), ((F.col("id") * 23) % 64).alias("x")), 6).select("id", "label", F.when(F.col("distance") < 1e9, F.rint(F.col("distance").cast("double") * F.col("distance"))).otherwise(-1).cast("bigint").alias("d2"))
)
# -- sparse volumes: components, whose background has no rows ----------------------------------------------

_LL = _LAB + _CC.format(more="") + ", z AS (SELECT l.*, CAST(coalesce(k.v, 0) AS BIGINT) AS k FROM l LEFT JOIN (SELECT i, dense_rank() OVER (ORDER BY root) AS v FROM c) k ON k.i = l.y * 64 + l.x)"
_VIL = _VI.replace(_P, _LL + ", p AS (SELECT k AS label_a, a AS label_b, count(*) AS c FROM z GROUP BY ALL), q AS (SELECT *, CAST(sum(c) OVER (PARTITION BY label_a) AS BIGINT) AS sa, CAST(sum(c) OVER (PARTITION BY label_b) AS BIGINT) AS sb FROM p)")


def _objects(s, d) -> Volume:
    return components.label(img(s, d), 0.15)


@query(f"{_VIL} SELECT {s6('vi_split')} AS vi_split, {s6('vi_merge')} AS vi_merge, {s6('adapted_rand_error')} AS adapted_rand_error, {s6('rand_index')} AS rand_index FROM vi, ra")
def vi_label(s, d):
    t = contingency.contingency_table(_objects(s, d), grids.labels_a(s, d))
    return rounded(evaluation._one_row(evaluation.vi_scores(t), evaluation.rand_scores(t)))


query(f"{_LL} SELECT {s6('2 * sum(p * q) / (sum(p) + sum(q) + 1e-7)')} AS dice FROM (SELECT CAST(k > 0 AS INT) AS p, CAST(a > 5 AS INT) AS q FROM z)", "dice_label")(lambda s, d: rounded(evaluation.dice_score(_objects(s, d), grids.labels_a(s, d), 0, 5)))
query(f"{_LL} SELECT y, x, k + a AS v FROM z", "add_label")(lambda s, d: pointwise.add(_objects(s, d), grids.labels_a(s, d), dtype="int64").dense().df)
query(f"{_LL} SELECT count(*) AS n, min(k)::DOUBLE AS min, max(k)::DOUBLE AS max, {s6('avg(k)')} AS mean, {s6('stddev_pop(k)')} AS std FROM z", "stats_label")(lambda s, d: rounded(stats.summary(_objects(s, d)), "n", "min", "max"))
query(f"{_LL} SELECT k AS v, count(*) AS count FROM z GROUP BY k", "unique_label")(lambda s, d: stats.unique(_objects(s, d), True))
query(f"{_LL} SELECT y, x, CASE WHEN k = 0 THEN 0 ELSE k + 4 END AS v FROM z", "relabel_label")(lambda s, d: relabel.relabel_consecutive(_objects(s, d), 4)[0].dense().df)
query(f"{_LL} SELECT y, x, k * 10 + b AS v FROM z", "multi_transformation_label")(lambda s, d: views.transform_many(lambda k, b: k * 10 + b, _objects(s, d), grids.labels_b(s, d), dtype="int64").df)


def _turn(a: str, b: str, angle: float) -> str:
    """Rows of the matrix that turns axis ``a`` to axis ``b``, as SQL values (row, column, value)."""
    rest = ({"0", "1", "2"} - {a, b}).pop()
    return f"({a}, {a}, cos(radians({angle}))), ({a}, {b}, -sin(radians({angle}))), ({b}, {a}, sin(radians({angle}))), ({b}, {b}, cos(radians({angle}))), ({rest}, {rest}, 1.0)"


_ROT = (
    "WITH g AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS z, l_suppkey AS y, CAST(CAST(l_quantity AS INT) - 1 AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY ALL), "
    f"r0 AS (SELECT * FROM (VALUES {_turn('1', '2', 3.0)}) t(i, j, m)), r1 AS (SELECT * FROM (VALUES {_turn('2', '0', -2.0)}) t(i, j, m)), r2 AS (SELECT * FROM (VALUES {_turn('0', '1', 4.0)}) t(i, j, m)), "
    "m AS (SELECT i, j, m * (j + 1) / 2 AS m FROM (SELECT r2.i, r0.j, sum(r2.m * r1.m * r0.m) AS m FROM r2 JOIN r1 ON r2.j = r1.i JOIN r0 ON r1.j = r0.i GROUP BY r2.i, r0.j)), "
    "n AS (SELECT max(y) AS h FROM g), o AS (SELECT a.i AS z, b.j AS y, c.k AS x FROM range(7) a(i), (SELECT unnest(range(h + 1)) AS j FROM n) b, range(50) c(k)), "
    "p AS (SELECT o.*, " + ", ".join(f"(SELECT max(CASE WHEN i = {i} AND j = 0 THEN m END) FROM m) * o.z + (SELECT max(CASE WHEN i = {i} AND j = 1 THEN m END) FROM m) * o.y + (SELECT max(CASE WHEN i = {i} AND j = 2 THEN m END) FROM m) * o.x + {t} AS c{i}" for i, t in enumerate((0.25, 1.5, 0.75))) + " FROM o), "
    "t AS (SELECT p.*, greatest(least(floor(c0), 5), 0)::BIGINT + d0 AS z0, greatest(least(floor(c1), h - 1), 0)::BIGINT + d1 AS y0, greatest(least(floor(c2), 48), 0)::BIGINT + d2 AS x0, c0 BETWEEN -1e-9 AND 6 + 1e-9 AND c1 BETWEEN -1e-9 AND h + 1e-9 AND c2 BETWEEN -1e-9 AND 49 + 1e-9 AS inside FROM p, n, range(2) a(d0), range(2) b(d1), range(2) c(d2)), "
    "w AS (SELECT t.z, t.y, t.x, inside, coalesce(g.v, 0) * greatest(1 - abs(c0 - z0), 0) * greatest(1 - abs(c1 - y0), 0) * greatest(1 - abs(c2 - x0), 0) AS s FROM t LEFT JOIN g ON g.z = z0 AND g.y = y0 AND g.x = x0) "
    f"SELECT z, y, x, {s6('CASE WHEN bool_or(inside) THEN sum(s) ELSE 0 END')} AS v FROM w GROUP BY z, y, x"
)


@query(_ROT)
def affine_rotation_linear_3d(s, d):
    g = grids.volume3d(s, d)
    g = g.with_values(F.col("v"), "float64")
    return rounded(resample.affine(g, g.shape, scale=[0.5, 1.0, 1.5], rotation=[3.0, -2.0, 4.0], translation=[0.25, 1.5, 0.75], order=1).df, "z", "y", "x")


query(None, "centroid_matching")(lambda s, d: rounded(evaluation.centroid_matching(components.label(img(s, d), 0.15), components.label(img(s, d), 0.14), 2.0)))

# -- graphs -------------------------------------------------------------------------------------------

_RAG = _LAB + ", r AS (SELECT p.a AS u, q.a AS w FROM l p JOIN l q ON (p.y = q.y AND q.x = p.x + 1) OR (p.x = q.x AND q.y = p.y + 1)), e AS (SELECT least(u, w) AS u, greatest(u, w) AS v, count(*) AS size FROM r WHERE u <> w GROUP BY ALL)"
query(f"{_RAG} SELECT u, v, size FROM e", "rag")(lambda s, d: graph.region_adjacency(grids.labels_a(s, d)))


def _costs(s, d) -> DataFrame:
    edges = graph.region_adjacency(grids.labels_a(s, d)).withColumn("p", (F.col("u") * 3 + F.col("v") * 5) % 11 / 10.0)
    return graph.compute_edge_costs(edges, 0.4, "all").select("u", "v", "cost")


query(f"{_RAG}, c AS (SELECT *, 0.998 * (((u * 3 + v * 5) % 11) / 10.0::DOUBLE) + 0.001 AS q FROM e) SELECT u, v, {s6('(ln((1 - q) / q) + ln(0.6 / 0.4)) * size / max(size) OVER ()')} AS cost FROM c", "edge_costs")(lambda s, d: rounded(_costs(s, d), "u", "v"))
query(None, "multicut_gaec")(lambda s, d: graph.multicut_gaec(_costs(s, d)))
query(None, "multicut_kernighan_lin")(lambda s, d: graph.multicut_kernighan_lin(_costs(s, d)))
query(None, "multicut_decomposition")(lambda s, d: graph.multicut_decomposition(_costs(s, d)))


def _tiled(s, d) -> Volume:
    """Components of the foreground inside tiles of 100 by 32, with ids unique across tiles."""
    g = img(s, d)
    cut = g.df.where("v > 0.05").select("y", "x", F.lit(1).alias("v"))
    spread = cut.select((F.col("y") + F.floor(F.col("y") / 100)).alias("y"), (F.col("x") + F.floor(F.col("x") / 32)).alias("x"), "v")
    lab = components.label(Volume(spread, (g.shape[0] + g.shape[0] // 100 + 1, 66), "uint8"))
    back = lab.df.select((F.col("y") - F.floor(F.col("y") / 101)).alias("y"), (F.col("x") - F.floor(F.col("x") / 33)).alias("x"), "v")
    return Volume(back, g.shape, "uint64", fill=0).dense()


query(None, "stitch_tiled")(lambda s, d: stitching.stitch_tiled_segmentation(_tiled(s, d), (100, 32)).df)


def _flood_label(tile: np.ndarray, number: int) -> np.ndarray:
    """Components of one tile, by spreading the least index until nothing changes."""
    fg = tile > 0.05
    lab = np.where(fg, np.arange(1, tile.size + 1).reshape(tile.shape), 0)
    while True:
        wide = np.pad(np.where(fg, lab, tile.size + 1), 1, constant_values=tile.size + 1)
        low = np.minimum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        new = np.where(fg, low, 0)
        if (new == lab).all():
            return lab
        lab = new


query(None, "stitch_segmentation")(lambda s, d: stitching.stitch_segmentation(img(s, d), _flood_label, (125, 32), 4).df)
query(f"{_M} SELECT y, x, CASE WHEN inside THEN 1.0::DOUBLE ELSE v END AS v FROM m", "masked_write")(lambda s, d: write_masked(img(s, d).with_values(F.lit(1.0)), grids.mask(s, d), img(s, d)).df)


# -- the two passes per object of the public benchmark: cubes of 4 voxels, 3 apart -----------------------


def cube_grid(spark, objects: int) -> Volume:
    side = int(np.ceil(objects ** (1 / 3)))
    o = spark.range(objects).select(F.col("id"), F.floor(F.col("id") / (side * side)).alias("a"), (F.floor(F.col("id") / side) % side).alias("b"), (F.col("id") % side).alias("c"))
    k = spark.range(64).select(F.floor(F.col("id") / 16).alias("p"), (F.floor(F.col("id") / 4) % 4).alias("q"), (F.col("id") % 4).alias("r"))
    df = o.join(F.broadcast(k.withColumn("_k", F.lit(1))), F.col("_k") == F.lit(1)).select((F.col("a") * 7 + F.col("p")).alias("z"), (F.col("b") * 7 + F.col("q")).alias("y"), (F.col("c") * 7 + F.col("r")).alias("x"), (F.col("id") + 1).alias("v"))
    return Volume(df, (side * 7,) * 3, "uint64")


# -- whole tables: queries whose namesakes above work on a fixed window, box or radius ------------------
# Those keep their SQL; these grow with the table, and tests hold them against brute force.

_MW = _G2 + ", m AS (SELECT *, (y * 5 + x * 3) % 7 < 4 AS inside FROM g)"
_LMW = _LAB + ", m AS (SELECT * FROM l WHERE (y * 5 + x * 3) % 7 < 4)"
query(f"{_MW} SELECT y, x, CASE WHEN inside THEN v ELSE 0 END AS v FROM m", "copy_masked_whole")(lambda s, d: pointwise.copy(img(s, d), mask=grids.scattered_mask(s, d)).df)


def _stat_whole(name: str, **sql: str):
    what = ", ".join(f"{s6(q)} AS {c}" for c, q in sql.items())
    query(f"{_MW} SELECT {what} FROM m WHERE inside", name + "_masked_whole")(lambda s, d: rounded(stats.summary(img(s, d), grids.scattered_mask(s, d)).select(*sql)))


_stat_whole("stats_max", max="max(v)")
_stat_whole("stats_min", min="min(v)")
_stat_whole("stats_min_max", min="min(v)", max="max(v)")
_stat_whole("stats_mean_std", mean="avg(v)", std="stddev_pop(v)")
_stat_whole("stats_mean", mean="avg(v)")
_stat_whole("stats_std", std="stddev_pop(v)")
query(f"{_LMW} SELECT a AS v, count(*) AS count FROM m GROUP BY a", "unique_masked_whole")(lambda s, d: stats.unique(grids.labels_a(s, d), True, grids.scattered_mask(s, d)))
query(f"{_MW} SELECT y, x, {s6('CASE WHEN inside THEN v + 1 ELSE 0 END')} AS v FROM m", "op_masked_whole")(lambda s, d: rounded(pointwise.add(img(s, d), 1.0, mask=grids.scattered_mask(s, d)).df, "y", "x"))
query(f"{_LMW} SELECT a AS label_a, b AS label_b, count(*) AS count FROM m GROUP BY ALL", "contingency_masked_whole")(lambda s, d: contingency.contingency_table(grids.labels_a(s, d), grids.labels_b(s, d), grids.scattered_mask(s, d)).pairs)
query(f"{_MW} SELECT y, x, CASE WHEN inside THEN 1.0::DOUBLE ELSE v END AS v FROM m", "masked_write_whole")(lambda s, d: write_masked(img(s, d).with_values(F.lit(1.0)), grids.scattered_mask(s, d), img(s, d)).df)


def _affine_linear_whole(s, d):
    """Every voxel lies among the samples: three quarters of a voxel apart along y, half a voxel along x."""
    g = img(s, d)
    shape = (int((g.shape[0] - 1) / 0.75) + 1, 2 * g.shape[1] - 1)
    return rounded(resample.affine(g, shape, scale=[0.75, 0.5], order=1).df, "y", "x")


def _affine_rotation_cubic_whole(s, d):
    """Half a turn, so that the output is no larger than the table, between the voxels; what falls outside is 0."""
    g = img(s, d)
    return rounded(resample.affine(g, g.shape, rotation=[180.0], translation=[g.shape[0] - 1.5, g.shape[1] - 1.5], order=3).df, "y", "x")


def _transform_coordinates_whole(s, d):
    g = img(s, d)
    shape = (g.shape[0], 2 * g.shape[1] - 1)
    targets = grid(s, shape).withColumns({"at_y": F.col("y") * 1.0, "at_x": F.col("x") * 0.5})
    return rounded(resample.transform_subvolume_coordinates(g, targets, shape, 1).df, "y", "x")


def _map_points_whole(s, d):
    """A point per vector."""
    objects = grids.labels_a(s, d).with_values(F.when(F.col("v") >= 7, F.col("v")).otherwise(0), "int64")
    points = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("y"), (F.col("vec_id") * 23 % 64).alias("x"))
    d2 = F.when(F.col("distance") < 1e9, F.rint(F.col("distance").cast("double") * F.col("distance"))).otherwise(-1)
    return distance.map_points_to_objects(objects, points, 6).select("id", "label", d2.cast("bigint").alias("d2"))


for _f in (_affine_linear_whole, _affine_rotation_cubic_whole, _transform_coordinates_whole, _map_points_whole):
    query(None, _f.__name__[1:])(_f)


def _foreground(s, d) -> Volume:
    return img(s, d).with_values(F.col("v") < 0.2, "bool")


def _edt_whole(s, d):
    """All voxels; distances beyond the halo are those to the nearest background that the block saw, or inf, and not exact."""
    out = distance.distance_transform(_foreground(s, d), halo=8, block_shape=_B)
    return out.df.select("y", "x", F.col("v").alias("distance"), (F.col("v") <= 8).alias("exact"))


def _edt_exact_whole(s, d):
    return distance.exact_distance_transform(_foreground(s, d)).df.select("y", "x", F.col("v").alias("distance"))


query(None, "edt_whole")(_edt_whole)
query(None, "edt_exact_whole")(_edt_exact_whole)
