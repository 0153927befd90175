"""Queries of the core operators over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark
from .functions import rng, vec
from .operators import contracts, learners, matrices, preprocessing, trees
from .operators import profile as prof
from .plans import graph, train
from .session import shared_dir
from .sources import checkpoints, metrics, raw

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, d: str, table: str = "embeddings") -> DataFrame:
    if table == "embeddings":
        return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), vec.double("embedding").alias("features"), F.col("label").cast("int").alias("label"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.xxhash64("l_orderkey", "l_linenumber").alias("row_id"), F.array("l_quantity", "l_discount", "l_tax").alias("features"), (F.col("l_extendedprice") / 1000).alias("target"))


def _r(df: DataFrame, *cols: str, places: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


E = "(SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings)"
LONG = "(SELECT vec_id AS row_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query(f"SELECT pos, round(avg(x), 5) AS mean, round(CASE WHEN stddev_pop(x) <= 1.1920929e-07 THEN 1.0 ELSE stddev_pop(x) END, 5) AS scale FROM {LONG} GROUP BY pos")
def pre01_scaler_fit(spark, d):
    m = preprocessing.column_moments(_rows(spark, d))
    return _r(m.select("pos", "mean", F.when(F.col("std") <= vec.F32_EPSILON, 1.0).otherwise(F.col("std")).alias("scale")), "mean", "scale")


@query(f"WITH s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM {LONG} GROUP BY pos) SELECT row_id, pos, round((x - m) / s, 4) AS z FROM {LONG} JOIN s USING (pos)")
def pre02_scaler_transform(spark, d):
    rows = _rows(spark, d)
    z = preprocessing.StandardScaler().fit(rows).transform(rows)
    return _r(z.select("row_id", F.posexplode("scaled").alias("pos", "z")), "z", places=4)


@query("SELECT vec_id AS row_id, list_transform(range(10), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END) AS y FROM embeddings")
def pre03_one_hot(spark, d):
    return _rows(spark, d).select("row_id", vec.one_hot("label", 10).alias("y"))


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: x / 255)), 6) AS s FROM {E}")
def pre04_pixels(spark, d):
    return _r(preprocessing.normalise_pixels(_rows(spark, d)).select("row_id", vec.total("features").alias("s")), "s", places=6)


@query("SELECT count(*) AS n, 0.0 AS total FROM range(100)")
def mat01_create(spark, d):
    return matrices.zeros(spark, 100, 8).agg(F.count(F.lit(1)).alias("n"), F.sum(vec.total("features")).alias("total"))


@query(f"SELECT row_id, list_transform(f, lambda x: 2.5) AS filled FROM {E}")
def mat03_fill(spark, d):
    return _rows(spark, d).select("row_id", F.transform("features", lambda x: F.lit(2.5)).alias("filled"))


@query(f"SELECT row_id, round(list_sum(f) * 3, 5) AS s FROM {E}")
def mat05_scale(spark, d):
    return _r(_rows(spark, d).select("row_id", vec.total(vec.scale("features", 3.0)).alias("s")), "s")


@query(f"SELECT row_id, round(list_sum(f), 5) AS s FROM {E}")
def mat06_sum(spark, d):
    return _r(_rows(spark, d).select("row_id", vec.total("features").alias("s")), "s")


@query(f"SELECT row_id, list_position(f, list_max(f)) - 1 AS at FROM {E}")
def mat07_argmax(spark, d):
    return _rows(spark, d).select("row_id", vec.argmax("features").alias("at"))


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: x + x * 2)), 5) AS added, round(list_sum(list_transform(f, lambda x: x - x * 2)), 5) AS subtracted FROM {E}")
def mat08_add_sub(spark, d):
    twice = vec.scale("features", 2.0)
    return _r(_rows(spark, d).select("row_id", vec.total(vec.add("features", twice)).alias("added"), vec.total(vec.sub("features", twice)).alias("subtracted")), "added", "subtracted")


COO = f"(SELECT row_id AS i, pos AS j, x AS v FROM {LONG})"


def _coo(spark, d):
    return matrices.to_coo(_rows(spark, d))


@query(f"SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM {COO} a JOIN {COO} b ON a.i = b.i GROUP BY 1, 2")
def mat09_matmul(spark, d):
    x = _coo(spark, d)
    return _r(matrices.matmul(x, x, transpose_a=True), "v", places=4)


@query(f"WITH g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {COO} a JOIN {COO} b ON a.i = b.i GROUP BY 1, 2) SELECT i, j, round(2 * v, 4) AS v FROM g")
def mat09_accumulate(spark, d):
    x = _coo(spark, d)
    once = matrices.matmul(x, x, transpose_a=True)
    return _r(matrices.matmul(x, x, transpose_a=True, accumulate=once), "v", places=4)


@query(f"WITH g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM {COO} a JOIN {COO} b ON a.i = b.i GROUP BY 1, 2) SELECT x.i, g.i AS j, round(sum(x.v * g.v), 3) AS v FROM {COO} x JOIN g ON x.j = g.j GROUP BY 1, 2")
def mat09_transpose_b(spark, d):
    x = _coo(spark, d)
    return _r(matrices.matmul(x, matrices.matmul(x, x, transpose_a=True), transpose_b=True), "v", places=3)


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: greatest(0.0, x))), 5) AS s FROM {E}")
def mat10_relu(spark, d):
    return _r(_rows(spark, d).select("row_id", vec.total(vec.relu("features")).alias("s")), "s")


@query(f"WITH e AS (SELECT row_id, pos, exp(x - max(x) OVER (PARTITION BY row_id)) AS e FROM {LONG}) SELECT row_id, pos, round(e / sum(e) OVER (PARTITION BY row_id), 6) AS p FROM e")
def mat11_softmax(spark, d):
    return _r(_rows(spark, d).select("row_id", F.posexplode(vec.softmax("features")).alias("pos", "p")), "p", places=6)


@query(f"WITH e AS (SELECT row_id, label, pos, exp(x - max(x) OVER (PARTITION BY row_id)) AS e FROM {LONG} WHERE pos < 10), s AS (SELECT row_id, label, pos, e / sum(e) OVER (PARTITION BY row_id) AS q FROM e) SELECT row_id, round(-ln(q + 1e-7), 5) AS ce FROM s WHERE pos = label")
def mat12_xent(spark, d):
    q = _rows(spark, d).select("row_id", vec.one_hot("label", 10).alias("p"), vec.softmax(F.slice("features", 1, 10)).alias("q"))
    return _r(q.select("row_id", vec.total(vec.cross_entropy("p", "q")).alias("ce")), "ce")


@query(f"SELECT row_id, round(list_sum(list_transform(f, lambda x: 1 + CASE WHEN x > 0 THEN 0.5 ELSE 0 END)), 5) AS relu_grad, round(list_sum(list_transform(f, lambda x: x + 0.5)), 5) AS softmax_grad, round(list_sum(list_transform(f, lambda x: x + (x * x - x) * 0.5)), 5) AS q_grad, round(list_sum(list_transform(f, lambda x: x - ln(x * x + 1e-7) * 0.5)), 4) AS p_grad FROM {E}")
def mat13_gradients(spark, d):
    half, one = F.transform("features", lambda x: F.lit(0.5)), F.transform("features", lambda x: F.lit(1.0))
    sq = F.transform("features", lambda x: x * x)
    out = _rows(spark, d).select("row_id", vec.total(vec.relu_grad(one, "features", half)).alias("relu_grad"), vec.total(vec.softmax_grad("features", half)).alias("softmax_grad"), vec.total(vec.cross_entropy_grad_q("features", "features", sq, half)).alias("q_grad"), vec.total(vec.cross_entropy_grad_p("features", sq, half)).alias("p_grad"))
    return _r(_r(out, "relu_grad", "softmax_grad", "q_grad"), "p_grad", places=4)


@query(f"SELECT a.row_id, round(list_sum(list_transform(list_zip(a.f, b.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 5) AS d2 FROM {E} a CROSS JOIN (SELECT f FROM {E} ORDER BY row_id LIMIT 1) b")
def mat16_sqdist(spark, d):
    rows = _rows(spark, d)
    origin = rows.orderBy("row_id").limit(1).collect()[0]["features"]
    return _r(rows.select("row_id", vec.squared_distance("features", vec.vector(origin)).alias("d2")), "d2")


@query(f"SELECT row_id, round(CASE WHEN list_sum(f) >= 0 THEN 1 / (1 + exp(-list_sum(f))) ELSE exp(list_sum(f)) / (1 + exp(list_sum(f))) END, 6) AS p FROM {E}")
def mat17_sigmoid(spark, d):
    return _r(_rows(spark, d).select("row_id", vec.sigmoid(vec.total("features")).alias("p")), "p", places=6)


@query(f"SELECT row_id, round(0.25 + 2 * f[1] + 0.5 * f[2], 5) AS y0, round(-0.5 - f[1] + 3 * f[2], 5) AS y1 FROM {E}")
def mat18_linear_forward(spark, d):
    y = vec.affine(F.slice("features", 1, 2), [[2, -1], [0.5, 3]], [0.25, -0.5])
    return _r(_rows(spark, d).select("row_id", y.alias("y")).select("row_id", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1")), "y0", "y1")


@query("WITH m AS (SELECT a.range AS i, b.range AS j, ((a.range * 7 + b.range * 3) % 11) / 11.0 AS v FROM range(128) a, range(128) b) SELECT x.i, y.j, round(sum(x.v * y.v), 6) AS v FROM m x JOIN m y ON x.j = y.i GROUP BY 1, 2")
def mat19_square_matmul(spark, d):
    m = spark.range(128 * 128).select(F.floor(F.col("id") / 128).alias("i"), (F.col("id") % 128).alias("j")).withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11) / 11.0)
    return _r(matrices.matmul(m, m), "v", places=6)


@query("SELECT n_nationkey AS n, n_nationkey * 1024 AS kib, n_nationkey * 1048576 AS mib, CAST(n_nationkey AS BIGINT) * 1073741824 AS gib, ((n_nationkey + 7) // 8) * 8 AS aligned, n_nationkey IN (1, 2, 4, 8, 16) AS pow2, least(n_nationkey, 10) AS lo, greatest(n_nationkey, 10) AS hi FROM nation")
def scl03_align(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"))
    return n.select("n", vec.kib("n").alias("kib"), vec.mib("n").alias("mib"), vec.gib("n").alias("gib"), vec.align_up("n", 8).alias("aligned"), vec.is_power_of_two("n").alias("pow2"), vec.smaller("n", F.lit(10)).alias("lo"), vec.larger("n", F.lit(10)).alias("hi"))


@query("SELECT * FROM (VALUES (0, 465482994), (1, 3895364073), (2, 1746730475), (3, 3759121132), (4, 2984354868), (5, 3193308813)) t(i, u32)")
def rng01_pcg(spark, d):
    return rng.draws(spark, 6).select("i", "u32")


@query()
def rng04_bootstrap(spark, d):
    return rng.bootstrap_weights(_rows(spark, d).select("row_id"), 10, 5489).groupBy("tree_id").agg(F.sum("weight").alias("drawn"), F.count(F.lit(1)).alias("distinct_rows"))


@query(f"SELECT count(*) AS n, count(*) * 64 AS values, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(var_pop(x), 5) AS variance FROM {LONG}".replace("count(*) AS n, count(*) * 64 AS values", "count(DISTINCT row_id) AS n, count(*) AS values"))
def agg10_profile(spark, d):
    return _r(_r(prof.profile(_rows(spark, d)), "min", "max", "mean", places=6), "variance")


@query("WITH c AS (SELECT r.range AS label, count(vec_id) AS n FROM range(10) r LEFT JOIN embeddings e ON e.label = r.range GROUP BY 1) SELECT label, n, round(100.0 * n / max(n) OVER (), 5) AS percent FROM c")
def agg11_histogram(spark, d):
    return _r(prof.histogram(_rows(spark, d)), "percent")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def agg16_percentile(spark, d):
    return prof.percentile(spark.read.parquet(f"{d}/events.parquet"), "value", [0.5, 0.95], ["event_type"])


@query("SELECT DISTINCT label FROM embeddings")
def agg17_classes(spark, d):
    return prof.classes(_rows(spark, d))


@query("WITH c AS (SELECT o_custkey % 50 AS g, o_orderpriority AS label, count(*) AS votes FROM orders GROUP BY 1, 2) SELECT g, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY votes DESC, label) = 1")
def agg07_majority(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("label"))
    return prof.majority(o, ["g"])


@query("WITH c AS (SELECT o_custkey % 50 AS g, o_orderpriority AS label, count(*) AS c FROM orders GROUP BY 1, 2) SELECT g, CAST(sum(c) AS BIGINT) AS n, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) AS gini FROM c GROUP BY 1")
def agg08_gini(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("label"))
    return _r(prof.gini(o, ["g"]), "gini", places=6)


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 64")
def srt06_head(spark, d):
    return prof.head(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value"), 64, "event_id")


@query("SELECT l_orderkey, l_linenumber, pos, batch FROM (SELECT l_orderkey, l_linenumber, n, r - 1 AS pos, (r - 1) // 50 AS batch FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER () AS n FROM lineitem)) WHERE batch < n // 50")
def win05_batches(spark, d):
    return prof.mini_batches(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber"), 50, ["l_orderkey", "l_linenumber"])


@query("WITH p AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS batch FROM embeddings) SELECT batch, count(*) AS n, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS s FROM p JOIN embeddings USING (vec_id) GROUP BY 1")
def join04_gather(spark, d):
    rows = _rows(spark, d)
    at = prof.mini_batches(rows.select("row_id"), 50, ["row_id"])
    return _r(at.join(rows, "row_id").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(vec.total("features")).alias("s")), "s", places=4)


@query("WITH r AS (SELECT row_id, len(features) AS w, row_number() OVER (ORDER BY row_id, ingested_at) - 1 AS pos, count(*) OVER () AS n FROM train_images WHERE row_id IS NOT NULL AND ingested_at IS NOT NULL) SELECT pos // 50 AS batch, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids, CAST(sum(w) AS BIGINT) AS width FROM r WHERE pos // 50 < n // 50 GROUP BY 1")
def win05_image_batches(spark, d):
    """Batches of whole images, whose rows are wide."""
    images = spark.read.parquet(f"{d}/train_images.parquet").where("row_id is not null and ingested_at is not null").select("row_id", "ingested_at", "features")
    batches = prof.mini_batches(images, 50, ["row_id", "ingested_at"])
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"), F.sum(F.when(F.col("features").isNotNull(), F.size("features"))).cast("long").alias("width"))


@query("SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM (SELECT CASE WHEN features IS NULL THEN 'no features' WHEN len(features) <> 784 THEN 'wrong size' WHEN len(list_filter(features, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' WHEN label IS NULL OR isnan(label) THEN 'no label' WHEN label <> floor(label) THEN 'label not whole' WHEN label < 0 OR label >= 10 THEN 'label out of range' END AS problem FROM train_images JOIN train_labels USING (row_id)) GROUP BY 1")
def flt02_validate(spark, d):
    images = spark.read.parquet(f"{d}/train_images.parquet").select("row_id", preprocessing.features_problem(784).alias("f"))
    labels = spark.read.parquet(f"{d}/train_labels.parquet").select("row_id", preprocessing.label_problem().alias("l"))
    return images.join(labels, "row_id").groupBy(F.coalesce("f", "l", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def _registry(spark, d):
    """A registry with a capability record for every nation."""
    n = F.col("n_nationkey").cast("int")
    more = lambda first, second, cond: F.concat(F.array(F.lit(first)), F.when(cond, F.array(F.lit(second))).otherwise(F.array().cast("array<string>")))
    rows = spark.read.parquet(f"{d}/nation.parquet").select(
        F.lower("n_name").alias("model_id"), F.when(F.col("n_regionkey") % 2 == 0, "Classification").otherwise("Regression").alias("task"),
        more("float32", "float16", n % 3 == 0).alias("dtypes"), more("cpu-scalar", "cpu-simd", n % 2 == 0).alias("devices"),
        (n % 4 + 1).alias("max_rank"), F.expr("shiftleft(1L, cast(20 + n_nationkey % 10 AS int))").alias("max_input_bytes"), F.lit(True).alias("supports_inference"), (n % 5 != 0).alias("supports_training"),
    )
    return contracts.Registry(spark).register(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], contracts.CAPABILITY).schema]))


ABLE = "SELECT lower(n_name) AS model_id, CAST(n_nationkey % 4 + 1 AS INT) AS max_rank FROM nation WHERE n_regionkey % 2 = 0 AND n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 AND n_nationkey % 4 + 1 >= 3 AND n_nationkey % 10 >= 1"


@query(ABLE)
def flt03_capability(spark, d):
    return _registry(spark, d).matching("Classification", "float32", "cpu-simd", training=True, rank=3, nbytes=1 << 21).select("model_id", "max_rank")


@query(f"SELECT * FROM ({ABLE}) ORDER BY model_id LIMIT 1")
def con05_select(spark, d):
    found = _registry(spark, d).select("Classification", "float32", "cpu-simd", training=True, rank=3, nbytes=1 << 21)
    return spark.createDataFrame([(found["model_id"], found["max_rank"])], "model_id string, max_rank int")


@query("SELECT lower(n_name) AS model_id, CASE WHEN n_regionkey % 2 = 0 THEN 'Classification' ELSE 'Regression' END AS task, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS dtypes FROM nation WHERE n_nationkey = 6")
def con05_require(spark, d):
    name = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 6").select(F.lower("n_name")).first()[0]
    found = _registry(spark, d).require(name)
    return spark.createDataFrame([(found["model_id"], found["task"], len(found["dtypes"]))], "model_id string, task string, dtypes int")


@query("SELECT * FROM (VALUES ('float32', 4), ('float16', 2), ('bfloat16', 2), ('int8', 1), ('uint8', 1), ('int32', 4), ('int64', 8)) t(dtype, bytes)")
def con01_dtype(spark, d):
    return spark.createDataFrame([(k,) for k in contracts.DTYPES], "dtype string").select("dtype", contracts.dtype_size("dtype").alias("bytes"))


@query("SELECT * FROM (VALUES (0, NULL, 25088, 100352, true), (1, 'UnsupportedLayout', NULL, NULL, NULL), (2, 'InvalidShape', NULL, NULL, NULL), (3, 'InvalidStride', NULL, NULL, NULL), (4, 'UnsupportedDevice', NULL, NULL, NULL), (5, NULL, 6, 24, false), (6, 'ShapeOverflow', NULL, NULL, NULL)) t(i, problem, elements, bytes, contiguous)")
def con02_descriptor(spark, d):
    rows = [([32, 28, 28, 1], [], "float32", "NHWC", "cpu-scalar", "Owned"), ([28, 28, 1], [], "float32", "NHWC", "cpu-scalar", "Owned"), ([3, 0], [], "float32", "RowMajor", "cpu-scalar", "Owned"), ([2, 3], [1], "float32", "RowMajor", "cpu-scalar", "Owned"), ([2, 3], [], "float32", "RowMajor", "cpu-scalar", "DeviceOwned"), ([2, 3], [1, 2], "float32", "Strided", "cpu-scalar", "Borrowed"), ([1 << 40, 1 << 40], [], "int8", "RowMajor", "cpu-scalar", "Owned")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + contracts.DESCRIPTOR)
    return contracts.describe(df).select("i", "problem", "elements", "bytes", "contiguous")


@query("SELECT CAST(epoch AS DOUBLE) AS epoch, CAST(accuracy AS DOUBLE) AS accuracy, CAST(cost AS DOUBLE) AS cost, CAST(learning_rate AS DOUBLE) AS learning_rate FROM (VALUES (1.0, 0.5, 0.9, 0.01), (2.0, 0.75, 0.6, 0.01)) t(epoch, accuracy, cost, learning_rate)")
def src03_metrics(spark, d):
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    spark.createDataFrame([("epoch,accuracy,cost,learning_rate\n1,0.5,0.9,0.01\n\n2,0.75,0.6,0.01,ignored",)], "value string").coalesce(1).write.text(path)
    return metrics.read_metrics(spark, path)


@query("SELECT row_id, CAST(floor(x * 23) AS INT) + 232 AS code FROM (SELECT vec_id AS row_id, least(1.0, greatest(0.0, CAST(embedding AS DOUBLE[])[1])) AS x FROM embeddings)")
def snk06_grey(spark, d):
    return _rows(spark, d).select("row_id", vec.grey_code(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("features")[0]))).alias("code"))


KNN = f"WITH q AS (SELECT * FROM {E} WHERE row_id % 20 = 0), t AS (SELECT * FROM {E}), r AS (SELECT q.row_id, t.label, row_number() OVER (PARTITION BY q.row_id ORDER BY list_sum(list_transform(list_zip(q.f, t.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), t.label) AS rk FROM q CROSS JOIN t), v AS (SELECT row_id, label, count(*) AS c FROM r WHERE rk <= 5 GROUP BY 1, 2) SELECT row_id, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c DESC, label) = 1"


@query(KNN)
def knn02_predict(spark, d):
    """The vectors whose id is divisible by 20 are the stated query set, against all vectors."""
    rows = _rows(spark, d)
    return learners.KNearestNeighbors(5).fit(rows).predict(rows.where("row_id % 20 = 0"))


@query(f"SELECT count(*) AS n, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({KNN}) p JOIN embeddings e ON e.vec_id = p.row_id")
def agg12_knn_accuracy(spark, d):
    return prof.accuracy(knn02_predict(spark, d).join(_rows(spark, d).select("row_id", "label"), "row_id"))


GNB = f"SELECT label, pos, count(*) AS n, avg(x) AS mean, var_pop(x) + 1e-6 AS variance FROM {LONG} GROUP BY 1, 2"


@query(f"SELECT label, pos, n, round(mean, 5) AS mean, round(variance, 5) AS variance FROM ({GNB})")
def gnb01_fit(spark, d):
    return _r(learners.GaussianNaiveBayes().statistics(_rows(spark, d)), "mean", "variance")


@query(f"WITH m AS ({GNB}), s AS (SELECT x.row_id, m.label, ln(any_value(m.n) / (SELECT count(*) FROM embeddings)) - 0.5 * sum(1.8378770664 + ln(m.variance) + (x.x - m.mean) ** 2 / m.variance) AS p FROM {LONG} x JOIN m ON m.pos = x.pos GROUP BY 1, 2) SELECT row_id, label AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1")
def gnb02_predict(spark, d):
    rows = _rows(spark, d)
    return learners.GaussianNaiveBayes().fit(rows).predict(rows).select("row_id", "predicted")


@query(f"WITH f AS (SELECT row_id AS r, f FROM {E} ORDER BY row_id LIMIT 1), d AS (SELECT row_id, list_sum(list_transform(list_zip(e.f, f.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM {E} e, f) SELECT 0 AS i, r AS row_id FROM f UNION ALL SELECT 1, row_id FROM (SELECT row_id FROM d ORDER BY d DESC, row_id LIMIT 1)")
def km01_seed(spark, d):
    seeds = learners.KMeans(2, 1).fit(_rows(spark, d)).seeds
    return spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "i int, row_id long")


@query("SELECT i, j, round(c, 6) AS cov FROM (SELECT a.pos AS i, b.pos AS j, covar_pop(a.x, b.x) AS c FROM " + LONG + " a JOIN " + LONG + " b ON a.row_id = b.row_id AND a.pos <= b.pos GROUP BY 1, 2)")
def agg03_covariance(spark, d):
    return _r(matrices.covariance_table(_rows(spark, d)), "cov", places=6)


LIN = "(SELECT l_quantity / 50 AS q, l_extendedprice / 100000 AS y FROM lineitem)"


@query(f"WITH RECURSIVE s AS (SELECT avg(q * q) AS qq, avg(q * y) AS qy, avg(q) AS q, avg(y) AS y FROM {LIN}), g(i, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, w - 0.05 * (w * s.qq + b * s.q - s.qy), b - 0.05 * (w * s.q + b - s.y) FROM g, s WHERE i < 200) SELECT round(w, 6) AS weight, round(b, 6) AS bias FROM g WHERE i = 200")
def lin01_fit(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.array(F.col("l_quantity") / 50).alias("features"), (F.col("l_extendedprice") / 100000).alias("target"))
    m = learners.LinearRegression(0.05, 200).fit(rows)
    return spark.createDataFrame([(round(m.weights[0], 6), round(m.bias, 6))], "weight double, bias double")


@query()
def tlc02_accuracy(spark, d):
    rows = _rows(spark, d)
    m = learners.SoftmaxClassifier(64, 10).fit(rows, 0.25, 60)
    return prof.accuracy(m.predict(rows))


BEST = f"WITH c AS (SELECT pos AS feature, x, label, count(*) AS c FROM {LONG} GROUP BY 1, 2, 3), v AS (SELECT DISTINCT feature, x FROM c), y AS (SELECT DISTINCT label FROM c), r AS (SELECT v.feature, v.x, y.label, coalesce(c.c, 0) AS c FROM v CROSS JOIN y LEFT JOIN c ON c.feature = v.feature AND c.x = v.x AND c.label = y.label), p AS (SELECT *, sum(c) OVER (PARTITION BY feature, label ORDER BY x) AS l, sum(c) OVER (PARTITION BY feature, label) AS t FROM r), s AS (SELECT feature, x, sum(l) AS nl, sum(t - l) AS nr, sum(l * l) AS ql, sum((t - l) * (t - l)) AS qr, sum(t * t) AS q, sum(t) AS n FROM p GROUP BY 1, 2), g AS (SELECT feature, x + (lead(x) OVER (PARTITION BY feature ORDER BY x) - x) * 0.5 AS threshold, (1 - q / (n * n)) - (nl - ql / nl + nr - qr / nullif(nr, 0)) / n AS gain FROM s) SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM g WHERE threshold IS NOT NULL ORDER BY round(gain, 7) DESC, feature, g.threshold LIMIT 1"


@query(BEST)
def dt01_best_split(spark, d):
    rows = _rows(spark, d)
    return _r(trees.best_splits(rows, []).select("feature", "threshold", "gain"), "threshold", "gain", places=6)


@query()
def dt02_predict(spark, d):
    rows = _rows(spark, d)
    return prof.accuracy(trees.DecisionTreeClassifier(6).fit(rows).predict(rows))


@query()
def rf02_predict(spark, d):
    rows = _rows(spark, d)
    return prof.accuracy(trees.RandomForestClassifier(16, 8).fit(rows).predict(rows))


@query()
def nn05_train_metrics(spark, d):
    """The residual network on embeddings with all six optimizers, one task each."""
    rows = _rows(spark, d)
    a, b = rng.split_rows(rows, 0.8)
    runs = {k: train.Training(3, 20, 0.05 if k in ("sgd", "momentum", "nesterov") else 0.005, k) for k in train.OPTIMIZERS}
    return train.train_runs(a, b, partial(graph.residual_classifier, 64, 16, 10), runs, 10).select("run_id", "epoch", F.round("accuracy", 6).alias("accuracy"), F.round("cost", 6).alias("cost"), "learning_rate")


@query()
def nn03_forward(spark, d):
    """The untrained residual network's probabilities for every vector."""
    return _r(train.predict(graph.residual_classifier(64, 16, 10), _rows(spark, d)).select("row_id", F.posexplode("probabilities").alias("pos", "p")), "p", places=6)


@query()
def snk02_benchmark(spark, d):
    from .sources import reports

    r = reports.benchmark(spark, "cpu.square_matmul", lambda: mat19_square_matmul(spark, d), 2.0 * 128**3, 10, 2)
    return spark.createDataFrame([(json.dumps(r),)], "report string")


PARAMS = [np.array([[1.0, -2.5], [0.25, 3.0]]), np.array([[0.5], [-1.0]])]


@query("SELECT * FROM (VALUES (0, 2, 2, '4b4d4c435030310100000002000000', 1.0, 3.0), (1, 2, 1, '4b4d4c435030310100000002000000', 0.5, -1.0)) t(param_idx, rows, cols, head, first, last)")
def snk03_checkpoint(spark, d):
    """Parameters written to the binary format and read again; the head of the file in hexadecimal."""
    data = checkpoints.encode(PARAMS)
    back = checkpoints.as_table(spark, checkpoints.decode(data, [p.shape for p in PARAMS]))
    return back.select("param_idx", "rows", "cols", F.lit(data[:15].hex()).alias("head"), F.col("data")[0].cast("double").alias("first"), F.element_at("data", -1).cast("double").alias("last"))


@query("SELECT * FROM (VALUES (0, 10, 1), (1, 16, 1), (2, 16, 1), (3, 16, 64), (4, 16, 16), (5, 10, 16)) t(param_idx, rows, cols)")
def nn02_parameter_order(spark, d):
    """Shapes of the residual network's parameters in the order in which checkpoints hold them."""
    g = graph.residual_classifier(64, 16, 10)
    return spark.createDataFrame([(i, p.rows, p.cols) for i, p in enumerate(g.parameters())], "param_idx int, rows int, cols int")


def _shared_file(spark, name):
    """A local path in the shared folder, for the raw files that tasks open themselves."""
    root = shared_dir(spark)
    if not root.startswith(("file:", "/")):
        raise ValueError("raw files need a shared mount")
    root = "/" + root.split(":", 1)[-1].lstrip("/")
    os.makedirs(root, exist_ok=True)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@query(f"SELECT (row_number() OVER (ORDER BY row_id)) - 1 AS row_id, round(list_sum(list_transform(CAST(f AS FLOAT[]), lambda x: CAST(x AS DOUBLE))), 4) AS s FROM {E}")
def src01_matrix_file(spark, d):
    """All vectors written as one raw float file, every task at its place, and read again by ranges."""
    path, rows = _shared_file(spark, "matrix"), _rows(spark, d)
    raw.write_matrix(rows, path)
    return _r(raw.read_matrix(spark, path, os.path.getsize(path) // 256, 64).select("row_id", vec.total("features").alias("s")), "s", places=4)


@query(f"SELECT CASE WHEN r <= n THEN 'read' ELSE 'zeros' END AS part, count(*) AS rows, round(sum(s), 3) AS s FROM (SELECT row_number() OVER (ORDER BY row_id) AS r, (SELECT count(*) FROM embeddings) AS n, list_sum(f) AS s FROM {E} UNION ALL SELECT (SELECT count(*) FROM embeddings) + i.range + 1, (SELECT count(*) FROM embeddings), 0.0 FROM range(3) i) GROUP BY 1")
def src02_permissive_read(spark, d):
    """A file shorter than its matrix is filled up with zeros."""
    path, rows = _shared_file(spark, "short"), _rows(spark, d)
    raw.write_matrix(rows, path)
    n = os.path.getsize(path) // 256
    back = raw.read_matrix(spark, path, n + 3, 64, "permissive").select(F.when(F.col("row_id") < n, "read").otherwise("zeros").alias("part"), vec.total("features").alias("s"))
    return _r(back.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("s").alias("s")), "s", places=3)


@query("WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1] AS x, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), y AS (SELECT vec_id AS other, label, row_number() OVER (ORDER BY vec_id DESC) AS r FROM embeddings) SELECT r - 1 AS pos, vec_id AS row_id, round(x, 6) AS x, other, label FROM x JOIN y USING (r)")
def join06_zip(spark, d):
    """Vectors in ascending and labels in descending order of the id, put side by side by position."""
    rows = _rows(spark, d)
    labels = rows.select((-F.col("row_id")).alias("down"), F.col("row_id").alias("other"), "label")
    both = prof.zipped(rows.select("row_id", F.col("features")[0].alias("x")), labels, ["row_id"], ["down"])
    return _r(both.select("pos", "row_id", "x", "other", "label"), "x", places=6)


@query("SELECT round(ln(10), 6) AS first, true AS falls")
def tlc01_losses(spark, d):
    """The loss before the first update is that of ten equal shares; losses fall from step to step."""
    losses = learners.SoftmaxClassifier(64, 10).fit(_rows(spark, d), 0.25, 20).losses
    return spark.createDataFrame([(round(losses[0], 6), all(b < a for a, b in zip(losses, losses[1:])))], "first double, falls boolean")


@query(f"SELECT row_id, round(list_sum(f), 5) AS s FROM {E}")
def mat02_copy(spark, d):
    return _r(_rows(spark, d).select("row_id", vec.total(vec.copy("features", vec.fill(64))).alias("s")), "s")


#: The generator as a recursion over 128-bit numbers, from seed 5489 and the default sequence.
PCG = """WITH RECURSIVE k AS (SELECT 18446744073709551616::UHUGEINT AS m, 6364136223846793005::UHUGEINT AS a, (15726070495360670683::UHUGEINT * 2 + 1) % 18446744073709551616::UHUGEINT AS c),
 p(i, s) AS (SELECT 0, (((c + 5489) % m) * (a % m) + c) % m FROM k UNION ALL SELECT i + 1, (s * a + c) % m FROM p, k WHERE i < 1023),
 u AS (SELECT i, s::UBIGINT AS s FROM p),
 x AS (SELECT i, (xor(s >> 18, s) >> 27) & 4294967295::UBIGINT AS mixed, s >> 59 AS turn FROM u)
 SELECT i // 32 AS i, i % 32 AS j, round((((mixed >> turn) | ((mixed << ((32 - turn) % 32)) & 4294967295::UBIGINT)) >> 8) / 16777216.0 * 2 - 1, 6) AS v FROM x"""


@query(PCG)
def rng06_benchmark_matrix(spark, d):
    """The seeded operand of the matrix benchmark, uniform in [-1, 1)."""
    values = rng.PCG32(5489).fill(32, 32, -1.0, 1.0)
    return spark.createDataFrame([(i, j, round(float(v), 6)) for i, row in enumerate(values) for j, v in enumerate(row)], "i int, j int, v double")


@query("SELECT true AS below, true AS positive")
def mat19_max_error(spark, d):
    """The largest error of a product of seeded matrices kept as 32-bit numbers: there is one, and it is small."""
    error = benchmark.largest_error(*benchmark.operands(spark, 32, 5489))
    return spark.createDataFrame([(error < 1e-5, error > 0)], "below boolean, positive boolean")


STEPS = {
    "sgd": "w - 0.1 * g",
    "momentum": "w - 0.1 * g",
    "nesterov": "w - 0.1 * (0.9 * g + g)",
    "rmsprop": "w - 0.1 * g / (sqrt(0.001 * g * g) + 1e-8)",
    "adam": "w - 0.1 * (g + 0.01 * w) / (abs(g + 0.01 * w) + 1e-8)",
    "adamw": "w * 0.999 - 0.1 * g / (abs(g) + 1e-8)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS optimizer, row_id, round({f}, 6) AS w FROM (SELECT row_id, f[1] AS w, f[2] AS g FROM {E})" for k, f in STEPS.items()))
def opt01_first_step(spark, d):
    """The first step of every optimizer on weights and gradients taken from the vectors, over Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name in train.OPTIMIZERS:
                w, g = (b.column(i).to_numpy().copy() for i in (1, 2))
                train.update(train.Training(learning_rate=0.1, optimizer=name, weight_decay=0.01), 1, w, g, np.zeros_like(w), np.zeros_like(w))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(w)), b.column(0), pa.array(w)], ["optimizer", "row_id", "w"])

    rows = _rows(spark, d).select("row_id", F.col("features")[0].alias("w"), F.col("features")[1].alias("g"))
    return _r(rows.mapInArrow(run, "optimizer string, row_id long, w double"), "w", places=6)


@query(f"WITH RECURSIVE s AS (SELECT avg(q * q) AS qq, avg(q * y) AS qy, avg(q) AS q, avg(y) AS y FROM {LIN}), g(i, w, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, w - 0.05 * (w * s.qq + b * s.q - s.qy), b - 0.05 * (w * s.q + b - s.y) FROM g, s WHERE i < 200) SELECT l_orderkey, l_linenumber, round(w * l_quantity / 50 + b, 5) AS predicted FROM lineitem, g WHERE i = 200")
def lin02_predict(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 50).alias("features"), (F.col("l_extendedprice") / 100000).alias("target"))
    return _r(learners.LinearRegression(0.05, 200).fit(rows).predict(rows).select("l_orderkey", "l_linenumber", "predicted"), "predicted")


@query(f"WITH m AS ({GNB}), s AS (SELECT x.row_id, m.label, ln(any_value(m.n) / (SELECT count(*) FROM embeddings)) - 0.5 * sum(1.8378770664 + ln(m.variance) + (x.x - m.mean) ** 2 / m.variance) AS p FROM {LONG} x JOIN m ON m.pos = x.pos GROUP BY 1, 2), b AS (SELECT row_id, label AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1) SELECT count(*) AS n, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM b JOIN embeddings e ON e.vec_id = b.row_id")
def gnb_accuracy(spark, d):
    rows = _rows(spark, d)
    return prof.accuracy(learners.GaussianNaiveBayes().fit(rows).predict(rows))


@query(f"WITH m AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) <= 1.1920929e-07 THEN 1.0 ELSE stddev_pop(x) END AS scale FROM {LONG} GROUP BY pos) SELECT 'mean' AS param, pos AS idx, round(mean, 6) AS value FROM m UNION ALL SELECT 'scale', pos, round(scale, 6) FROM m")
def acc01_scaler_state(spark, d):
    return _r(preprocessing.StandardScaler().fit(_rows(spark, d)).as_dataframe(spark), "value", places=6)


#: Lloyd's iteration over whole vectors: farthest-first seeds of the smallest id and the one farthest from it, then ten passes.
KM = f"""WITH RECURSIVE x AS MATERIALIZED {E},
 f AS (SELECT row_id AS r, f FROM x ORDER BY row_id LIMIT 1),
 s AS (SELECT x.f FROM x, f ORDER BY list_sum(list_transform(list_zip(x.f, f.f), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) DESC, x.row_id LIMIT 1),
 c(i, a, b) AS (SELECT 0, f.f, s.f FROM f, s UNION ALL
  SELECT i + 1,
   (SELECT list(m ORDER BY pos) FROM (SELECT pos, avg(v) AS m FROM (SELECT unnest(x.f) AS v, generate_subscripts(x.f, 1) AS pos FROM x WHERE list_sum(list_transform(list_zip(x.f, c.a), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) <= list_sum(list_transform(list_zip(x.f, c.b), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) GROUP BY pos)),
   (SELECT list(m ORDER BY pos) FROM (SELECT pos, avg(v) AS m FROM (SELECT unnest(x.f) AS v, generate_subscripts(x.f, 1) AS pos FROM x WHERE list_sum(list_transform(list_zip(x.f, c.a), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) > list_sum(list_transform(list_zip(x.f, c.b), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) GROUP BY pos))
  FROM c WHERE i < 10)
"""


@query(KM + "SELECT 0 AS cluster, generate_subscripts(a, 1) - 1 AS pos, round(unnest(a), 5) AS x FROM c WHERE i = 10 UNION ALL SELECT 1, generate_subscripts(b, 1) - 1, round(unnest(b), 5) FROM c WHERE i = 10")
def km01_fit(spark, d):
    m = learners.KMeans(2, 10, 0.0).fit(_rows(spark, d))
    return spark.createDataFrame([(c, i, round(float(v), 5)) for c, centre in enumerate(m.centers) for i, v in enumerate(centre)], "cluster int, pos int, x double")


#: Full-batch logistic descent over whole vectors, label 1 from class 5 on: five steps.
LOG = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT row_id, f, CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END AS y FROM {E}),
 g(i, w, b) AS (SELECT 0, list_transform(range(64), lambda k: 0.0::DOUBLE), 0.0::DOUBLE UNION ALL
  SELECT i + 1,
   (SELECT list(wj - 0.2 * (gj + 0.001 * wj) ORDER BY pos) FROM (SELECT pos, avg(e * v) AS gj, any_value(g.w[pos]) AS wj FROM (SELECT 1 / (1 + exp(-(list_sum(list_transform(list_zip(x.f, g.w), lambda t: t[1] * t[2])) + g.b))) - x.y AS e, unnest(x.f) AS v, generate_subscripts(x.f, 1) AS pos FROM x) GROUP BY pos)),
   g.b - 0.2 * (SELECT avg(1 / (1 + exp(-(list_sum(list_transform(list_zip(x.f, g.w), lambda t: t[1] * t[2])) + g.b))) - x.y) FROM x)
  FROM g WHERE i < 5)
"""


@query(LOG + "SELECT 'weights' AS param, generate_subscripts(w, 1) - 1 AS idx, round(unnest(w), 6) AS value FROM g WHERE i = 5 UNION ALL SELECT 'bias', 0, round(b, 6) FROM g WHERE i = 5")
def log01_fit(spark, d):
    rows = _rows(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    return _r(learners.LogisticRegression(0.2, 5, 0.001).fit(rows).as_dataframe(spark), "value", places=6)


#: Power iteration for the first component over whole vectors: three hundred steps from the uniform vector.
PCA = f"""WITH RECURSIVE m AS (SELECT pos, avg(x) AS mean FROM {LONG} GROUP BY pos),
 c AS MATERIALIZED (SELECT i, list(v ORDER BY j) AS r FROM (SELECT a.pos AS i, b.pos AS j, covar_pop(a.x, b.x) AS v FROM {LONG} a JOIN {LONG} b ON a.row_id = b.row_id GROUP BY 1, 2) GROUP BY i),
 k AS MATERIALIZED (SELECT list(r ORDER BY i) AS rows FROM c),
 p(n, v) AS (SELECT 0, list_transform(range(64), lambda z: 0.125::DOUBLE) UNION ALL
  SELECT n + 1, list_transform(u, lambda z: z / sqrt(list_sum(list_transform(u, lambda y: y * y)))) FROM (SELECT n, list_transform(k.rows, lambda r: list_sum(list_transform(list_zip(r, p.v), lambda t: t[1] * t[2]))) AS u FROM p, k WHERE n < 300))
"""


@query(PCA + "SELECT generate_subscripts(v, 1) - 1 AS pos, round(unnest(v), 4) AS x FROM p WHERE n = 300")
def pca01_fit(spark, d):
    m = learners.PCA(1, 300, 1e-12).fit(_rows(spark, d))
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(m.components[0])], "pos int, x double")


@query()
def nn09_flagship(spark, d):
    """The digit network as it is meant to be run: 784 pixels, 10 epochs of batches of 50, rate 0.01, momentum 0.9.

    Images and labels of both splits are validated; row 0 is the untrained network's inference on the test split, the
    others follow each epoch. A row an epoch, as the metrics file has them.
    """
    parts = []
    for split in ("train", "test"):
        images = spark.read.parquet(f"{d}/{split}_images.parquet").select("row_id", "features", "ingested_at")
        images = images.where(preprocessing.features_problem(784).isNull()).groupBy("row_id").agg(F.max_by("features", "ingested_at").alias("features"))
        images = preprocessing.unit_pixels(images)
        labels = spark.read.parquet(f"{d}/{split}_labels.parquet").groupBy("row_id").agg(F.max(F.struct("labelled_at", "label"))["label"].alias("label"))
        parts.append(images.join(labels.where(preprocessing.label_problem().isNull()), "row_id").select("row_id", "features", F.col("label").cast("int").alias("label")))
    kind = train.Training(10, 50, 0.01, "momentum", 0.9)
    runs = train.train_runs(*parts, partial(graph.residual_classifier, 784, 16, 10), {"digits": kind}, 10).select("epoch", "accuracy", "cost", "learning_rate")
    before = prof.accuracy(train.predict(graph.residual_classifier(784, 16, 10), parts[1]).withColumn("predicted", vec.argmax("probabilities")))
    first = before.select(F.lit(0).cast("long").alias("epoch"), "accuracy", F.lit(None).cast("double").alias("cost"), F.lit(kind.learning_rate).alias("learning_rate"))
    return _r(first.unionByName(runs), "accuracy", "cost", places=6)


@query(KM + "SELECT x.row_id, CASE WHEN list_sum(list_transform(list_zip(x.f, c.a), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) <= list_sum(list_transform(list_zip(x.f, c.b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) THEN 0 ELSE 1 END AS cluster FROM x, c WHERE c.i = 10")
def km02_predict(spark, d):
    rows = _rows(spark, d)
    return learners.KMeans(2, 10, 0.0).fit(rows).predict(rows).select("row_id", "cluster")


@query(PCA + f"SELECT e.row_id, round(list_sum(list_transform(list_zip(e.f, a.mean, p.v), lambda t: (t[1] - t[2]) * t[3])), 3) AS x FROM {E} e, (SELECT list(mean ORDER BY pos) AS mean FROM m) a, p WHERE p.n = 300")
def pca02_transform(spark, d):
    rows = _rows(spark, d)
    return _r(learners.PCA(1, 300, 1e-12).fit(rows).transform(rows).select("row_id", F.col("projected")[0].alias("x")), "x", places=3)


@query(LOG + "SELECT CAST(y AS INT) AS label, CASE WHEN list_sum(list_transform(list_zip(x.f, g.w), lambda t: t[1] * t[2])) + g.b >= 0 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM x, g WHERE g.i = 5 GROUP BY 1, 2")
def log02_predict(spark, d):
    rows = _rows(spark, d).withColumn("label", (F.col("label") >= 5).cast("int"))
    return prof.confusion(learners.LogisticRegression(0.2, 5, 0.001).fit(rows).predict(rows))


@query(f"WITH m AS ({GNB}), k AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS c FROM m) SELECT 'means' AS param, c * 64 + pos AS idx, round(mean, 5) AS value FROM k UNION ALL SELECT 'variances', c * 64 + pos, round(variance, 5) FROM k UNION ALL SELECT 'classes', c, label FROM k WHERE pos = 0 UNION ALL SELECT 'priors', c, round(ln(n / (SELECT count(*) FROM embeddings)), 5) FROM k WHERE pos = 0")
def acc01_fitted_state(spark, d):
    return _r(learners.GaussianNaiveBayes().fit(_rows(spark, d)).as_dataframe(spark), "value")


#: Two epochs of fifty transpositions with draws of the default stream; after each epoch the order is carried on.
SHUFFLE = PCG[: PCG.index(" SELECT i // 32")].replace("(c + 5489)", "(c + 9600629759793949339::UHUGEINT)").replace("i < 1023", "i < 199") + """,
 w AS MATERIALIZED (SELECT i, (((mixed >> turn) | ((mixed << ((32 - turn) % 32)) & 4294967295::UBIGINT)) % 50)::INT AS at FROM x),
 r(t, o) AS (SELECT 0, range(50) UNION ALL SELECT t + 1, list_transform(range(50), lambda k: CASE WHEN k = a.at THEN o[b.at + 1] WHEN k = b.at THEN o[a.at + 1] ELSE o[k + 1] END) FROM r, w a, w b WHERE a.i = 2 * t AND b.i = 2 * t + 1 AND t < 100)
 SELECT t // 50 - 1 AS epoch, generate_subscripts(o, 1) - 1 AS pos, unnest(o) AS row_id FROM r WHERE t IN (50, 100)"""


@query(SHUFFLE)
def rng03_shuffle(spark, d):
    orders = rng.transposition_orders(50, 2, rng.PCG32())
    return spark.createDataFrame([(e, p, int(r)) for e, o in enumerate(orders) for p, r in enumerate(o)], "epoch int, pos int, row_id long")
