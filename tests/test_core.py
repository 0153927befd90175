import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import benchmark
from vectorloom.functions import rng, vec
from vectorloom.operators import contracts, learners, matrices, preprocessing, trees
from vectorloom.operators import profile as prof
from vectorloom.plans import graph, stored, train
from vectorloom.sources import checkpoints, metrics, raw, reports
from vectorloom.streaming import scoring

FOUR = [(-2.0, -1.0), (-1.0, -2.0), (1.0, 2.0), (2.0, 1.0)]


def table(spark, rows, labels=None, name="label", kind="int"):
    labels = labels if labels is not None else [0] * len(rows)
    return spark.createDataFrame([(i, list(map(float, r)), lab) for i, (r, lab) in enumerate(zip(rows, labels))], f"row_id long, features array<double>, {name} {kind}")


@pytest.fixture(scope="module")
def four(spark):
    return table(spark, FOUR, [0, 0, 1, 1])


@pytest.fixture(scope="module")
def xor(spark):
    return table(spark, [(0, 0), (0, 1), (1, 0), (1, 1)] * 2, [10, 20, 20, 10] * 2)


def one(spark, expr, **cols):
    return spark.range(1).select(*[(F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in cols.items()]).select(expr.alias("r")).first()["r"]


def test_nan_relu_and_argmax(spark):
    nan = float("nan")
    assert one(spark, vec.relu("a"), a=[nan, -1, 2]) == [0, 0, 2]
    assert one(spark, vec.argmax("a"), a=[1, 3, 3]) == 1
    assert one(spark, vec.argmax("a"), a=[1, nan, 3]) == 2
    assert one(spark, vec.argmax("a"), a=[nan, 5]) == 0


def test_softmax_entropy_sigmoid_onehot(spark):
    assert one(spark, vec.softmax("a"), a=[0, 0]) == [0.5, 0.5]
    assert one(spark, vec.softmax("a"), a=[1000, 1000]) == [0.5, 0.5]
    assert one(spark, vec.cross_entropy("p", "q"), p=[1, 0], q=[0.5, 0.5])[0] == pytest.approx(-math.log(0.5 + 1e-7))
    assert one(spark, vec.sigmoid("s"), s=-800.0) == 0
    assert one(spark, vec.one_hot("x", 3), x=2.9) == [0, 0, 1]
    assert one(spark, vec.one_hot("x", 3), x=7.0) == one(spark, vec.one_hot("x", 3), x=-1.0) == [0, 0, 0]
    with pytest.raises(Exception, match="length"):
        one(spark, vec.add("a", "b"), a=[1], b=[1, 2])


def coo(spark, m):
    return matrices.to_coo(table(spark, m))


def dense(df, rows, cols):
    out = np.zeros((rows, cols))
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_matmul(spark):
    a, b = coo(spark, [(1, 2), (3, 4)]), coo(spark, [(5,), (6,)])
    assert dense(matrices.matmul(a, b), 2, 1).ravel().tolist() == [17, 39]
    assert dense(matrices.matmul(a, b, transpose_a=True), 2, 1).ravel().tolist() == [23, 34]
    assert dense(matrices.matmul(a, b, accumulate=matrices.matmul(a, b)), 2, 1).ravel().tolist() == [34, 78]
    c = matrices.matmul(coo(spark, [(1, 2, 3), (4, 5, 6)]), coo(spark, [(1, 0), (0, 1), (1, 1)]))
    assert dense(c, 2, 2).tolist() == [[4, 5], [10, 11]]
    assert matrices.max_abs_error(a, a).first()[0] == 0
    assert dense(matrices.combine(a, a, -1), 2, 2).tolist() == [[0, 0], [0, 0]]
    assert matrices.to_rows(a).where("row_id = 1").first()["features"] == [3, 4]


def test_linear_forward(spark):
    df = table(spark, [(1, 2), (3, 4), (5, 6)])
    got = [r["y"] for r in df.orderBy("row_id").select(vec.affine("features", [[2, -1], [0.5, 3]], [0.25, -0.5]).alias("y")).collect()]
    assert got == [[3.25, 4.5], [8.25, 8.5], [13.25, 12.5]]


def test_scaler(spark, four):
    s = preprocessing.StandardScaler().fit(four)
    z = [r["scaled"] for r in s.transform(four).orderBy("row_id").collect()]
    assert s.scale[0] == pytest.approx(1.5811388)
    assert z[0][0] + z[3][0] == pytest.approx(0)
    assert preprocessing.StandardScaler().fit(table(spark, [(3, 1), (3, 2)])).scale[0] == 1.0
    with pytest.raises(preprocessing.NotFittedError):
        preprocessing.StandardScaler().transform(four)


@pytest.mark.parametrize("rows", [[], [(1.0,), (1.0, 2.0)]])
def test_bad_tables(spark, rows):
    with pytest.raises(ValueError):
        preprocessing.StandardScaler().fit(spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "row_id long, features array<double>"))


def test_pca(spark):
    df = table(spark, [(-2, -2), (-1, -1), (1, 1), (2, 2)])
    p = [r["projected"][0] for r in learners.PCA(1).fit(df).transform(df).orderBy("row_id").collect()]
    assert p[0] == pytest.approx(-2.828427, abs=1e-4) and p[0] + p[3] == pytest.approx(0, abs=1e-4)
    with pytest.raises(ValueError, match="variance"):
        learners.PCA(1).fit(table(spark, [(-1, 1), (1, -1)]))


def test_kmeans_both_ways(spark, four, monkeypatch):
    m = learners.KMeans(2, 50).fit(four)
    assert m.seeds == [0, 3] and sorted(map(tuple, m.centers)) == [(-1.5, -1.5), (1.5, 1.5)] and m.iterations == 2
    monkeypatch.setattr(learners, "ONE_TASK_BYTES", 0)
    n = learners.KMeans(2, 50).fit(four)
    assert n.seeds == m.seeds and n.centers == m.centers
    got = [r["cluster"] for r in m.predict(table(spark, [(-1.5, -1.5), (1.5, 1.5)])).orderBy("row_id").collect()]
    assert got[0] != got[1]


def test_logistic_both_ways(spark, four, monkeypatch):
    m = learners.LogisticRegression(0.2, 300, 0.001).fit(four)
    assert m.weights == pytest.approx([1.814406, 1.814406], abs=1e-4) and m.bias == pytest.approx(0, abs=1e-6)
    p = m.predict_probability(table(spark, [(1.5, 1.5)])).first()["probability"]
    assert p == pytest.approx(0.995693, abs=1e-4)
    one_task = learners.LogisticRegression(0.2, 5).fit(four)
    monkeypatch.setattr(learners, "ONE_TASK_BYTES", 0)
    assert learners.LogisticRegression(0.2, 5).fit(four).weights == pytest.approx(one_task.weights)
    with pytest.raises(ValueError):
        m.predict(four, threshold=1.0)


def test_linear(spark):
    df = table(spark, [(0,), (1,), (2,), (3,)], [1.0, 3.0, 5.0, 7.0], "target", "double")
    m = learners.LinearRegression(0.08, 1500).fit(df)
    assert m.predict(table(spark, [(4,)])).first()["predicted"] == pytest.approx(9, abs=0.02)


def test_neighbours_ties(spark, four):
    m = learners.KNearestNeighbors(3).fit(four)
    assert [r["predicted"] for r in m.predict(table(spark, [(-1.5, -1.5), (1.5, 1.5)])).orderBy("row_id").collect()] == [0, 1]
    assert learners.KNearestNeighbors(99).fit(four).predict(table(spark, [(0, 0)])).first()["predicted"] == 0


def test_bayes(spark, four):
    m = learners.GaussianNaiveBayes().fit(four)
    assert m.means == [[-1.5, -1.5], [1.5, 1.5]] and m.variances[0][0] == pytest.approx(0.250001) and m.priors[0] == pytest.approx(math.log(0.5))
    assert [r["predicted"] for r in m.predict(four).orderBy("row_id").collect()] == [0, 0, 1, 1]
    assert m.as_dataframe(spark).where("param = 'means'").count() == 4


def test_softmax_classifier(spark):
    df = table(spark, [(1, 0), (0.9, 0.1), (0, 1), (0.1, 0.9)], [0, 0, 1, 1])
    m = learners.SoftmaxClassifier(2, 2).fit(df, 0.25, 81)
    assert m.losses[0] == pytest.approx(math.log(2)) and m.losses[-1] < 0.4
    assert prof.accuracy(m.predict(df)).first()["accuracy"] == 1


def test_tree_and_forest(spark, xor):
    t = trees.DecisionTreeClassifier(4).fit(xor)
    assert t.node_count == 7 and t.nodes[0][:2] == (0, 0.5)
    assert prof.accuracy(t.predict(xor)).first()["accuracy"] == 1
    level = trees.DecisionTreeClassifier(4).fit(xor, one_task_bytes=0)
    assert prof.accuracy(level.predict(xor)).first()["accuracy"] == 1
    f = trees.RandomForestClassifier(5, 6, 2, 1, 2, 12345)
    a, b = f.fit(xor).trees, trees.RandomForestClassifier(5, 6, 2, 1, 2, 12345).fit(xor).trees
    assert a == b and {r["predicted"] for r in f.predict(xor).collect()} <= {10, 20}
    big = trees.RandomForestClassifier(3, 6, seed=1).fit(xor, one_task_bytes=0)
    assert big.tree_count == 3 and {r["predicted"] for r in big.predict(xor).collect()} <= {10, 20}


def test_large_forest_draws_features(spark):
    """Some roots may only look at the second feature, which tells less than the first."""
    df = table(spark, [(i, i % 7) for i in range(24)], [int(i >= 12) for i in range(24)])
    f = trees.RandomForestClassifier(12, 1, max_features=1, seed=3).fit(df, one_task_bytes=0)
    assert {t[0][0] for t in f.trees} == {0, 1}
    assert {t[0][0] for t in trees.RandomForestClassifier(12, 1, max_features=2, seed=3).fit(df, one_task_bytes=0).trees} == {0}


GOLD = {"sgd": (0.073142, 0.622678), "momentum": (0.137269, 0.565270), "nesterov": (0.192665, 0.518928), "rmsprop": (1.809096, 0.026477), "adam": (0.149688, 0.554620), "adamw": (0.149613, 0.554684)}


@pytest.mark.parametrize("name", train.OPTIMIZERS)
def test_optimizers(name):
    g = graph.Graph()
    x, w, y = g.variable(1, 1, "input"), g.variable(2, 1, parameter=True), g.variable(2, 1, "target")
    out = g.softmax(w, "output")
    g.cross_entropy(y, out, "cost")
    g.compile()
    data = np.zeros((1, 1)), np.array([[1.0, 0.0]])
    kind = train.Training(3, 1, 0.05, name, clip=1.0, weight_decay=0.01 if name == "adamw" else 0.0)
    rows = train.fit_arrays(g, kind, *data, *data)
    assert w.value[0, 0] == pytest.approx(GOLD[name][0], abs=1e-5) and w.value[1, 0] == pytest.approx(-w.value[0, 0])
    assert rows[-1][2] == pytest.approx(GOLD[name][1], abs=1e-5)
    assert x.op == "create"


def test_training_above_what_is_sent(spark, monkeypatch):
    """Rows read from files train the same network, to the bit, as rows sent whole; nothing of them is left behind."""
    gen = np.random.default_rng(5)
    x = np.vstack([(gen.integers(0, 256, (150, 6)).astype("f4") / np.float32(255)).astype(float), gen.random((90, 6))])
    rows = table(spark, gen.permutation(x).tolist(), (x[:, 0] * 2.99).astype(int).tolist()).repartition(3)
    kinds = {"a": train.Training(3, 7, 0.05), "b": train.Training(2, 50, 0.01, "adam")}

    def runs():
        got = train.train_runs(rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0"), lambda r: graph.residual_classifier(6, 3, 3, r), kinds, 3)
        return got.schema, sorted(map(tuple, got.collect()), key=lambda r: r[:2])

    folders = []
    monkeypatch.setattr(train, "new_folder", lambda s: folders.append(stored.new_folder(s)) or folders[-1])
    monkeypatch.setattr(train, "TEST_ROWS", 25)
    sent = runs()
    assert not folders and len(sent[1]) == 5
    monkeypatch.setattr(train, "MOST_BYTES", 0)
    assert runs() == sent and len(folders) == 1 and not os.path.exists(folders[0])
    for bad, why in ((rows.where("row_id < 0"), "at least one row"), (rows.withColumn("features", F.slice("features", 1, 5)), "were expected")):
        with pytest.raises(Exception, match=why):
            train.train_runs(bad, rows, lambda r: graph.residual_classifier(6, 3, 3, r), kinds, 3)


def test_packed_rows_keep_their_bits():
    byte = np.arange(256, dtype="f4")
    rows = [np.tile((byte / np.float32(255)).astype(float), 2), np.tile(byte.astype(float) / 255, 2), np.tile(byte, 2) * 1.5, np.linspace(-1, 1, 512), np.full(512, -0.0), np.tile([np.nan, np.inf, 1e300, 0.1], 128)]
    x = np.array(rows)
    packed = stored.pack(x)
    assert [p[0] for p in packed] == [0, 1, 2, 3, 2, 3]
    assert stored.unpack(packed, 512).tobytes() == x.tobytes()


def test_graph_gradients_and_column(spark):
    g = graph.residual_classifier(4, 3, 2)
    x, y = np.array([[0.1, 0.2, 0.3, 0.4]]), np.array([[1.0, 0.0]])
    feed = {id(g.input): x[:, :, None], id(g.target): y[:, :, None]}
    grad = graph.gradients(g.backward, graph.run(g.backward, feed))
    p = g.parameters()[0]
    step = 1e-5
    for i in range(p.rows):
        p.value[i, 0] += step
        up = graph.run(g.backward, feed)[id(g.cost)].sum()
        p.value[i, 0] -= 2 * step
        down = graph.run(g.backward, feed)[id(g.cost)].sum()
        p.value[i, 0] += step
        assert grad[id(p)][i, 0] == pytest.approx((up - down) / (2 * step), abs=1e-4)
    want = graph.run(g.forward, {id(g.input): x[:, :, None]})[id(g.output)].ravel()
    got = train.predict(g, table(spark, x.tolist())).first()["probabilities"]
    assert got == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        g.matmul(p, p)


def test_generator():
    g = rng.PCG32()
    assert [g.u32() for _ in range(3)] == [465482994, 3895364073, 1746730475]
    assert rng.PCG32().unit() == pytest.approx(0.10837865)
    assert rng.PCG32(42, 54).u32() == 0xA15C02B7
    orders = list(rng.transposition_orders(7, 2, rng.PCG32()))
    assert all(sorted(o) == list(range(7)) for o in orders)


def test_bootstrap_and_split(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id")
    w = rng.bootstrap_weights(df, 2, 3).groupBy("tree_id").agg(F.sum("weight").alias("s")).collect()
    assert all(3700 < r["s"] < 4300 for r in w)
    a, b = rng.split_rows(df, 0.8)
    assert a.count() + b.count() == 4000 and 3000 < a.count() < 3400


def test_profile(spark):
    df = table(spark, [(0, 1), (2, 3)], [1, 1])
    p = prof.profile(df).first()
    assert (p["n"], p["values"], p["min"], p["max"], p["mean"], p["variance"]) == (2, 4, 0, 3, 1.5, 1.25)
    h = {r["label"]: (r["n"], r["percent"]) for r in prof.histogram(df).collect()}
    assert h[1] == (2, 100) and h[0] == (0, 0) and len(h) == 10
    v = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
    assert tuple(prof.percentile(v, "v", [0.5, 0.95]).first()) == (20, 40)
    assert prof.mini_batches(spark.range(23), 5, ["id"]).count() == 20


def test_batches_of_wide_rows(spark):
    """Rows too wide for the ranges of narrow ones to be cut alike: none is lost, positions are dense and in order."""
    rows = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).alias("key"), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.rand() + i).alias("wide"))
    out = prof.mini_batches(rows, 50, ["key"]).select("key", "pos", "batch", F.size("wide").alias("w"))
    got = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m"), F.max("batch").alias("b"), F.min("w").alias("w")).first()
    assert tuple(got) == (30_000, 30_000, 29_999, 599, 200)
    first = [r["key"] for r in out.where("pos < 5").orderBy("pos").collect()]
    assert first == sorted(r[0] for r in rows.select("key").collect())[:5]


def test_percentiles_equal_those_of_sql(spark):
    """Nulls, ties, a null group, a group without values, one value far more frequent than others."""
    rows = [(None if i % 7 == 0 else i % 3, None if i % 5 == 0 else float((i * 37) % 101)) for i in range(900)] + [(9, None), (8, 1.5)] + [(2, 50.0)] * 500
    df = spark.createDataFrame(rows, "g int, v double")
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    names = ["p0", "p10", "p50", "p95", "p100"]
    want = df.groupBy("g").agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)").alias(n) for q, n in zip(qs, names)])
    got = prof.percentile(df, "v", qs, ["g"])
    assert got.columns == ["g", *names] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert tuple(prof.percentile(df.limit(0), "v", [0.5]).first()) == (None,) and prof.percentile(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_another_width_raises(spark, four):
    narrow = spark.createDataFrame([(0, [1.0])], "row_id long, features array<double>")
    for scored in (preprocessing.StandardScaler().fit(four).transform(narrow), learners.GaussianNaiveBayes().fit(four).predict(narrow), narrow.select(vec.relu_grad("features", vec.vector([1, 2]), vec.vector([1, 2]))), narrow.select(vec.copy("features", vec.fill(2)))):
        with pytest.raises(Exception, match="entries|differ in length"):
            scored.collect()
    with pytest.raises(ValueError):
        trees.RandomForestClassifier(2, max_features=9).fit(four)
    absent = spark.createDataFrame([(0, None)], "row_id long, features array<double>")
    assert preprocessing.StandardScaler().fit(four).transform(absent).first()["scaled"] is None


def test_softmax_is_linear_in_the_width(spark):
    x = np.random.default_rng(1).normal(size=(3, 3000))
    got = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, f array<double>").select("i", vec.softmax("f").alias("p")).orderBy("i").collect()
    e = np.exp(x - x.max(axis=1, keepdims=True))
    assert np.allclose([r["p"] for r in got], e / e.sum(axis=1, keepdims=True))


def test_parameter_order_and_checkpoint_bytes():
    """Last inputs first: the golden order of shapes, and the bytes of a small checkpoint."""
    g = graph.residual_classifier(8, 4, 3)
    assert [(p.rows, p.cols) for p in g.parameters()] == [(3, 1), (4, 1), (4, 1), (4, 8), (4, 4), (3, 4)]
    data = checkpoints.encode([np.array([[1.0, -2.0]])])
    assert data == b"KMLCP01" + bytes([1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 2, 0, 0, 0]) + bytes([0, 0, 128, 63, 0, 0, 0, 192])


def test_gradients_accumulate():
    g = graph.residual_classifier(4, 3, 2)
    x, y = np.random.default_rng(0).normal(size=(6, 4, 1)), np.eye(2)[[0, 1, 0, 1, 1, 0]][:, :, None]
    feed = lambda a, b: {id(g.input): x[a:b], id(g.target): y[a:b]}
    g.clear_gradients()
    g.accumulate(feed(0, 2))
    g.accumulate(feed(2, 6))
    twice = [p.grad for p in g.parameters()]
    g.clear_gradients()
    g.accumulate(feed(0, 6))
    assert all(np.allclose(a, p.grad) for a, p in zip(twice, g.parameters())) and any(np.abs(a).sum() > 0 for a in twice)


def test_one_stream_from_weights_to_orders():
    one, two = rng.PCG32(), rng.PCG32()
    graph.residual_classifier(4, 3, 2, one)
    order = next(rng.transposition_orders(20, 1, one))
    assert order.tolist() != next(rng.transposition_orders(20, 1, two)).tolist()


def test_metrics_log(tmp_path, spark):
    """Rows are in the file as soon as they are known; progress lines go along."""
    said = []
    log = metrics.MetricsLog(str(tmp_path / "log.csv"), tests=8, progress=said.append)
    log((1, 0.5, 0.25, 0.01))
    assert (tmp_path / "log.csv").read_text().splitlines() == [metrics.HEADER, "1,0.500000,0.250000,0.01000000"]
    log.close()
    assert said == ["Epoch 1: test 4/8 (50.00%), cost 0.250000"]


def test_benchmark_command(spark, tmp_path):
    out = str(tmp_path / "r.json")
    assert benchmark.main(["--output", out, "--size", "0"]) == 2 and benchmark.main(["--size", "4"]) == 2 and benchmark.main(["--output", out, "--size", "x"]) == 2
    assert benchmark.main(["--output", out, "--size", "8", "--iterations", "2"], spark) == 0
    report = __import__("json").loads(open(out).read())
    assert report["metrics"]["iterations"] == 2 and 0 <= report["metrics"]["maximum_absolute_error"] < 1e-5
    assert benchmark.main(["--output", str(tmp_path / "no" / "r.json"), "--size", "2", "--iterations", "1"], spark) == 1


def test_raw_files(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    np.arange(6, dtype="<f4").tofile(path)
    assert [r["features"] for r in raw.read_matrix(spark, path, 2, 3).orderBy("row_id").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert raw.read_matrix(spark, path, 3, 3, "permissive").orderBy("row_id").collect()[2]["features"] == [0, 0, 0]
    assert raw.read_matrix(spark, path, 1, 3, "permissive").count() == 1
    with pytest.raises(ValueError):
        raw.read_matrix(spark, path, 3, 3)
    assert raw.read_floats(spark, path).count() == 6
    raw.write_matrix(raw.read_matrix(spark, path, 2, 3), path + "2")
    assert np.fromfile(path + "2", "<f4").tolist() == list(range(6))


@pytest.mark.parametrize("body", ["a,b\n1,2\n", "epoch,accuracy,cost,learning_rate\n", "epoch,accuracy,cost,learning_rate\n1,x,1,1\n", "epoch,accuracy,cost,learning_rate\n1,2\n", "epoch,accuracy,cost,learning_rate\n1,1,1,1\nepoch,accuracy,cost,learning_rate\n"])
def test_bad_metrics(spark, tmp_path, body):
    (tmp_path / "m.csv").write_text(body)
    with pytest.raises(ValueError):
        metrics.read_metrics(spark, str(tmp_path / "m.csv"))


def test_metrics_and_reports(spark, tmp_path):
    df = train.metrics_table(spark, [(1, 0.5, 0.9, 0.01), (2, 0.75, 0.6, 0.01)])
    metrics.write_metrics(df, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text().splitlines()[1] == "1,0.500000,0.900000,0.01000000"
    back = metrics.read_metrics(spark, str(tmp_path / "m.csv"))
    assert reports.training_report(back, str(tmp_path / "t.html"))["accuracy"] == 75
    images = spark.createDataFrame([(0, [0.5] * 784, 3)], "row_id long, features array<double>, label int")
    assert reports.dataset_report(images, str(tmp_path / "d.html"), 4)["mean"] == 0.5
    assert len(reports.terminal_image(images, 0).splitlines()) == 28
    r = reports.benchmark(spark, "range", lambda: spark.range(10), 10, 2, 1)
    reports.write_benchmark(r, str(tmp_path / "b.json"))
    with pytest.raises(ValueError):
        reports.write_benchmark(r | {"metrics": {"x": float("nan")}}, str(tmp_path / "b.json"))


def test_checkpoints(spark, tmp_path):
    params = [np.array([[1.25], [-3.5]], np.float32)]
    data = checkpoints.encode(params)
    assert len(data) == 31 and checkpoints.decode(data, [(2, 1)])[0].tolist() == [[1.25], [-3.5]]
    for bad, shapes in ((data, [(1, 2)]), (data[:-1], [(2, 1)]), (b"x" + data, [(2, 1)])):
        with pytest.raises(ValueError):
            checkpoints.decode(bad, shapes)
    checkpoints.save_table(spark, params, str(tmp_path / "p"))
    assert checkpoints.load_table(spark, str(tmp_path / "p"), [(2, 1)])[0].tolist() == [[1.25], [-3.5]]


def test_registry(spark):
    rows = [("b", "Classification", ["float32"], ["metal"], 4, 100, True, False), ("a", "Classification", ["float32"], ["metal"], 4, 100, True, False)]
    r = contracts.Registry(spark).register(spark.createDataFrame(rows, contracts.CAPABILITY))
    assert r.select("Classification", "float32", "metal", rank=4)["model_id"] == "a" and r.require("b")["model_id"] == "b"
    for call in (lambda: r.require("c"), lambda: r.select("Classification", "int8", "metal")):
        with pytest.raises(contracts.ContractError) as e:
            call()
        assert e.value.code == "CapabilityNotFound"
    with pytest.raises(contracts.ContractError):
        r.register(spark.createDataFrame(rows[:1], contracts.CAPABILITY))
    fmt = {"version": 1, "identifier": "x", "sample_count": 2, "samples": ([2, 3], [], "float32", "RowMajor", "cpu-scalar", "Owned")}
    contracts.validate_dataset_format(spark, fmt)
    with pytest.raises(contracts.ContractError):
        contracts.validate_dataset_format(spark, fmt | {"sample_count": 3})
    with pytest.raises(contracts.ContractError):
        contracts.validate_checkpoint_format({"version": 2, "includes_parameters": True})


def test_stream_scoring(spark, tmp_path, four):
    from vectorloom.streaming import scoring

    four.write.parquet(str(tmp_path / "in"))
    m = learners.GaussianNaiveBayes().fit(four)
    q = scoring.score_stream(spark, str(tmp_path / "in"), "row_id long, features array<double>, label int", m.predict).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").where("predicted = label").count() == 4


def test_follow_metrics(spark, tmp_path):
    """Each new file is checked like one that is read whole: header, blank lines, further columns."""
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.csv").write_text(metrics.HEADER + "\n1,0.5,0.9,0.01\n\n2,0.75,0.6,0.01,more\n")
    follow = lambda: scoring.follow_metrics(spark, str(folder), lambda batch, n: seen.extend(tuple(r) for r in batch.collect()), str(tmp_path / "state")).awaitTermination()
    follow()
    assert sorted(seen) == [(1, 0.5, 0.9, 0.01), (2, 0.75, 0.6, 0.01)]
    (folder / "b.csv").write_text("epoch,loss\n1,2\n")
    with pytest.raises(Exception, match="header"):
        follow()
