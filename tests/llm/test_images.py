import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import clusters, fuzzy, images, neighbours, overlap, queries, quota
from vectorloom.llm.components import components
from vectorloom.llm.near import PLACEMENTS, closest, moved

SCHEMA = "row_id long, features array<float>, writer_id long, source string, rep long, label string, k string"


def drawings(n, seed=0, spread=0.0):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 28, 28))
    for i in range(n):
        for _ in range(5):
            y, c = rng.integers(6, 20, 2)
            x[i, y : y + 3, c : c + 3] = rng.integers(100, 255)
    return np.clip(x.reshape(n, 784) + rng.normal(0, spread, (n, 784)) * (x.reshape(n, 784) > 0), 0, 255).round().astype(np.uint8)


def frame(spark, rows):
    """rows: (id, levels or None); extra columns clash with names used inside."""
    return spark.createDataFrame([(i, None if v is None else [float(p) / 255 for p in v], None, None, 1, "x", "y") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def base():
    return drawings(12)


@pytest.fixture(scope="module")
def dirty(base):
    """Ids 0-5 in two clusters of three, 6 a lone image, 7 moved, 8 an exact copy of 6; then everything that is invalid."""
    rng = np.random.default_rng(1)
    noisy = lambda v: np.clip(v.astype(int) + rng.integers(-20, 21, 784) * (v > 0), 0, 255)
    rows = [(0, base[0]), (1, noisy(base[0])), (2, noisy(base[0])), (3, base[1]), (4, noisy(base[1])), (5, noisy(base[1])), (6, base[2]), (7, moved(base[2][None], 1, -1)[0]), (8, base[2])]
    wrong = [(20, None), (21, base[3][:100]), (None, base[4]), (22, np.r_[base[5][:783].astype(float), np.nan]), (23, np.r_[base[5][:783].astype(float), np.inf]), (24, np.zeros(0)), (0, base[0])]
    return rows + wrong


def brute(rows, reach, placed):
    ok = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and len(v) == 784 and np.isfinite(v).all()}
    ids = sorted(ok)
    out = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = ok[a][None], ok[b][None]
            spots = PLACEMENTS if placed else [(0, 0)]
            if min(min(((moved(x, *p) - y) ** 2).sum(), ((x - moved(y, *p)) ** 2).sum()) for p in spots) <= reach:
                out.add((a, b))
    return out


def test_levels(spark):
    x = spark.createDataFrame([(0, [0.5] * 784), (1, [128.0] * 784), (2, [-1.0] + [1.5] * 783)], "row_id long, features array<float>")
    got = {r["row_id"]: images.matrix(__import__("pyarrow").array([r["levels"]]), 784)[0] for r in images.sketched(images.deliveries(x), images.spectrum).collect()}
    assert got[0][0] == 128 and got[1][0] == 128 and got[2][0] == 0 and got[2][1] == 255


def test_closest_is_exact(base):
    x = base.astype(np.float32)
    d = closest(x, x, 80_000)
    for a in range(4):
        for b in range(4):
            want = min(min(((moved(x[a : a + 1], *p) - x[b]) ** 2).sum(), ((x[a] - moved(x[b : b + 1], *p)) ** 2).sum()) for p in PLACEMENTS)
            assert d[a, b] == want


def test_clusters(spark, dirty):
    links = brute(dirty, 450_000, False)
    got = {(r["row_id"], r["cluster_id"]) for r in clusters.image_clusters(frame(spark, dirty)).collect()}
    label = {i: i for pair in links for i in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    size = {v: sum(1 for x in label.values() if x == v) for v in label.values()}
    assert got == {(i, v) for i, v in label.items() if size[v] >= 3}
    report = clusters.cluster_report(frame(spark, dirty), spark.createDataFrame(sorted(got), "row_id long, cluster_id long")).collect()
    assert {(r["cluster_id"], r["size"]) for r in report} == {(v, size[v]) for _, v in got} and all(1 <= r["rank"] <= 3 for r in report)


def test_clusters_of_one_frequency(spark):
    """Images whose whole difference lies in one low frequency, far beyond what groups them, are linked up to the reach."""
    base = np.full(784, 120.0)
    wave = images.cosine_basis(64)[:, 2]
    rows = [(i, np.round(base + wave * length)) for i, length in enumerate((0, 660, -660))]
    want = brute(rows, 450_000, False)
    assert want == {(0, 1), (0, 2)} and clusters.GROUPED < 430_000
    assert {tuple(r) for r in clusters.image_clusters(frame(spark, rows)).collect()} == {(0, 0), (1, 0), (2, 0)}
    small = [(i, np.round(base + wave * length)) for i, length in enumerate((0, 400, -400))]
    assert clusters.image_clusters(frame(spark, small)).count() == 3


def test_clusters_against_brute_force(spark):
    """Noise of every size around a few drawings, so that many pairs lie on either side of the reach."""
    rng = np.random.default_rng(9)
    rows = []
    for i, v in enumerate(drawings(5, 11)):
        for j in range(12):
            noise = rng.normal(0, rng.uniform(8, 22), 784)
            rows.append((100 * i + j, np.clip(np.round(v + noise), 0, 255)))
    links = brute(rows, 450_000, False)
    label = {i: i for i, _ in rows}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    size = {v: sum(1 for x in label.values() if x == v) for v in label.values()}
    got = {tuple(r) for r in clusters.image_clusters(frame(spark, rows)).collect()}
    want = {(i, v) for i, v in label.items() if size[v] >= 3}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_clusters_in_blocks(spark):
    """A crowded cell cut into blocks gives the same clusters."""
    v = drawings(1)[0]
    rows = [(i, np.clip(v.astype(int) + (np.arange(784) % 40 == i % 40) * 9, 0, 255)) for i in range(40)]
    got = clusters.image_clusters(frame(spark, rows), block=8).collect()
    assert {(r["row_id"], r["cluster_id"]) for r in got} == {(i, 0) for i in range(40)}


def test_fuzzy(spark, dirty):
    found = fuzzy.fuzzy_pairs(frame(spark, dirty))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute(dirty, 80_000, True) and len(got) == len(set(got))
    groups = {r["row_id"]: (r["group_id"], r["links"]) for r in fuzzy.fuzzy_groups(frame(spark, dirty)).collect()}
    assert groups[7][0] == groups[8][0] == 6
    assert {i: n for i, (_, n) in groups.items()} == {i: sum(i in p for p in got) for i in {i for p in got for i in p}}


def faint():
    """Twelve images with about 2 % of their pixels lit, at 60."""
    rng = np.random.default_rng(3)
    x = np.zeros((12, 784), np.uint8)
    for row in x:
        row[rng.choice(784, rng.integers(8, 17), replace=False)] = 60
    return [(i, v) for i, v in enumerate(x)]


def test_faint_images(spark):
    """Images of little ink, which differ by much of what they have, are compared like any others."""
    rows = faint()
    want = brute(rows, 80_000, True)
    assert len(want) >= 14
    assert {tuple(r) for r in fuzzy.fuzzy_pairs(frame(spark, rows)).collect()} == want
    got = overlap.cross_split_pairs(frame(spark, rows[:6]), frame(spark, rows[6:]))
    assert {(r["train_row_id"], r["test_row_id"]) for r in got.collect()} == {(a, b) for a, b in want if a < 6 <= b}


def test_amplitudes_bound_the_distance(base):
    """No near-same pair is further apart by its amplitudes than the bound allows, with ink at the edge too."""
    rng = np.random.default_rng(4)
    full = rng.integers(0, 256, (6, 784)).astype(np.uint8)
    for one in [*base[:4], *full]:
        for place in PLACEMENTS:
            two = np.clip(moved(one[None], *place)[0].astype(int) + rng.integers(-9, 10, 784), 0, 255).astype(np.uint8)[None]
            d = ((moved(one[None].astype(int), *place) - two) ** 2).sum()
            edge = max(images.edges(one[None])[0], images.edges(two)[0])
            apart = np.sqrt(((images.amplitudes(one[None]) - images.amplitudes(two)) ** 2).sum())
            assert apart <= np.sqrt(d) + edge + 0.1
            s, t = (images.spectrum(x)[0].astype(float) for x in (one[None], two))
            assert images.SPECTRUM_STEP * np.sqrt(((s - t)[:84] ** 2).sum()) <= np.sqrt(d) + images.SPECTRUM_STEP * np.sqrt(84) + images.EDGE_STEP * max(s[84], t[84])


def test_many_equal_images(spark):
    """5,000 equal images and one near them: groups count their links, pairs are made in parts, nothing is lost."""
    v = drawings(1)[0]
    near = v.copy()
    near[300] ^= 1
    rows = frame(spark, [(7, near), (8, v)]).unionAll(frame(spark, [(0, v)]).select(F.explode(F.sequence(F.lit(100).cast("long"), F.lit(5097).cast("long"))).alias("row_id"), *SCHEMA.replace(",", "").split()[2::2]))
    groups = fuzzy.fuzzy_groups(rows).groupBy("group_id", "links").count().collect()
    assert {tuple(r) for r in groups} == {(7, 4999, 5000)}
    found, same = fuzzy.fuzzy_classes(rows)
    assert found.count() == 1 and same.count() == 4998
    few = rows.where("row_id < 150")
    pairs = fuzzy.with_copies(found.select("a", "b").unionAll(same.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()), same.where("row_id < 150"), limit=7).where("a <> b or left < right")
    n = few.count()
    assert pairs.select(F.least("left", "right"), F.greatest("left", "right")).distinct().count() == pairs.count() == n * (n - 1) // 2


def test_golay_covers_the_space():
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    low, high, error = fuzzy._tables()
    assert len(np.unique(error)) == 2048 and max(bin(e).count("1") for e in error) == 3
    code = words ^ error[low[words & 4095] ^ high[words >> 12]]
    assert (low[code & 4095] ^ high[code >> 12] == 0).all()
    assert (fuzzy.decode(code ^ 0b10010001) == fuzzy.decode(code)).all()


def test_overlap(spark, dirty, base):
    test = [(100, base[0]), (101, moved(base[1][None], 0, 1)[0]), (102, base[9]), (103, None), (104, base[2])]
    got = overlap.cross_split_pairs(frame(spark, dirty), frame(spark, test))
    both = brute(dirty + test, 80_000, True)
    want = {(a, b) for a, b in both if a < 100 <= b}
    rows = got.collect()
    assert {(r["train_row_id"], r["test_row_id"]) for r in rows} == want and len(rows) == len(want)
    assert all(0 < r["coverage"] <= 1 for r in rows)
    report = overlap.overlap_report(got, frame(spark, dirty), frame(spark, test)).collect()
    assert sum(r["pairs"] for r in report if r["split"] == "test") == len(want)


def test_empty_tables(spark, dirty):
    empty = frame(spark, [])
    assert clusters.image_clusters(empty).count() == 0
    assert fuzzy.fuzzy_pairs(empty).count() == 0
    assert overlap.cross_split_pairs(empty, empty).count() == 0
    assert overlap.cross_split_pairs(frame(spark, dirty), empty).count() == 0
    asked = spark.createDataFrame([(1,)], "query long")
    assert neighbours.nearest(neighbours.both_splits(empty, empty), asked).count() == 0


def test_nearest(spark):
    x = drawings(300, 3, 5)
    rows = [(i, v) for i, v in enumerate(x)] + [(400, None), (5, x[5])]
    asked = spark.createDataFrame([(i,) for i in (0, 5, 77, 5, 400, None)], "query long")
    got = neighbours.nearest(neighbours.both_splits(frame(spark, rows[:200]), frame(spark, rows[200:])), asked, 5)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    assert set(found) == {0, 5, 77}
    hits = 0
    for q, f in found.items():
        d = ((x.astype(int) - x[q].astype(int)) ** 2).sum(1)
        d[q] = 2**60
        best = sorted(range(300), key=lambda i: (d[i], i))[:5]
        hits += len(set(best) & {n for n, _ in f.values()})
        assert all(d[n] == dist for n, dist in f.values())
    assert hits >= 14


def exact_neighbours(rows, k=10):
    """{id: [(neighbour, distance)]} by brute force over (id, levels), ties to the smaller id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows]).astype(np.int64)
    out = {}
    for n, i in enumerate(ids.tolist()):
        d = ((x - x[n]) ** 2).sum(1)
        out[i] = [(int(ids[j]), int(d[j])) for j in np.lexsort((ids, d)) if j != n][:k]
    return out


def test_graph_query_is_exact(spark, tmp_path):
    """All images, twenty copies of one among them, against brute force: neighbours, ranks and ties."""
    x = drawings(130, 4, 12)
    rows = [(1000 - 7 * i, v) for i, v in enumerate(x)] + [(2000 - i, x[3]) for i in range(20)]
    frame(spark, [*rows[:90], rows[0], (5, None)]).write.parquet(f"{tmp_path}/train_images.parquet")
    frame(spark, rows[90:]).write.parquet(f"{tmp_path}/test_images.parquet")
    got = {}
    for r in queries.p4_graph(spark, str(tmp_path)).orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append(r["neighbour"])
    assert got == {i: [n for n, _ in near] for i, near in exact_neighbours(rows).items()}


def test_nearest_among_many_copies(spark):
    """A group of copies larger than the graph's lists: the smallest ids come out, for a copy and for an image beside it."""
    x = drawings(60, 8, 12)
    beside = x[0].copy()
    beside[beside > 0] -= 1
    rows = [(500 + i, v) for i, v in enumerate(x)] + [(1000 - i, x[0]) for i in range(60)] + [(3, beside)]
    asked = [3, 500, 970, 1000, 530]
    got = {}
    for r in neighbours.nearest(neighbours.both_splits(frame(spark, rows[:80]), frame(spark, rows[80:])), spark.createDataFrame([(i,) for i in asked], "query long")).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["neighbour"], r["distance"]))
    want = exact_neighbours(rows)
    assert got == {i: want[i] for i in asked}


def test_cells_in_blocks(spark, monkeypatch):
    """Crowded cells cut into blocks give the same neighbours; several cells miss few."""
    x = drawings(300, 6, 12)
    images = neighbours.both_splits(frame(spark, list(enumerate(x))), frame(spark, []))
    want = exact_neighbours(list(enumerate(x)), 5)

    def lists():
        got = {}
        for r in neighbours.all_nearest(images, 5).orderBy("row_id", "rank").collect():
            got.setdefault(r["row_id"], []).append((r["neighbour"], r["distance"]))
        return got

    monkeypatch.setattr(neighbours, "LEAF", 25)
    assert lists() == want
    monkeypatch.setattr(neighbours, "CELL", 60)
    got = lists()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.7 * 1500 and neighbours.all_nearest(images.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


PLAN = "plan_id int, label int, target_share double, sample_size long, min_rows long"


def sample(spark, counts, plans):
    pool = spark.createDataFrame([(1000 * lab + i, lab) for lab, n in counts.items() for i in range(n)], "row_id long, label int")
    targets = spark.createDataFrame(plans, PLAN)
    drawn = {}
    for r in quota.quota_sample(pool, targets).collect():
        drawn.setdefault((r["plan_id"], r["label"]), set()).add(r["row_id"])
    report = {(r["plan_id"], r["label"]): r for r in quota.quota_report(pool, targets).collect()}
    return {k: len(v) for k, v in drawn.items()}, report


def test_quota_shares_floors_and_shortage(spark):
    n, report = sample(spark, {0: 500, 1: 500, 2: 4}, [(1, 0, 0.5, 100, 0), (1, 1, 0.4, 100, 0), (1, 2, 0.1, 100, 0), (2, 0, 1.0, 50, 0), (2, 1, 0.0, 50, 7), (3, 2, 1.0, 10, 0), (3, 2, 1.0, 10, 0)])
    assert n[1, 2] == 4 and sum(v for k, v in n.items() if k[0] == 1) == 100 and abs(n[1, 0] / n[1, 1] - 1.25) < 0.05
    assert n[2, 1] == 7 and n[2, 0] == 43 and n[3, 2] == 4
    assert not report[1, 2]["met"] and report[1, 2]["available"] == 4 and report[2, 1]["met"] and not report[3, 2]["met"]


def test_quota_floors_that_take_seats(spark):
    """Floors of other labels take the seats of a label with rows enough: its target is missed, though it is not short."""
    n, report = sample(spark, {0: 200, 1: 200, 2: 200}, [(1, 0, 0.5, 100, 0), (1, 1, 0.25, 100, 40), (1, 2, 0.25, 100, 40)])
    assert n == {(1, 0): 20, (1, 1): 40, (1, 2): 40}
    got = {k: (r["wanted"], r["drawn"], r["met"], r["short"]) for k, r in report.items()}
    assert got == {(1, 0): (50, 20, False, False), (1, 1): (40, 40, True, False), (1, 2): (40, 40, True, False)}


def test_quota_edges(spark):
    n, report = sample(spark, {0: 5}, [(1, 0, None, 3, None), (1, 9, 0.5, 3, 1), (None, 0, 1.0, 3, 0), (2, 0, 0.1, 2, 4)])
    assert n == {(2, 0): 4} and report[1, 9]["available"] == 0 and not report[1, 9]["met"]
    pool = spark.createDataFrame([], "row_id long, label int")
    assert quota.quota_sample(pool, spark.createDataFrame([], PLAN)).count() == 0


def test_current_labels(spark):
    rows = [(1, 3.0, "2020-01-02"), (1, 4.0, "2020-01-01"), (2, float("nan"), "2020-01-02"), (2, 1.0, "2020-01-01"), (3, 2.5, None), (4, None, "2020-01-01"), (5, 11.0, None), (6, 0.0, None), (6, 0.0, None), (None, 1.0, None)]
    labels = spark.createDataFrame(rows, "row_id long, label float, at string").withColumn("labelled_at", F.to_timestamp("at"))
    assert {tuple(r) for r in quota.usable(quota.current_labels(labels)).collect()} == {(1, 3), (6, 0)}
