"""Near-duplicate embeddings against all pairs in double precision."""

import numpy as np
import pytest

from tests.llm.test_text_operators import components


def cases(seed=7):
    rng = np.random.default_rng(seed)
    rows, i = [], 0

    def put(v, label):
        nonlocal i
        rows.append((i, None if v is None else [None if x is None else float(x) for x in v], label))
        i += 1

    for _ in range(150):
        put(rng.normal(size=16), int(rng.integers(0, 3)))
    for k in range(40):  # near copies at all distances around the threshold
        v = rng.normal(size=16)
        for e in (0, 0.05, 0.1, 0.12, 0.2):
            put(v + e * rng.normal(size=16), k % 3)
    v = rng.normal(size=16)
    for _ in range(60):
        put(v, 1)  # exact copies
    for _ in range(80):
        put(v + 0.03 * rng.normal(size=16), 1)
    put(3 * v, 1)
    put(v, 2)
    for odd in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, v[:8], v[:8]):
        put(odd, 1)
    put(v, None)
    rows.append((3, rows[3][1], rows[3][2]))
    return rows


def brute(rows):
    unit = []
    for _, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(1)
        ok = bool(v) and label is not None and np.isfinite(a).all() and (a != 0).any()
        unit.append(a / np.linalg.norm(a) if ok else None)
    links, pairs = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    roots = components(len(rows), pairs)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    return sorted((rows[i][0], links[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("list_size,tile", [(2048, 2048), (20, 30)])
def test_links_and_components(spark, list_size, tile):
    from voxmill.llm.embed_dedup import link_embeddings

    rows = cases()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, vec string, links int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    got = sorted(tuple(r) for r in link_embeddings(df, list_size=list_size, tile=tile, sample=100).collect())
    assert got == brute(exact)


def test_empty_and_nothing_valid(spark):
    from voxmill.llm.embed_dedup import link_embeddings

    schema = "vec_id long, embedding array<float>, label int"
    assert link_embeddings(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in link_embeddings(spark.createDataFrame([(4, None, 1)], schema)).collect()] == [(4, 0, 4, True)]


@pytest.mark.parametrize("sample", [20_000, 60])
def test_every_length_is_searched(spark, sample):
    from voxmill.llm.embed_dedup import link_embeddings

    rng = np.random.default_rng(4)
    rows = []
    for length in range(1, 91):
        v = rng.normal(size=length)
        for e in (0, 0.001, 0.002):  # near copies, none equal bit by bit
            rows.append((len(rows), [float(x) for x in v + e * rng.normal(size=length)], length % 2))
    want = brute(rows)
    assert sum(r[1] for r in want) >= 2 * 3 * 89
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), sample=sample).collect()
    assert sorted(map(tuple, got)) == want


def test_tiny_and_huge_vectors_and_null_ids(spark):
    from voxmill.llm.embed_dedup import link_embeddings

    rows = [(1, [1e-200, 1e-200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, 1e200], 0), (4, [1e200, 1.01e200], 0), (5, [5e-324, 0.0], 1), (6, [1e308, 0.0], 1), (7, [0.0, 1e308], 1), (8, [0.0, 0.0], 1), (None, [3.0, 3.0], 0), (None, [2.0, 0.0], 2), (9, [0.0, 3.0], 2)]
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 4, 1, False), (None, 4, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True), (9, 0, 9, True)]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r[0], r[1], r[2], bool(r[3])) for r in got), key=key) == sorted(want, key=key)


def moved(spark, since):
    """Bytes that stages from ``since`` on wrote to shuffles and tables, and the number of the next stage."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    empty = spark.sparkContext._jvm.java.util.ArrayList()
    stages = sc.statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), empty)
    own = [s for s in (stages.apply(i) for i in range(stages.size())) if s.stageId() >= since]
    return sum(s.shuffleWriteBytes() + s.outputBytes() + s.diskBytesSpilled() for s in own), max((s.stageId() for s in own), default=since - 1) + 1


def test_disk_follows_the_input_where_vectors_have_no_structure(spark, tmp_path):
    from voxmill.llm.embed_dedup import link_embeddings

    rng = np.random.default_rng(3)
    x = rng.normal(size=(24_000, 64)).astype(np.float32)
    label = np.arange(len(x)) % 2
    x[3000:5500] = x[0] + 0.02 * rng.normal(size=(2500, 64))  # a dense group of each label
    x[9000:9400:2] = x[8000:8400:2] + 0.3 * rng.normal(size=(200, 64))  # pairs around the threshold
    x[12_000:12_200] = x[11_000]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "embeddings.parquet").glob("*.parquet"))
    _, before = moved(spark, 0)
    got = {r[0]: tuple(r[1:]) for r in link_embeddings(spark.read.parquet(path)).collect()}
    assert moved(spark, before)[0] < 4 * size

    want = {}
    for k in (0, 1):
        ids = np.flatnonzero(label == k)
        u = x[ids].astype(float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        near = u @ u.T >= 0.93
        left = np.ones(len(ids), bool)
        for i in range(len(ids)):
            if left[i]:
                group = near[i]
                while (more := near[group].any(0)).sum() > group.sum():
                    group = more
                left &= ~group
                want |= {int(j): (int(n) - 1, int(ids[i]), bool(j == ids[i])) for j, n in zip(ids[group], near[group].sum(1))}
    assert got == want
    assert sum(n > 0 for n, _, _ in want.values()) > 2700
