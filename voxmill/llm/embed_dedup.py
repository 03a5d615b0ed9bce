"""Embedding near-duplicates by product quantisation with exact bounds and rerank."""

from __future__ import annotations

from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._common import connected_components, drop_tables, materialize, with_row_key

#: Rows of a block that are decoded together, columns that meet them (both fewer of long vectors), rows of one matrix product.
_ROWS, _COLS, _STEP = 8192, 2048, 256


class Quantiser(NamedTuple):
    """``centroids``: coarse. ``books``: (subspace, word, dim)."""

    centroids: np.ndarray
    books: np.ndarray


def _nearest(x: np.ndarray, c: np.ndarray, chunk: int = 4096) -> np.ndarray:
    squares = (c * c).sum(1)[None]
    return np.concatenate([(squares - 2 * x[i : i + chunk] @ c.T).argmin(1) for i in range(0, len(x), chunk)])


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds if len(x) > len(c) else 0):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit_quantiser(sample: np.ndarray, cells: int, width: int = 2, words: int = 256, seed: int = 9) -> Quantiser:
    """Coarse centroids and books of residuals, ``width`` components a subspace, from a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = _kmeans(sample, cells, rng)
    subspaces = -(-sample.shape[1] // width)
    rest = (sample - c[_nearest(sample, c)])[:8192]
    rest = np.pad(rest, ((0, 0), (0, width * subspaces - sample.shape[1])))
    books = [_kmeans(rest[:, s * width : (s + 1) * width], words, rng) for s in range(subspaces)]
    most = max(map(len, books))
    return Quantiser(c, np.stack([np.vstack([b, np.full((most - len(b), width), 1e6)]) for b in books]))


def encode(q: Quantiser, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, code and distance to what the code decodes to (rounded up) of each unit vector."""
    subspaces, _, width = q.books.shape
    cell = _nearest(x.astype(np.float32), q.centroids.astype(np.float32))
    rest = np.pad(x - q.centroids[cell], ((0, 0), (0, width * subspaces - x.shape[1])))
    near, books = rest.astype(np.float32), q.books.astype(np.float32)  # any code would do, for its error is taken in double precision
    code = np.stack([_nearest(near[:, s * width : (s + 1) * width], book) for s, book in enumerate(books)], 1).astype(np.uint8)
    err = np.sqrt(((x - decode(q, cell, code)) ** 2).sum(1))
    return cell, code, (err * (1 + 1e-6) + 1e-6).astype(np.float32)


def _residual(q: Quantiser, code: np.ndarray) -> np.ndarray:
    flat = q.books[np.arange(len(q.books))[None], code]
    return flat.reshape(len(code), -1)[:, : q.centroids.shape[1]]


def decode(q: Quantiser, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
    return q.centroids[cell] + _residual(q, code)


def reach(threshold: float) -> float:
    """Greatest distance of two unit vectors whose cosine is ``threshold`` or more."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9


def _batches_of_lengths(sizes, sample: int, floats: int = 65_536) -> list[dict[int, int]]:
    """Lengths to share a job, with their cells: ``sample`` vectors together at most, or a length of its own; ``floats`` bounds their models."""
    out, left, room = [], 0, 0
    for dim, cells, n in sorted(sizes):
        if n > left or dim > room:
            out.append({})
            left, room = sample, floats
        out[-1][dim] = cells
        left, room = left - n, room - dim
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; by the largest component first, so that squares of finite numbers neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None] + 0.0  # no negative zeros


def _by_length(column):
    """Rows and components of the vectors of an Arrow column by length; only those that are finite and not zero."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
    start = np.cumsum(size) - size
    for k in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == k)
        x = flat.reshape(-1, k) if len(at) * k == len(flat) else flat[start[at][:, None] + np.arange(k)]
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        if ok.any():
            yield at[ok], x[ok]


def _row_keys(batches):
    """From (f, r, vec_id, label, x) to rows with 128 bits of hash of the unit vector; label null and dim 0 if it links with nothing."""
    for b in batches:
        told = b.column(3).is_valid().to_numpy(zero_copy_only=False)
        keys, dim = np.zeros((b.num_rows, 2), np.int64), np.zeros(b.num_rows, np.int32)
        for at, x in _by_length(b.column(4)):
            x, at = x[told[at]], at[told[at]]
            if len(at):
                keys[at] = np.frombuffer(b"".join(blake2b(u, digest_size=16).digest() for u in _scaled(x)), np.int64).reshape(-1, 2)
                dim[at] = x.shape[1]
        # vectors of another length are another label
        label = pc.binary_join_element_wise(pa.array(dim).cast(pa.string()), b.column(3), "|")
        label = pc.if_else(pa.array(dim > 0), label, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), label, pa.array(dim), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["f", "r", "vec_id", "label", "dim", "key", "key2"])


def _sample_units(batches):
    for b in batches:
        for at, x in _by_length(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([u.tobytes() for u in _scaled(x)], pa.binary())], names=["key", "unit"])


def _index(shared):
    """From (f, r, x) to the place of each vector in the index."""

    def run(batches):
        models: dict[int, Quantiser] = shared.value
        for b in batches:
            for at, x in _by_length(b.column(2)):
                cell, code, err = encode(models[x.shape[1]], _scaled(x))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err)], names=["f", "r", "cell", "code", "err"])

    return run


def _pairs(left: np.ndarray, right: np.ndarray | None, dim: int, load, skip=None):
    """Rows, columns and their factors, for all pairs of ``left`` and ``right`` or for those within ``left``, once each.

    ``load(rows, k)`` gives the factors of rows, k telling the sides apart. Pairs within
    ``left`` come with a mask of those to use where a step holds others, too.
    """
    cols = left if right is None else right
    high, wide = (max(512, min(most, 64 * most // dim)) for most in (_ROWS, _COLS))
    for i in range(0, len(left), high):
        some, a = left[i : i + high], None
        for j in range(0, min(len(cols), i + high) if right is None else len(cols), wide):
            others = cols[j : j + wide]
            if skip is not None and skip(some, others):
                continue
            a = load(some, 0) if a is None else a
            b = load(others, 1)
            for k in range(0, len(some), _STEP):
                at = np.arange(i + k, i + min(k + _STEP, len(some)))
                if right is not None:
                    yield some[k : k + _STEP], others, a[k : k + _STEP], b, None
                elif j < at[-1]:  # the later row of a pair asks
                    once = None if j + len(others) <= at[0] else np.arange(j, j + len(others))[None] < at[:, None]
                    yield some[k : k + _STEP], others, a[k : k + _STEP], b, once


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero``, faster where little is set."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _unite(parent: np.ndarray, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> None:
    """Join the components of linked pairs; ``parent`` points to roots before and after."""
    for k in range(0, len(rows), 16):
        part = linked[k : k + 16]
        if not part.any():
            continue
        a, b = _where(part & (parent[rows[k : k + 16]][:, None] != parent[cols][None]))
        u, v = rows[k : k + 16][a], cols[b]
        while ((ru := parent[u]) != (rv := parent[v])).any():  # hook roots, then let all point to theirs
            np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
            while ((up := parent[parent]) != parent).any():
                parent[:] = up


class _Codes(NamedTuple):
    vec: np.ndarray
    low: np.ndarray
    cell: np.ndarray
    code: np.ndarray
    err: np.ndarray


def _candidates(block: _Codes, q: Quantiser, across: bool, threshold: float) -> np.ndarray:
    """Component of each row by pairs whose codes are no further apart than the reach and both their errors.

    That is |x - y|^2 <= (r + e + f)^2 as one product: x.y + ef - p - q >= -r^2 / 2 with
    p = (x^2 - e^2 - 2re) / 2, q alike. It is taken over the half of the components that varies
    most, and over the rest for the few pairs that are near there. Lists whose centroids are too
    far apart are passed over.
    """
    r, parent = reach(threshold), np.arange(len(block.vec))
    order = np.argsort(block.cell, kind="stable")
    length, most = np.zeros(len(order)), np.zeros(len(q.centroids))
    for i in range(0, len(order), _COLS):
        length[i : i + _COLS] = np.sqrt((_residual(q, block.code[i : i + _COLS]) ** 2).sum(1))
    np.maximum.at(most, block.cell, length + block.err)  # no vector of a list is further from its centroid
    squares = (q.centroids**2).sum(1)
    gap = np.sqrt(np.maximum(0, squares[:, None] + squares[None] - 2 * q.centroids @ q.centroids.T))
    apart = gap > r + most[:, None] + most[None] + 1e-6

    dim = q.centroids.shape[1]
    few = order[:: max(1, len(order) // 4096)]
    comps = np.argsort(-decode(q, block.cell[few], block.code[few]).var(0), kind="stable")
    first, rest = np.split(comps, [dim // 2 if dim >= 64 else dim])
    lead = len(first) + 3

    def load(rows, side):
        x, e = decode(q, block.cell[rows], block.code[rows]), block.err[rows].astype(np.float64)
        p = ((x[:, first] ** 2).sum(1) - e * e - 2 * r * e) / 2
        one = np.ones(len(rows))
        return np.column_stack([x[:, first], e, *((one, -p) if side else (-p, one)), x[:, rest]]).astype(np.float32)

    def skip(rows, cols):
        return apart[np.ix_(np.unique(block.cell[rows]), np.unique(block.cell[cols]))].all()

    # rounding of single precision products of factors no longer than these
    e = float(block.err.max())
    size = (2 + e) ** 2 + 1 + e * e + ((2 + e) ** 2 + e * e + 2 * r * e) ** 2
    margin = (dim + 8) * 1.2e-7 * size
    cut = -r * r / 2 - margin if margin < 0.05 else -np.inf
    sides = (order[block.low[order]], order[~block.low[order]]) if across else (order, None)
    for rows, cols, x, y, once in _pairs(*sides, dim, load, skip):
        if (parent[rows] == parent[rows[0]]).all() and (parent[cols] == parent[rows[0]]).all():
            continue  # one component already
        got = x[:, :lead] @ y[:, :lead].T
        near = got >= cut
        if once is not None:
            near &= once
        if not (n := np.count_nonzero(near)):
            continue
        x, y = x[:, lead:], y[:, lead:]
        if n < 0.02 * near.size:
            i, j = _where(near)
            near[i, j] = got[i, j] - ((x[i] - y[j]) ** 2).sum(1) / 2 >= cut
        else:
            near &= got + x @ y.T - ((x * x).sum(1)[:, None] + (y * y).sum(1)[None]) / 2 >= cut
        if near.any():
            _unite(parent, rows, cols, near)
    return parent


class _Vectors(NamedTuple):
    vec: np.ndarray
    low: np.ndarray
    mult: np.ndarray
    x: np.ndarray


def _links(block: _Vectors, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Added multiplicities of the vectors that each row links with, and its component. Cosines in double precision decide."""
    n, dim = block.x.shape
    links, parent, rows = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    mult, margin = block.mult.astype(np.float64), (dim + 4) * 1.2e-7

    def load(at, _):
        return _scaled(block.x[at]).astype(np.float32)

    sides = (rows[block.low], rows[~block.low]) if across else (rows, None)
    for u, v, x, y, once in _pairs(*sides, dim, load):
        got = x @ y.T
        sure = got >= threshold - margin
        if once is not None:
            sure &= once
        if not sure.any():
            continue
        a, b = _where(sure & (got <= threshold + margin))
        for k in range(0, len(a), 65_536):
            i, j = a[k : k + 65_536], b[k : k + 65_536]
            sure[i, j] = np.einsum("ij,ij->i", _scaled(block.x[u[i]]), _scaled(block.x[v[j]])) >= threshold
        whole = sure.astype(np.float64)
        links[u] += (whole @ mult[v]).astype(np.int64)
        links[v] += (mult[u] @ whole).astype(np.int64)
        _unite(parent, u, v, sure)
    return links, parent


def _blocks(batches, make):
    """Keys and columns of blocks; rows come sorted by their first four columns, and one block is in memory at a time."""
    held, parts = None, []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        label = b.column(0).to_pylist()
        num = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)], 1)
        cut = [0, *[i for i in range(1, n) if label[i] != label[i - 1] or (num[i] != num[i - 1]).any()], n]
        for i, j in zip(cut, cut[1:]):
            key = (label[i], *num[i].tolist())
            if key != held and parts:
                yield held, [np.concatenate(c) for c in zip(*parts)]
                parts = []
            held = key
            parts.append(make(b.slice(i, j - i)))
    if parts:
        yield held, [np.concatenate(c) for c in zip(*parts)]


def _bytes(column, kind) -> np.ndarray:
    # a block is of one length, a batch is not
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _flags(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _stars(vec, parent, told):
    best = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(best, parent, vec)
    return [pa.array(vec[told]), pa.array(best[parent][told])]


def _search_codes(shared, threshold: float):
    def run(batches):
        models: dict[int, Quantiser] = shared.value

        def make(b):
            return b.column(4).to_numpy(), _flags(b.column(5)), b.column(6).to_numpy(), _bytes(b.column(7), np.uint8), b.column(8).to_numpy()

        for key, cols in _blocks(batches, make):
            block = _Codes(*cols)
            parent = _candidates(block, models[int(key[0].split("|", 1)[0])], key[2] != key[3], threshold)
            told = np.bincount(parent, minlength=len(parent))[parent] > 1
            yield pa.RecordBatch.from_arrays(_stars(block.vec, parent, told), names=["u", "v"])

    return run


def _search_vectors(threshold: float, kind):
    def run(batches):
        def make(b):
            return b.column(4).to_numpy(), _flags(b.column(5)), b.column(6).to_numpy(), _bytes(b.column(7), kind)

        for key, cols in _blocks(batches, make):
            block = _Vectors(*cols)
            links, parent = _links(block, key[2] != key[3], threshold)
            told = links > 0
            vec, root = _stars(block.vec, parent, told)
            yield pa.RecordBatch.from_arrays([vec, pa.array(links[told]), root], names=["vec", "links", "root"])

    return run


def _raw(batches):
    """The vectors of (.., x) as bytes."""
    for b in batches:
        x = b.column(b.num_columns - 1)
        unit = [None] * b.num_rows
        for at, some in _by_length(x):
            for i, v in zip(at.tolist(), some):
                unit[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(unit, pa.binary())], names=b.schema.names)


def _deal(df: DataFrame, bucket, columns: list[str]) -> DataFrame:
    """Rows with ``t`` tiles to a bucket, once for each pair of tiles that they are in, sorted by block."""
    side = df.withColumn("bucket", bucket).withColumn("side", F.pmod(F.xxhash64("vec"), F.col("t")).cast("int"))
    dealt = side.select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("o"))
    keys = ["label", "bucket", "lo", "hi"]
    dealt = dealt.select("label", "bucket", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "vec", (F.col("side") < F.col("o")).alias("low"), *columns)
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def link_embeddings(table: DataFrame, threshold: float = 0.93, list_size: int = 2048, tile: int = 524_288, sample: int = 20_000, most_cells: int = 1024) -> DataFrame:
    """Near-duplicate links among vectors of equal label by cosine >= ``threshold`` in double precision.

    Equal vectors of a label are one node with a multiplicity (equal: 128 bits of hash of their unit
    vectors). Nodes are indexed by a list and a residual code of a byte per two components; the
    quantiser is fitted on at most ``sample`` vectors, chosen by a hash, and every vector is indexed.
    Codes of a label are compared, list by list; list distances, code distances and their
    errors are exact bounds, so no link is lost: recall is 1. They give groups that hold all
    links; only vectors that are not alone in theirs are shuffled, and exact cosines decide.

    Vectors stay in the input until then. ``tile`` bounds the codes of a block (fewer of
    long vectors, and a quarter as many vectors); a label or group with more is cut into tiles and each pair of
    tiles is a block, so that no task holds more than two. Blocks emit sums and stars, never pairs.

    Returns vec_id, n_links, component_id, kept (is it the component's least). Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null label, link with nothing:
    0 links, their own vec_id. Vectors of unlike length never link with each other; every length is
    searched, and lengths of few vectors share a job (the driver holds the list of lengths). Repeated rows link
    with each other. Null vec_ids never name a component that has another. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    kind = np.float32 if single else np.float64
    plain, file, row = with_row_key(table.select("vec_id", "label", "embedding"), "embed_input")
    place = [F.col(file).alias("f"), F.col(row).alias("r")]
    keyed = plain.select(*place, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("x"))
    rows = materialize(keyed.mapInArrow(_row_keys, "f long, r long, vec_id long, label string, dim int, key long, key2 long"), "embed")
    same = ["label", "key", "key2"]
    valid = rows.where("dim > 0")
    nodes = valid.groupBy("dim", *same).agg(F.count(F.lit(1)).alias("mult"), F.min(F.struct("f", "r")).alias("at"))
    nodes = materialize(nodes.select("dim", *same, "mult", "at.f", "at.r", F.monotonically_increasing_id().alias("vec")), "embed_nodes")
    sizes = nodes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    lengths = [(r["dim"], min(most_cells, -(-r["most"] // list_size)), r["n"]) for r in sizes.groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()]
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # enough blocks for some cores, as few as their size allows beyond
    tiles = F.greatest(F.least(F.lit(4), F.ceil(F.col("n") / 16_384)), F.ceil(F.col("n") / F.least(F.lit(tile), F.ceil(F.lit(2**25) / F.col("dim"))))).cast("int")
    stars = []
    for batch in _batches_of_lengths(lengths, sample):
        part, own = nodes.where(F.col("dim").isin(list(batch))), sizes.where(F.col("dim").isin(list(batch)))
        here = plain.where(F.size("embedding").isin(list(batch))).select(*place, vector.alias("x"))
        most = min(sample, max(256, 2**22 // max(batch)))
        share = int(min(1, 1.1 * most / sum(n for dim, _, n in lengths if dim in batch)) * 2**30)
        few = part.where(F.pmod("key", F.lit(2**30)) <= share).select("f", "r", "key")
        few = here.join(F.broadcast(few), ["f", "r"]).select("key", "x").mapInArrow(_sample_units, "key long, unit binary").toPandas()
        units = [np.frombuffer(u) for u in few.sort_values("key")["unit"]]
        models = {}
        for dim, cells in batch.items():
            fit = [u for u in units if len(u) == dim][:most]
            models[dim] = fit_quantiser(np.stack(fit) if fit else np.eye(1, dim), cells)
        shared = spark.sparkContext.broadcast(models)  # bounded by most_cells and the batch
        coded = here.mapInArrow(_index(shared), "f long, r long, cell int, code binary, err float")
        coded = coded.join(part.select("f", "r", "label", "vec"), ["f", "r"]).join(own.where("n > 1").select("label", tiles.alias("t")), "label")
        dealt = _deal(coded, F.lit(0).cast("long"), ["cell", "code", "err"])
        stars.append(materialize(dealt.mapInArrow(_search_codes(shared, threshold), "u long, v long"), "embed_candidates"))
    edges = stars[0]
    for more in stars[1:]:
        edges = edges.unionByName(more)
    groups = connected_components(edges)
    drop_tables(spark, *stars)
    groups = materialize(nodes.join(groups, F.col("vec") == F.col("node")).select("dim", "label", "vec", "mult", "f", "r", F.col("root").alias("bucket")), "embed_groups")
    # small groups share a block
    count = groups.groupBy("dim", "label", "bucket").agg(F.count(F.lit(1)).alias("m"))
    total = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / 1024).alias("shares"))
    wide = F.least(F.lit(-(-tile // 4)), F.ceil(F.lit(2**23) / F.col("dim")))
    dealing = count.join(total, "label").select("bucket", "shares", F.when(F.col("m") <= 1024, 1).otherwise(F.greatest(F.least(F.lit(4), F.ceil(F.col("m") / 8192)), F.ceil(F.col("m") / wide))).cast("int").alias("t"), (F.col("m") > F.least(F.lit(1024), wide)).alias("large"))
    found = plain.select(*place, vector.alias("x")).join(groups.join(dealing, "bucket"), ["f", "r"])
    found = found.select("label", "bucket", "shares", "t", "large", "vec", "mult", "x").mapInArrow(_raw, "label string, bucket long, shares long, t int, large boolean, vec long, mult long, x binary")
    bucket = F.when(F.col("large"), F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("bucket"), F.col("shares")))
    counts = materialize(_deal(found, bucket, ["mult", "x"]).mapInArrow(_search_vectors(threshold, kind), "vec long, links long, root long"), "embed_links")
    drop_tables(spark, groups)
    roots = connected_components(counts.select(F.col("vec").alias("u"), F.col("root").alias("v")))
    sums = counts.groupBy("vec").agg(F.sum("links").alias("more"))
    node = nodes.select(*same, "vec", "mult").join(sums, "vec", "left").join(roots, F.col("vec") == F.col("node"), "left")
    node = node.select(*same, "mult", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "vec").alias("root"))
    member = valid.join(node, same).select("vec_id", (F.col("mult") - 1 + F.col("more")).alias("n_links"), "root")
    member = materialize(member, "embed_members")
    names = member.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = member.join(names, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


#: The same in DuckDB SQL, for tables on which all pairs of a label can be compared.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a AS s, a AS t FROM p UNION SELECT r.s, p.b FROM r JOIN p ON r.t = p.a),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN c ON v.vec_id = c.s
"""
