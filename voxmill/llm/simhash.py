"""SimHash near-duplicates: fingerprints linked by bit-sliced comparison."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._common import connected_components, forget, materialize, scratch, with_row_key

#: Five segments of the 64 bits, as (first bit, width). Two fingerprints that differ in up to three
#: bits agree on two whole segments at least, so the ten pairs of segments find every link.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 3


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles (ASCII lower case), as an unsigned integer; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()] if len(words) > size else [0]
    stops = (ends[size - 1 :] - 1).tolist() if len(words) >= size else [len(joined)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    forget()
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.binary()), b"")
        prints = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


class BitPlanes:
    """Fingerprints stored bit by bit: word ``w`` of plane ``b`` holds bit b of fingerprints 64w to 64w+63."""

    def __init__(self, prints: np.ndarray):
        self.n, self.prints = len(prints), prints
        words = -(-self.n // 64)
        bits = np.zeros((64, words * 64), np.uint8)
        bits[:, : self.n] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
        self.planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        self.pad = np.zeros(words, "<u8")
        self.pad.view(np.uint8)[:] = np.packbits(np.arange(words * 64) >= self.n, bitorder="little")

    def near(self, queries: np.ndarray) -> np.ndarray:
        """For each query one bit per fingerprint: set if at most RADIUS (3) bits differ.

        Two carry-save counters hold all distances modulo 4 and ``over`` what has passed 3.
        A query leaves the work once all fingerprints of the block are over.
        """
        out = np.zeros((len(queries), len(self.pad)), "<u8")
        live = np.arange(len(queries))
        one, two, over = (np.zeros_like(out) for _ in range(3))
        over |= self.pad
        for bit in range(64):
            flip = -((queries[live] >> np.uint64(bit)) & np.uint64(1)).astype("<u8")
            differ = self.planes[bit] ^ flip[:, None]
            carry = one & differ
            one ^= differ
            over |= two & carry
            two ^= carry
            if bit % 8 == 7:
                going = (over != np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
                if not going.all():
                    live, one, two, over = live[going], one[going], two[going], over[going]
                    if not len(live):
                        return out
        out[live] = ~over
        return out


def local_links(prints: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) of the components of a block of distinct fingerprints."""
    planes = BitPlanes(prints)
    rows = np.concatenate([planes.near(prints[i : i + chunk]) for i in range(0, len(prints), chunk)])
    degree = np.bitwise_count(rows).sum(1)
    free = ~planes.pad
    members, roots = [], []
    for s in np.flatnonzero(degree > 1):
        w, m = divmod(int(s), 64)
        if not (int(free[w]) >> m) & 1:
            continue
        front, comp = np.array([s]), []
        free[w] &= ~np.uint64(1 << m)
        while len(front):
            comp.append(front)
            new = np.bitwise_or.reduce(rows[front], axis=0) & free
            free &= ~new
            front = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
        got = prints.view(np.int64)[np.concatenate(comp)]
        members.append(got)
        roots.append(np.full(len(got), got.min()))
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(members), np.concatenate(roots)
    return u[u != v], v[u != v]


def _link_blocks(block: int):
    """Rows come sorted by key; whole keys are joined to blocks of about ``block`` rows.

    Keys side by side in one block cost nothing extra: a link between them is a link too.
    """

    def edges(prints):
        u, v = local_links(np.unique(np.concatenate(prints)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        held, n, tail_key, tail = [], 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            prints = b.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(prints)]):
                key = tuple(keys[i])
                if key != tail_key and tail:
                    held += tail
                    n += sum(map(len, tail))
                    tail = []
                    if n >= block:
                        yield edges(held)
                        held, n = [], 0
                tail_key = key
                tail.append(prints[i:j])
        if held or tail:
            yield edges(held + tail)

    return run


def link_fingerprints(prints: DataFrame, tile: int = 4096) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs of ``fp`` within RADIUS bits.

    Every pair of segments is a key. A key with more than ``tile`` fingerprints is cut into
    tiles, and each pair of tiles is a block of its own, so no task holds more than two tiles
    of one key and no pair is left out. A block emits a star per component, never all pairs.
    """
    def segment(first, width):
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)

    keys = []
    for t, (a, b) in enumerate(itertools.combinations(SEGMENTS, 2)):
        keys.append(F.lit(t << 26) + segment(*a) * (1 << b[1]) + segment(*b))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    kept = rows.join(many, "key").select("key", "fp", tiles.alias("t"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("own"))
    pairs = kept.select("key", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other"))
    placed = pairs.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return dealt.mapInArrow(_link_blocks(tile // 2), "u long, v long")


def near_duplicates(docs: DataFrame, tile: int = 4096) -> DataFrame:
    """Fingerprint and component of each document.

    Fingerprints within three bits are linked, and components are closed over links. Equal
    fingerprints are one node, so copies cost a map-side combined row, whatever their number.

    Returns doc_id, fp (signed 64-bit), fingerprint (16 lowercase hex digits) and component_id
    (least doc_id of the component). Texts that are null, empty or without words have
    fingerprint zero and are linked like others; a very long one is hashed whole. A bit that
    exactly half of the shingles set is 0. Repeated rows each get a row. Null doc_ids are
    never a component's id unless it has no other. An empty table gives an empty result; other
    columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        marks = materialize(narrow.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash", keep=True)
        nodes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_nodes")
        roots = connected_components(materialize(link_fingerprints(nodes, tile), "simhash_links"))
        rooted = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash_roots", keep=True)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(of_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicate_representatives(docs: DataFrame, tile: int = 4096) -> DataFrame:
    """One document of each component of near-duplicates: least doc_id, of those rows any one.

    Columns are those of ``docs``, whatever their names. A null doc_id only stands for a
    component that has no other. Texts that are null, empty or without words are one component.
    An empty table gives an empty result. Texts are read twice and shuffled once, in the join
    with the rows that stay; that list grows with the corpus, so it is never broadcast.
    """
    rows, file, row = with_row_key(docs, "simhash_text")
    with scratch(docs.sparkSession):
        order = F.struct(F.col("d").isNull().alias("n"), F.col("d").alias("d"), F.col("f").alias("f"), F.col("r").alias("r"))
        narrow = rows.select(F.col(file).alias("f"), F.col(row).alias("r"), F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"))
        marks = materialize(narrow.mapInArrow(_row_fingerprints, "f long, r long, d long, fp long"), "simhash")
        nodes = materialize(marks.groupBy("fp").agg(F.min(order).alias("least")), "simhash_nodes")
        roots = connected_components(materialize(link_fingerprints(nodes, tile), "simhash_links"))
        rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
        chosen = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.f").alias("f"), F.col("least.r").alias("r"))
        chosen = materialize(chosen, "simhash_kept", keep=True)
        return rows.join(chosen.hint("merge"), (rows[file] == chosen["f"]) & (rows[row] == chosen["r"]), "left_semi").select(*[rows[c] for c in docs.columns])


def _row_fingerprints(batches):
    forget()
    for b in batches:
        texts = pc.fill_null(b.column(3).cast(pa.binary()), b"")
        prints = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(prints, pa.int64())], names=["f", "r", "d", "fp"])
