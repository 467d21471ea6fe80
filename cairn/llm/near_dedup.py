"""Near-duplicates by an inverted join of MinHash signature coordinates.

A text's set of word shingles gets a signature of ``COORDINATES`` minima. Each (coordinate, value)
pair is a posting list. Two sets whose signatures agree in ``MATCHES`` coordinates at least must
meet in the list of one of their ``COORDINATES - MATCHES + 1`` rarest values (prefix filter), so
only those are posted; values that a single set has drop out, and a set with fewer than ``MATCHES``
shared values has no partner at all. Lists are merged in three passes. The first two compare each
member with one leader a list; the last compares all members that are still in different
components, and skips lists that lie in one component as well as pairs already connected. Pairs
above the match threshold are confirmed on their whole sets, taken from the texts.

With 48 coordinates and 26 matches a pair of similarity 0.8 is missed with a chance of 4e-6, one of
0.9 with less than 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, join_unique, ship, small, stash
from .components import connected_components

COORDINATES = 48
MATCHES = 26
#: Members of a list that one task compares; longer lists are compared in blocks.
BLOCK = 512
#: Lists of up to so many members are compared on signatures alone before texts are.
SHORT = 64
#: Words whose hashes a worker remembers at most.
MEMO_WORDS = 200_000

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]
_TIMES = (_rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]
_LEFT, _RIGHT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def _give_back() -> None:
    """Free what a task has gathered: workers outlive it, and stages to come need the memory."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``width`` words, or of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * _LEFT + h[k : k + n] * _RIGHT)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the set under ``COORDINATES`` hash functions."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    parts = [((h[None, at : at + 4096] ^ _FLIP) * _TIMES).min(axis=1) for at in range(0, len(h), 4096)]
    return np.minimum.reduce(parts)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> set:
    w = words_of(text)
    if not w:
        return set()
    width = min(width, len(w))
    return set(zip(*(w[k:] for k in range(width)), strict=False))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, n_shingles, digest, sig) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, digests, sigs = [], [], []
                for value in part.column(2):
                    hashes = shingle_hashes(words_of(value.as_py() or b""), width)
                    sizes.append(len(hashes))
                    digests.append(blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                    sigs.append(signature(hashes).view(np.int32) if len(hashes) else None)
                offsets = np.cumsum([0] + [0 if s is None else COORDINATES for s in sigs]).astype(np.int32)
                flat = np.concatenate([s for s in sigs if s is not None] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["id", "mark", "n_shingles", "digest", "sig"],
                )
        _give_back()

    return rows.mapInArrow(run, "id long, mark long, n_shingles long, digest binary, sig array<int>")


def _confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) that reach the similarity on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes | None, set] = (None, set())
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.as_py(), b.as_py()
                if known[0] != b:
                    known = (b, shingle_set(b, width))
                own = shingle_set(a, width)
                both = len(own & known[1])
                keep.append(100 * both >= percent * (len(own) + len(known[1]) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])
        _give_back()

    node = "struct<id:long,mark:long>"
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {node}, b {node}")


@contextmanager
def _arrow_rows(spark, rows: int) -> Iterator[None]:
    """Bound the rows of an Arrow batch, for rows that hold whole lists or two texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _matches(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of some nodes, straight from the documents; only these texts are exchanged."""
    keys = small(nodes.select("node.id", "node.mark"))
    return rows.join(keys, ["id", "mark"], "left_semi").select(F.struct("id", "mark").alias("node"), "text")


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, width: int, percent: int, compared: bool = False) -> DataFrame:
    """Distinct pairs (a, b) above the match threshold that hold on the texts."""
    pairs = pairs.distinct()
    if not compared:
        left = sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
        right = sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
        pairs = (
            pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .where(_matches(F.col("sig_a"), F.col("sig_b")) >= MATCHES)
            .select("a", "b")
        )
    pairs = stash(pairs, "pairs")
    nodes = stash(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pair_nodes")
    texts = stash(_texts(rows, nodes).dropDuplicates(["node"]), "texts")
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return stash(_confirm(joined, width, percent), "links")


def _leaders(postings: DataFrame, order: Column) -> DataFrame:
    """Pairs of each list's members with the one that comes first."""
    first = postings.groupBy("pos", "value").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("b"), F.col("part").alias("part_b"))).alias("f"))
    joined = join_unique(postings, first, ["pos", "value"]).where(F.col("part") != F.col("f.part_b"))
    return joined.select(F.greatest("node", F.col("f.b")).alias("a"), F.least("node", F.col("f.b")).alias("b"))


def _open_lists(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    """Postings with their components, of lists that reach into two of them or more."""
    if components is not None:
        # the first pass compared the members of a list of two
        postings = postings.where("n_list > 2").drop("part", "n_list").join(small(components).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    spread = postings.groupBy("pos", "value").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n_list")).where("p != q")
    return stash(join_unique(postings, spread.drop("p", "q"), ["pos", "value"]).where("n_list IS NOT NULL").select("pos", "value", "node", "part", "n_list"), "lists")


def _short_hashes(texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the shingles' hashes cut to 32 bits, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [np.unique(shingle_hashes(words_of(x.as_py()), width) >> np.uint64(32)).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], ["node", "hashes"])
        _give_back()

    return texts.select("node", "text").mapInArrow(run, "node struct<id:long,mark:long>, hashes binary")


def _linked(own: np.ndarray, size: int, others: list[np.ndarray], sizes: np.ndarray, parts: list[tuple], percent: int) -> list[int]:
    """Which of the others to confirm: of each component the most similar one if it links, else those that
    would link with one more common shingle (two hashes of 32 bits may fall together)."""
    common = np.empty(len(others), np.int64)
    for at in range(0, len(others), 64):
        part = others[at : at + 64]
        flat = np.concatenate(part)
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        starts = np.cumsum([0] + [len(x) for x in part[:-1]])
        common[at : at + 64] = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
    both = size + sizes
    surplus = 100 * common - percent * (both - common)
    best: dict[tuple, int] = {}
    for n in np.flatnonzero(surplus >= 0).tolist():
        # similarity grows with common / both
        if parts[n] not in best or common[n] * both[best[parts[n]]] > common[best[parts[n]]] * both[n]:
            best[parts[n]] = n
    nearly = np.flatnonzero((surplus < 0) & (surplus + 100 + percent >= 0)).tolist()
    return [*best.values(), *(n for n in nearly if parts[n] not in best)]


def _compare_lists(lists: DataFrame, sets: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of a list in different components that agree in enough coordinates and, in lists of more
    than ``SHORT`` members, link by their sets.

    Members of such lists bring their sets along; of a member's links to one component the best is
    returned, so what leaves a task grows with components, not with pairs. A list of n members is dealt over blocks, and each pair of blocks is one group, so a group has
    2 * BLOCK members at most however long the list is.
    """
    blocks = F.ceil(F.col("n_list") / BLOCK).cast("int")
    member = F.struct(F.col("node.id").alias("id"), F.col("node.mark").alias("mark"), F.col("part.id").alias("pid"), F.col("part.mark").alias("pmark"), "own", "n_shingles", "sig", "hashes")
    held = sets.select("node", "sig", "n_shingles")
    long = F.col("n_list") > SHORT
    hashes = stash(_short_hashes(_texts(rows, stash(lists.where(long).select("node").distinct(), "open_nodes")), width).dropDuplicates(["node"]), "hashes")
    with_sets = lists.where(long).join(held.join(hashes, "node"), "node")
    dealt = (
        lists.where(~long).join(held, "node").withColumn("hashes", F.lit(None).cast("binary")).unionByName(with_sets)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .groupBy("pos", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list(member).alias("members"))
        .select((F.col("i") == F.col("j")).alias("same"), "members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            ends = np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False))
            flat = members.flatten()
            ids, marks, pids, pmarks, owns, sizes = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            hashes = [x and np.frombuffer(x, "<u4") for x in flat.field(7).to_pylist()]
            sigs = flat.field(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
            found: list[np.ndarray] = []
            at = 0
            for same, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                for k in range(at + 1, end):
                    ok = (pids[at:k] != pids[k]) | (pmarks[at:k] != pmarks[k])
                    ok &= 100 * np.minimum(sizes[at:k], sizes[k]) >= percent * np.maximum(sizes[at:k], sizes[k])
                    if not same:
                        ok &= owns[at:k] != owns[k]
                    near = at + np.flatnonzero(ok)
                    if len(near):
                        near = near[(sigs[near] == sigs[k]).sum(axis=1) >= MATCHES]
                        if len(near) and hashes[k] is not None:
                            parts = list(zip(pids[near].tolist(), pmarks[near].tolist(), strict=True))
                            near = near[_linked(hashes[k], sizes[k], [hashes[n] for n in near], sizes[near], parts, percent)]
                        found.append(np.stack([np.full(len(near), k), near]))
                at = end
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], marks[a], ids[b], marks[b])], ["a_id", "a_mark", "b_id", "b_mark"])

    found = dealt.mapInArrow(run, "a_id long, a_mark long, b_id long, b_mark long")
    a, b = (F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_mark").alias("mark")) for x in "ab")
    return found.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept`` and
    ``text_hash`` (see ``common.text_hash``).

    Texts are lower-cased (A-Z), cut into words at ASCII white space, and linked when their sets of
    ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more. A text of fewer
    words is one shingle; one without words has no set and no link, null counts as such. The
    component is the smallest id reachable over links, and its row is kept. Equal sets are one
    class, of which only a representative is compared. Rows that repeat an id are classed by their
    own texts. A row without id is never linked and is kept. Other columns are ignored; an empty
    table gives an empty table.
    """
    ship(docs.sparkSession)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("mark"), t.cast("binary").alias("text"))
    signed = stash(_sets(rows, width), "signatures")
    linked = signed.where("id IS NOT NULL AND n_shingles > 0").withColumn("node", F.struct("id", "mark"))
    sets = stash(
        linked.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "n_shingles", "sig")).alias("s")).select("digest", "n", "s.node", "s.n_shingles", "s.sig"),
        "sets",
    )
    # values that two sets or more have, of sets with enough of those
    list_of, set_of = Window.partitionBy("pos", "value"), Window.partitionBy("node")
    shared = (
        sets.select("node", F.posexplode("sig").alias("pos", "value"))
        .withColumn("n", F.count(F.lit(1)).over(list_of))
        .where("n > 1")
    )
    postings = stash(
        shared.withColumn("c", F.count(F.lit(1)).over(set_of))
        .where(F.col("c") >= MATCHES)
        .withColumn("k", F.row_number().over(set_of.orderBy("n", "pos")))
        .where(F.col("k") <= F.col("c") - MATCHES + 1)
        .select("pos", "value", "node", F.col("node").alias("part")),
        "postings",
    )
    candidates = stash(postings.select("node").distinct(), "candidates")
    classes = sets.select("digest", "n", "node")
    sets = stash(sets.join(candidates, "node", "left_semi"), "candidate_sets")
    links = components = None
    lists = postings
    for turn in range(3):
        lists = _open_lists(lists, components)
        if lists.isEmpty():
            break
        if turn < 2:
            pairs = _leaders(lists, F.lit(0) if turn == 0 else F.xxhash64("node", "pos", "value"))
        else:
            pairs = _compare_lists(lists, sets, rows, width, percent)
        with _arrow_rows(docs.sparkSession, 16 if turn == 2 else 1000):
            found = _verified(pairs, sets, rows, width, percent, compared=turn == 2)
        links = found if links is None else links.unionByName(found)
        components = stash(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    reps = classes if components is None else classes.join(components, "node", "left")
    component = F.col("node") if components is None else F.coalesce("component", "node")
    moving = stash(
        reps.withColumn("component_id", component["id"]).where((F.col("n") > 1) | (F.col("component_id") != F.col("node.id"))).select("digest", "component_id"),
        "moving",
    )
    moved = stash(
        linked.select("id", "mark", "digest").join(small(moving, BROADCAST_ROWS // 4), "digest").where("id != component_id").select("id", "mark", "component_id").distinct(),
        "moved",
    )
    result = signed.join(small(moved, BROADCAST_ROWS // 2), ["id", "mark"], "left")
    component = F.coalesce("component_id", "id")
    kept = F.col("id").eqNullSafe(component)
    return result.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("mark").alias("text_hash"))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2).drop("text_hash")
