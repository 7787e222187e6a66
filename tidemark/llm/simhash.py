"""SimHash fingerprints and their near-duplicate groups, searched with BK-trees.

A fingerprint is 64 bits wide. Two fingerprints link when at most ``radius`` bits differ. By the
pigeonhole principle two such fingerprints agree on at least one of ``radius + 1`` blocks of bits,
so every distinct fingerprint goes to one shard per block, and each shard builds a BK-tree (children
keyed by their Hamming distance to the parent) and follows only edges within the radius. A tree
grows with the corpus, so it stays with its shard and is not broadcast. A shard that is too large
for one tree is dealt again on its remaining bits, by the same principle, until it fits or its bits
are used up. Shards emit a spanning forest of their links; hash-to-min rounds over a table in the shared
folder join the forests to components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import join_hot, keep_only, materialize, release, ship, slices_of, split_methods, unused

SEED = 42
SHARD_LIMIT = 4096
#: Near copies share LEAST of their distinct shingles of EXACT_WIDTH words.
EXACT_WIDTH = 5
LEAST = 0.8
#: Bands of min-hashes that propose pairs, and min-hashes in each. A pair of similarity LEAST agrees on no band
#: with a chance of (1 - 0.8 ** 4) ** 32, 5e-8.
BANDS, IN_BAND = 32, 4
#: 64-bit words of a set's parity sketch.
SKETCH = 32
#: Pairs of open classes are sampled first where more than MEETINGS a class may meet; each further round takes STEP times the share or more.
MEETINGS, STEP = 64, 16
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * IN_BAND, 1), dtype=np.uint64) | np.array([0, 1], dtype=np.uint64).reshape(2, 1, 1)


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every shingle of width words; fewer words give the whole sequence, none gives nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set when it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.nonzero(2 * total > len(hashes))[0]))


def rehashed(hashes: np.ndarray, view: int) -> np.ndarray:
    """The hashes under another 64-bit mixing; view 0 is the hashes themselves."""
    if not view:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(view * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text as a long; every other column stays. Null counts as empty: 0."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, out)]

    def run(batches):
        keep_only()
        for batch in batches:
            texts = batch.column(len(keep))
            values = [_signed(fingerprint(shingle_hashes(t.as_py(), width))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.int64())], names=[*keep, out])

    schema = docs.select(*keep).schema.add(out, "long")
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _set_of(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles of EXACT_WIDTH words, in order."""
    return np.unique(shingle_hashes(text, EXACT_WIDTH))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One hash per band of the min-hashes of a set; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * IN_BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[at : at + 512] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(band.tobytes(), SEED + i) for i, band in enumerate(least.reshape(BANDS, IN_BAND))], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, n: int, width: int) -> DataFrame:
    """id, tk, class (hash of the text's set of shingles of EXACT_WIDTH words), size and bands of that set, and
    fps, the fingerprints of n views of each whole text. Takes id, tk and text."""
    ship(docs.sparkSession)

    def run(batches):
        keep_only()
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices_of(whole.column(2))):
            fps, names, sizes, bands = [], [], [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), width)
                fps.append([_signed(fingerprint(rehashed(h, v))) for v in range(n)])
                exact = _set_of(t.as_py())
                names.append(_signed(xxhash.xxh64_intdigest(exact.tobytes(), SEED)))
                sizes.append(len(exact))
                bands.append(bands_of(exact))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, fps))], names=["id", "tk", "class", "size", "bands", "fps"])

    schema = docs.select("id", "tk").schema.add("class", "long").add("size", "long").add("bands", T.ArrayType(T.LongType())).add("fps", T.ArrayType(T.LongType()))
    return docs.select("id", "tk", "text").mapInArrow(run, schema)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words of parity bits: each hash flips the one that its top bits name.

    Sketches of two sets differ in as many bits as the sets have shingles apart, or fewer.
    """
    flips = np.bincount((hashes >> np.uint64(64 - (64 * SKETCH - 1).bit_length())).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """class, shingles, the set of the text's shingles of EXACT_WIDTH words, and sketch, as sketch_of."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices_of(batch.column(1)):
                sets = [_set_of(t.as_py()) for t in batch.column(1)[a:b]]
                columns = ([x.view(np.int64) for x in sets], [sketch_of(x) for x in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x, pa.list_(pa.int64())) for x in columns)], names=["class", "shingles", "sketch"])

    return docs.select("class", "text").mapInArrow(run, "class long, shingles array<long>, sketch array<long>")


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it.

    Nodes are numbered as inserted; edges map (node, distance) to a child.
    """

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        node, fresh = 0, len(self.values)
        self.values.append(value)
        self.edges.append({})
        while fresh:
            distance = (self.values[node] ^ value).bit_count()
            child = self.edges[node].get(distance)
            if child is None:
                self.edges[node][distance] = fresh
                break
            node = child
        return fresh

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within radius; only edges that the triangle inequality leaves are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.edges[node]
            if len(edges) <= 2 * radius + 1:
                todo.extend(c for d, c in edges.items() if abs(d - distance) <= radius)
            else:
                todo.extend(edges[d] for d in range(distance - radius, distance + radius + 1) if d in edges)
        return found


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values, each as (value, least value of its tree)."""
    tree, parent = BKTree(), list(range(len(values)))
    for i, value in enumerate(values):
        for other in tree.near(value, radius):
            a, b = _root(parent, i), _root(parent, other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    least: dict[int, int] = {}
    for i, value in enumerate(values):
        r = _root(parent, i)
        least[r] = min(least.get(r, value), value)
    return [(value, least[_root(parent, i)]) for i, value in enumerate(values) if least[_root(parent, i)] != value]


def _deal(free: list[int], blocks: int) -> list[list[int]]:
    """The bit positions not used so far, dealt into blocks of about equal width."""
    size = math.ceil(len(free) / blocks)
    return [free[i : i + size] for i in range(0, len(free), size)]


def links(prints: DataFrame, radius: int = 3, limit: int = SHARD_LIMIT) -> DataFrame:
    """Spanning links (view, a, b) among distinct fingerprints, columns view and fp, of one view each, that
    differ in at most radius bits.

    Exact. A row is (view, path, key, fp): path numbers the blocks chosen so far, key hashes the view, the path
    and the bits agreed on. Shards over limit are dealt again over the bits they have left.
    """
    spark = prints.sparkSession
    ship(spark)
    out = None
    paths: dict[str, list[int]] = {"": list(range(64))}
    rows = prints.select("view", F.lit("").alias("path"), F.col("view").cast("long").alias("key"), "fp")
    while True:
        arms, deeper = [], {}
        for path, free in paths.items():
            for i, block in enumerate(_deal(free, radius + 1)):
                name = f"{path}/{i}"
                mask = _signed(sum(1 << b for b in block))
                arms.append((path, name, mask))
                deeper[name] = [b for b in free if b not in set(block)]
        choose = F.create_map(*[x for path in paths for x in (F.lit(path), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).cast("long").alias("m")) for p, n, m in arms if p == path]))])
        dealt = rows.select("view", "fp", "key", F.explode(choose[F.col("path")]).alias("arm")).select(
            "view", F.col("arm.n").alias("path"), F.xxhash64("key", "arm.n", F.col("fp").bitwiseAND(F.col("arm.m"))).alias("key"), "fp"
        )
        sizes = dealt.groupBy("path", "key").agg(F.count("*").alias("n"))
        more = all(len(free) > 2 * (radius + 1) for free in deeper.values())
        n_large = sizes.where(F.col("n") > limit).count() if more else 0
        large = materialize(sizes.where(F.col("n") > limit), "shards", rows=n_large) if n_large else None
        small = dealt
        if n_large:
            small = dealt.join(large.select("path", "key"), ["path", "key"], "left_anti")
        found = _search(small, radius)
        out = found if out is None else out.unionByName(found)
        if not n_large:
            return out
        # Long shards are rare; their rows alone go on, each to one more level of blocks.
        rows = materialize(dealt.join(large.select("path", "key"), ["path", "key"], "left_semi").select("view", "path", "key", "fp"), "deeper")
        paths = {r.path: deeper[r.path] for r in large.select("path").distinct().collect()}


def _search(dealt: DataFrame, radius: int) -> DataFrame:
    """Sorts each task's rows by shard and searches one shard's tree at a time."""

    def run(batches):
        current, view, values = None, None, []

        def flush():
            pairs = shard_links(values, radius) if len(values) > 1 else []
            if not pairs:
                return []
            columns = [pa.array([view] * len(pairs), pa.int32()), *(pa.array([_signed(x) for x in side], pa.int64()) for side in zip(*pairs))]
            return [pa.RecordBatch.from_arrays(columns, names=["view", "a", "b"])]

        for batch in batches:
            for key, v, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    yield from flush()
                    current, view, values = key, v, []
                values.append(fp & 0xFFFFFFFFFFFFFFFF)
        yield from flush()

    return dealt.select("key", F.col("view").cast("int").alias("view"), "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "view int, a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Each round every node takes the least label among itself and its neighbours, then the label of that
    label (pointer jumping), so the rounds grow with the logarithm of a component's diameter.
    """
    n = 2 * edges.count()
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges", rows=n)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0", rows=n)
    for step in range(1, 200):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        hooked = labels.join(near, "node").select("node", F.least("component", "seen").alias("label"), F.col("component").alias("old"))
        hooked = materialize(hooked, f"{name}-{step}-hook", rows=n)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialize(hooked.join(up, "label").select("node", F.least("label", "up").alias("component"), "old"), f"{name}-{step}", rows=n)
        release(labels, hooked)
        labels = after.select("node", "component")
        labels.scratch = after.scratch
        if after.where("component <> old").isEmpty():
            release(both)
            return labels
    raise RuntimeError("labels did not settle")


def roots(parents: DataFrame, name: str = "roots") -> DataFrame:
    """(node, component) for every node of a forest (node, parent) of one parent each, less than the node; component is the root.

    Each round takes the parent's parent, so the rounds grow with the logarithm of the depth.
    """
    n = parents.count()
    for step in range(200):
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = materialize(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), f"{name}-{step}", rows=n)
        if step:
            release(parents)
        parents = after.select("node", "parent")
        parents.scratch = after.scratch
        if after.where("moved").isEmpty():
            out = parents.withColumnRenamed("parent", "component")
            tops = out.select(F.col("component").alias("node"), "component").distinct()
            found = materialize(out.unionByName(tops), name, rows=2 * n)
            release(parents)
            return found
    raise RuntimeError("the forest did not end")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero, which links like any other. A null id counts for nothing in
    component_id, which is null where no document of a group has an id. Repeated rows stay repeated. An empty table
    gives an empty result. Other columns are ignored, whatever their names. Very long texts are hashed as a whole.
    """
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", width, "fp"), "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(links(least.select(F.lit(0).alias("view"), "fp"), radius).select("a", "b"), "links")
    reach = components(edges)
    tops = least.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    n = least.count()
    tops = materialize(tops, "tops", rows=n)
    first = materialize(tops.groupBy("component").agg(F.min("least").alias("component_id")), "firsts", rows=n)
    named = materialize(tops.join(first, "component").select("fp", "component_id"), "named", rows=n)
    release(least, edges, reach, tops, first)
    # Copies of one text may be a third of all rows.
    return join_hot(prints, named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidate_links(classes: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of classes that any view's fingerprints link."""
    seen = classes.select("class", F.posexplode("fps").alias("view", "fp"))
    tops = materialize(seen.groupBy("view", "fp").agg(F.min("class").alias("top")), "view-tops")
    star = seen.join(tops, ["view", "fp"]).where("class <> top").select(F.col("class").alias("a"), F.col("top").alias("b"))
    near = materialize(links(tops.select("view", "fp"), radius), "view-links")
    for side in "ab":
        near = near.join(tops.select("view", F.col("fp").alias(side), F.col("top").alias(f"top_{side}")), ["view", side])
    return star.unionByName(near.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))


def band_members(classes: DataFrame) -> DataFrame:
    """key, class, size, top and top_size of every class that shares a band; top is the least class of the band."""
    spread = classes.select(F.explode("bands").alias("key"), "class", "size")
    tops = spread.groupBy("key").agg(F.min(F.struct("class", "size")).alias("top"), F.count("*").alias("n")).where("n > 1")
    return materialize(spread.join(tops, "key").select("key", "class", "size", F.col("top.class").alias("top"), F.col("top.size").alias("top_size")), "bands")


def _alike(a: Column, b: Column) -> Column:
    """Sets of these sizes can have a similarity of LEAST."""
    return F.least(a, b) >= (LEAST - 1e-9) * F.greatest(a, b)


def rare_shingles(members: DataFrame, named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """class, size, alone, rare and sketch of the classes in bands of several components, and class and shingles of these classes.

    Two sets of n shingles or more can reach LEAST only where they share one of the n - LEAST * n + 1 that are
    rarest among these classes: rare, of which those that a class has alone, alone in number, take places only.
    """
    label = named.select(F.col("node").alias("class"), "component")
    rows = members.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("key")
    left = rows.join(split, "key", "left_semi").select("class", "size").distinct()
    held = materialize(left.join(sets, "class"), "open")
    words = held.select("class", "size", F.explode("shingles").alias("s"))
    common = words.join(words.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "s")
    ordered = common.groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("order"))
    places = F.col("size") - F.ceil(LEAST * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("order"))
    alone = (F.col("size") - F.size("order")).alias("alone")
    few = ordered.where(places > 0).select("class", "size", alone, F.transform(F.slice("order", F.lit(1), places.cast("int")), lambda x: x["s"]).alias("rare"))
    return materialize(few.join(held.select("class", "sketch"), "class"), "rare"), held


def first_share(rare: DataFrame) -> float:
    """The share of pairs to judge first: all, or so few that MEETINGS a class may meet."""
    met = rare.select(F.explode("rare").alias("s")).groupBy("s").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    share, n = 1.0, rare.count()
    while share * met > MEETINGS * n:
        share /= STEP
    return share


def next_share(share: float, found: int, classes: int) -> float:
    """The share up to which pairs are judged next, where found pairs made up the share before.

    Links that a share of all pairs, drawn at random, leaves between components are about as many as classes, divided by
    that share, whatever the sizes of the groups; so STEP times the share finds few more than STEP links a class. Where
    few pairs were found, the share that would hold one a class is taken at once.
    """
    return min(1.0, share * max(STEP, classes / (found + 3)))


def open_shingles(rare: DataFrame, named: DataFrame) -> DataFrame:
    """class, component, size, alone, sketch and open of the classes of rare, by the components of now.

    open holds place and shingle, i and s, of those of rare that classes of several components have: all at which a
    pair of different components can meet.
    """
    label = named.select(F.col("node").alias("class"), "component")
    rows = rare.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
    each = rows.select("class", "component", F.posexplode("rare").alias("i", "s"))
    split = each.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s")
    places = each.select("class", "i", "s").join(split, "s", "left_semi").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("open"))
    return materialize(rows.drop("rare").join(places, "class"), "open-shingles")


def open_pairs(rare: DataFrame, judged: DataFrame, named: DataFrame, above: float = 0.0, share: float = 1.0) -> DataFrame:
    """Pairs (a, b) of rare that are not judged, lie in different components and can reach LEAST.

    Those alone whose place among all, by a hash of the pair, is between above and share. A pair meets at the first
    rare shingle that it shares, and nowhere else; and only where what stands behind it in both, and the sketches, can
    still make up the overlap that LEAST asks of two sets of their sizes. A row carries the open shingles before its own
    alone: no other tells whether its own is a pair's first.
    """
    rows = open_shingles(rare, named)
    each = rows.withColumn("s", F.col("open.s")).select("class", "component", "size", "alone", "sketch", "s", F.posexplode("open").alias("k", "at"))
    # Behind the shingle at place i of those in common, alone + i + 1 of the set's shingles are used up.
    each = each.select("class", "component", "size", "sketch", F.col("at.s").alias("s"), F.slice("s", F.lit(1), F.col("k")).alias("before"), (F.col("size") - F.col("alone") - F.col("at.i")).alias("left"))
    x, y = each.alias("x"), each.alias("y")
    may = (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & _alike(F.col("x.size"), F.col("y.size"))
    if (above, share) != (0.0, 1.0):
        place = F.shiftrightunsigned(F.xxhash64("x.class", "y.class"), 1)
        may = may & (place >= int(above * (1 << 63))) & (place <= int(share * (1 << 63)) - 1)
    total = F.col("x.size") + F.col("y.size")
    overlap = F.ceil(LEAST / (1 + LEAST) * total - 1e-6)
    apart = sum((F.bit_count(F.get("x.sketch", F.lit(i)).bitwiseXOR(F.get("y.sketch", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    may = may & (F.least("x.left", "y.left") >= overlap) & (apart <= total - 2 * overlap) & ~F.arrays_overlap("x.before", "y.before")
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & may).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    with split_methods(rare.sparkSession):
        found = materialize(pairs.join(judged, ["a", "b"], "left_anti"), "open-pairs")
    release(rows)
    return found


def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """a, b and their exact Jaccard similarity over sets of shingles."""
    both = pairs
    for side in "ab":
        both = both.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return materialize(both.select("a", "b", (F.col("common") / (F.col("total") - F.col("common"))).alias("similarity")), name)


def _similar(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("similarity") >= LEAST - 1e-9).select("a", "b")


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """pairs with the components la and lb of their sides, where these differ."""
    for side in "ab":
        label = named.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(label, side, "left").withColumn(f"l{side}", F.coalesce(f"of_{side}", side)).drop(f"of_{side}")
    return pairs.where("la <> lb")


def _joined(named: DataFrame, similar: DataFrame, name: str) -> DataFrame:
    """Components after further links: those that exist are nodes of a smaller graph."""
    edges = materialize(_apart(similar, named).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), f"{name}-links", rows=similar.count())
    if edges.isEmpty():
        return named
    merged = components(edges, name).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = named.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    fresh = merged.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(named.select("node"), "node", "left_anti")
    return materialize(old.unionByName(fresh), f"{name}-all", rows=named.count() + 2 * edges.count())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 2, n_views: int = 5, radius: int = 3) -> DataFrame:
    """id, tk (hash of the text) and component of every row; components join pairs of similarity LEAST or more.

    Fingerprints and bands of min-hashes only propose pairs; each counts by its exact Jaccard similarity over
    sets of shingles of EXACT_WIDTH words. First every class is held against the one that most of its bands and
    views propose, then those still apart against their other proposals, last the members of a band that are still
    apart against each other, in rounds of growing shares of their pairs; so a large group of copies takes about one
    comparison a copy. Texts without words have the same, empty set.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("tk"), F.col(text).cast("string").alias("text"))
    prints = materialize(sketches(rows, n_views, width), "views")
    classes = prints.groupBy("class").agg(F.min("fps").alias("fps"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct(F.col("id").isNull(), "id", "tk")).alias("row"))
    classes = materialize(classes, "classes")
    named_rows = materialize(prints.select("id", "tk", "class"), "rows")
    release(prints)
    members = band_members(classes)
    tops = members.where(_alike(F.col("size"), F.col("top_size"))).select(F.col("class").alias("a"), F.col("top").alias("b"))
    proposed = candidate_links(classes, radius).unionByName(tops).where("a <> b")
    pairs = materialize(proposed.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count("*").alias("n")), "pairs")
    wanted = members.select("class").union(pairs.select("a")).union(pairs.select("b")).distinct()
    holders = classes.join(wanted, "class", "left_semi").select("class", F.struct("row.id", "row.tk").alias("row"))
    # A struct is one key, and its null fields are equal; as that of the table read back is taken, repeated rows go without another shuffle.
    texts = holders.join(rows.select(F.struct("id", "tk").alias("row"), "text"), "row").dropDuplicates(["row"])
    sets = materialize(shingle_sets(texts), "sets")
    release(classes)
    n = pairs.count()
    best = materialize(pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "best", rows=n)
    judged = verified(best, sets, "similar")
    named = roots(_similar(judged).select(F.col("a").alias("node"), F.col("b").alias("parent")), "copies")
    others = materialize(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), named).select("a", "b"), "others", rows=n)
    more = verified(others, sets, "similar-others")
    named = _joined(named, _similar(more), "copies-more")
    seen = judged.unionByName(more).select("b", "a").toDF("a", "b")  # as open_pairs names them, the lesser first
    rare, held = rare_shingles(members, named, sets)
    above, share, n = 0.0, first_share(rare), rare.count()
    while above < 1.0:
        some = open_pairs(rare, seen, named, above, share)
        later = verified(some, held, "similar-later")
        named = _joined(named, _similar(later), "copies-later")
        above, share = share, next_share(share, some.count(), n)
        release(some, later)
    release(members, pairs, sets, best, others, judged, more, rare, held)
    return named_rows.join(named.withColumnRenamed("node", "class"), "class", "left").select("id", "tk", F.coalesce("component", "class").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 2, n_views: int = 5, radius: int = 3) -> DataFrame:
    """One row of docs for each component of near copies: the one with the least id, null last, then the least hash of its text.

    Rows that repeat an id but not a text are different rows, and rows with a null id are kept like others. Null,
    empty and blank texts are copies of each other. An empty table gives no rows.
    """
    found = near_copies(docs, id_col, text, width, n_views, radius)
    key = unused("__row", docs.columns)
    stay = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "tk")).alias("row")).select(F.struct("row.id", "row.tk").alias(key))
    tk = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = materialize(stay, "stay").join(docs.withColumn(key, F.struct(F.col(id_col).alias("id"), tk.alias("tk"))), key)
    return kept.dropDuplicates([key]).select(*docs.columns)
