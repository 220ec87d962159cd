"""Near-duplicate joins.

Signatures: a pair at similarity t or more differs in at most m = floor(size * (1 - t)) positions, so with more than m
bands at least one band is equal; the banded equi-join loses nothing. Sets: two sets of Jaccard similarity t share one of the
rarest (1 - t) * size + 1 items of either. Sets of texts (``shingle_pairs``) are cut into more parts than two sets so alike can
differ in items, so at least one part is equal; no set or list of its items is shuffled to find that. Equal signatures (or sets) are one class first, so copies are never paired: pairs
are between the least ids of classes, and ``classes`` gives the membership.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import fingerprint as fp
from recordloom.session import Workspace, spread

#: Beyond this many rows a side is shuffled, not broadcast (a signature is about 1 KB).
BROADCAST_ROWS = 10_000
#: The same for rows of a few numbers.
BROADCAST_NARROW = 1_000_000
#: Members of a list that meet others in one task; members, and shingles of all of them, that are compared with others at once.
LIST_BLOCK, SET_BLOCK, SHINGLE_BLOCK = 1_000, 256, 1 << 18


def signatures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, signature of each text with a token."""
    return spread(documents.select(key, text)).select(key, fp.signature_udf(F.col(text)).alias("signature")).where("signature IS NOT NULL")


def classes(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """signature, class_id (least key), members."""
    return signed.groupBy("signature").agg(F.min(key).alias("class_id"), F.count("*").alias("members"))


def bands_for(threshold: float) -> int:
    """The fewest bands (a divisor of the size) that lose no pair."""
    differ = int(fp.SIZE * (1 - threshold) + 1e-9)
    return next(b for b in (1, 2, 4, 8, 16, 32, 64, 128) if b > differ)


def _banded(df: DataFrame, bands: int) -> DataFrame:
    rows = fp.SIZE // bands
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    return df.select("*", F.posexplode(each).alias("band", "value"))


def _meetings(keys: DataFrame, on: list[str], block: int = 1000) -> DataFrame:
    """a, b of the rows (key, *on) that agree on ``on``, a < b, each pair once. What only one row has goes before the join; what
    more than ``block`` rows share is dealt in blocks, so that no task makes all the pairs of it."""
    shared = keys.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    busy = keys.join(shared, on)
    x = busy.select(F.col("key").alias("a"), *on, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = busy.select(F.col("key").alias("b"), *on, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    return x.join(y, [*on, "block"]).where("a < b").select("a", "b").distinct()


def signature_pairs(grouped: DataFrame, threshold: float = 0.85) -> DataFrame:
    """a, b, similarity of classes at or above the threshold (compared before rounding)."""
    met = _meetings(_banded(grouped.select(F.col("class_id").alias("key"), "signature"), bands_for(threshold)).select("key", "band", "value"), ["band", "value"])
    side = lambda n: grouped.select(F.col("class_id").alias(n), F.col("signature").alias(f"s{n}"))
    sim = fp.similarity(F.col("sa"), F.col("sb"))
    return met.join(side("a"), "a").join(side("b"), "b").withColumn("sim", sim).where(F.col("sim") >= threshold).select("a", "b", F.bround("sim", 4).alias("similarity"))


def against_registry(candidates: DataFrame, registry: DataFrame, threshold: float = 0.85) -> DataFrame:
    """candidate, registered, similarity, place: new signatures (key, signature) against registered ones, best first; a row is
    never compared with itself and registered rows without a signature are skipped."""
    bands = bands_for(threshold)
    new = _banded(candidates.select(F.col("key").alias("candidate"), "signature"), bands).select("candidate", "band", "value")
    old = _banded(registry.where("signature IS NOT NULL AND size(signature) > 0").select(F.col("key").alias("registered"), "signature"), bands).select("registered", "band", "value")
    met = new.join(old, ["band", "value"]).where("candidate <> registered").select("candidate", "registered").distinct()
    sim = fp.similarity(F.col("sc"), F.col("sr"))
    full = met.join(candidates.select(F.col("key").alias("candidate"), F.col("signature").alias("sc")), "candidate").join(registry.select(F.col("key").alias("registered"), F.col("signature").alias("sr")), "registered")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("sim"), "registered"))
    return full.withColumn("sim", sim).where(F.col("sim") >= threshold).withColumn("place", place).select("candidate", "registered", F.bround("sim", 4).alias("similarity"), "place")


def against_registry_or_shingles(candidates: DataFrame, registry: DataFrame, percent: int = 85) -> DataFrame:
    """candidate, registered, similarity, place over a registry (key, signature, shingles) of which some rows have a signature and
    older ones only shingles: the former by signatures, the latter by the Jaccard similarity of shingles. Candidates are (key,
    signature, shingles)."""
    by_signature = against_registry(candidates.where("signature IS NOT NULL").select("key", "signature"), registry.select("key", "signature"), percent / 100).drop("place")
    old = registry.where("(signature IS NULL OR size(signature) = 0) AND size(shingles) > 0").select(F.struct(F.lit(1).alias("old"), F.col("key").alias("k")).alias("key"), F.col("shingles").alias("items"))
    new = candidates.where("size(shingles) > 0").select(F.struct(F.lit(0).alias("old"), F.col("key").alias("k")).alias("key"), F.col("shingles").alias("items"))
    met = jaccard_pairs(old.unionByName(new), percent, only=lambda a, b: a["old"] < b["old"])
    by_shingles = met.select(F.col("a.k").alias("candidate"), F.col("b.k").alias("registered"), F.bround(F.col("common") / F.col("either"), 4).alias("similarity")).where("candidate <> registered")
    from pyspark.sql import Window

    both = by_signature.unionByName(by_shingles)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("similarity"), "registered")))


def jaccard_pairs(sets: DataFrame, percent: int = 85, only=lambda a, b: F.lit(True)) -> DataFrame:
    """a, b, common, either for rows (key, items: distinct) whose Jaccard similarity is at least ``percent`` %, of the pairs of keys
    a < b that ``only`` allows. Rows with equal items should be one row."""
    each = sets.select("key", F.size("items").alias("n"), F.explode("items").alias("item"))
    frequency = each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(frequency, "item").groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "item"))).alias("rare"))
    slots = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("n") + F.size("rare")).cast("int")
    posts = shared.select("key", "n", F.explode(F.slice("rare", F.lit(1), slots)).alias("r")).select("key", "n", F.col("r.item").alias("item"))
    close = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    met = posts.alias("x").join(posts.alias("y"), "item").where((F.col("x.key") < F.col("y.key")) & only(F.col("x.key"), F.col("y.key")) & close).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    side = lambda n: sets.select(F.col("key").alias(n), F.col("items").alias(f"i{n}"))
    both = F.size(F.array_intersect("ia", "ib"))
    full = met.join(side("a"), "a").join(side("b"), "b").withColumn("common", both).withColumn("either", F.size("ia") + F.size("ib") - both)
    return full.where(100 * F.col("common") >= percent * F.col("either")).select("a", "b", "common", "either")


@functools.cache
def _sizes(percent: int) -> list[int]:
    """The least size of each level. The larger of two sets so alike is of the smaller one's level or the next."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return low


def _differ(level: int, percent: int) -> int:
    """The most items that two sets so alike can differ in, where the smaller one is of this level."""
    small = _sizes(percent)[level + 1] - 1
    return (small + small * 100 // percent) * (100 - percent) // (100 + percent)


def _parts(items: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Keys of which two sets so alike have one in common, where the smaller one is of this level (sorted 64-bit hashes).

    A set is cut by its hashes into d + 1 + e parts, d being the items that two sets can differ in: at least e + 1 parts are equal. In
    one order of all parts (most items first, empty ones last) the first equal part is then among the first d + 1 of either."""
    differ = _differ(level, percent)
    if not differ:
        return np.array([], np.uint64)  # only equal sets are so alike
    count = differ + 4 + differ // 32
    part = ((items >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    held, lengths = part[starts], np.diff(starts, append=len(items))
    key = fp.mix(np.add.reduceat(fp.mix(items), starts) + fp.mix((held << np.uint64(16)) + np.uint64(level)))
    if len(key) > differ:
        return key[np.lexsort((key, -lengths))[: differ + 1]]
    empty = np.setdiff1d(np.arange(count, dtype=np.uint64), held)[: differ + 1 - len(key)]
    return np.concatenate([key, fp.mix((empty << np.uint64(16)) + np.uint64(level))])


def _posted(docs: DataFrame, percent: int) -> DataFrame:
    """key, digest and size of the set of each text with a token, and what it posts under: the keys of its own level, of which there
    are ``own``, then those of the level below, by which it meets smaller sets."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, digest, n, own, posts = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                items = fp.shingle_hashes(text)
                if len(items):
                    level = bisect.bisect_right(_sizes(percent), len(items)) - 1
                    keys = [_parts(items, k, percent) for k in (level, level - 1) if k >= 0]
                    at.append(i)
                    digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    n.append(len(items))
                    own.append(len(keys[0]))
                    posts.append(np.concatenate(keys).view(np.int64))
            ends = np.cumsum([0, *map(len, posts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.array([], np.int64), *posts])))
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(at, pa.int64())), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(own, pa.int32()), lists], names=["key", "digest", "n", "own", "posts"]
            )

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("own", T.IntegerType()), T.StructField("posts", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(batches, T.StructType([docs.schema["key"], *fields]))


def _narrow(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_NARROW else side


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, key and the set (sorted 64-bit hashes) of the wanted classes (cls, key, digest)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, sets = [], []
            for i, (text, digest) in enumerate(zip(b.column("text").to_pylist(), b.column("digest").to_pylist(), strict=True)):
                items = fp.shingle_hashes(text).tobytes()
                if hashlib.blake2b(items, digest_size=16).digest() == digest:
                    at.append(i)
                    sets.append(items)
            which = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cls").take(which), b.column("key").take(which), pa.array(sets, pa.binary())], names=["cls", "key", "items"])

    found = docs.join(_narrow(wanted), "key").select("cls", "key", "digest", "text")
    return found.mapInArrow(batches, T.StructType([T.StructField("cls", T.LongType()), docs.schema["key"], T.StructField("items", T.BinaryType())]))


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """a, b, common, either of rows (g, a, b, key, items), sorted by g: a class's set where b is null, and after those of its g the pairs
    (a, b) to compare, sorted by a."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, {}
        for b in rows:
            out = [[], [], [], []]
            met: list[int] = []
            names = b.column("g").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist()
            for i, (g, x, y) in enumerate(zip(*names, strict=True)):
                if g != group:
                    group, sets = g, {}
                if y is None:
                    sets[x] = b.column("key")[i].as_py(), np.frombuffer(b.column("items")[i].as_py(), np.uint64)
                    continue
                met.append(y)
                if i + 1 < len(names[0]) and names[0][i + 1] == g and names[1][i + 1] == x and names[2][i + 1] is not None:
                    continue
                key, one = sets[x]
                lengths = np.array([len(sets[k][1]) for k in met])
                many = np.concatenate([sets[k][1] for k in met])
                found = one[np.minimum(np.searchsorted(one, many), len(one) - 1)] == many
                common = np.add.reduceat(found, np.cumsum(lengths) - lengths, dtype=np.int64)
                either = len(one) + lengths - common
                for k in np.flatnonzero(100 * common >= percent * either):
                    other = sets[met[k]][0]
                    if other != key:
                        for column, value in zip(out, (min(key, other), max(key, other), int(common[k]), int(either[k])), strict=True):
                            column.append(value)
                met = []
            kind = b.schema.field("key").type
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (kind, kind, pa.int32(), pa.int32()), strict=True)], names=["a", "b", "common", "either"])

    key = rows.schema["key"].dataType
    return rows.mapInArrow(batches, T.StructType([T.StructField("a", key), T.StructField("b", key), T.StructField("common", T.IntegerType()), T.StructField("either", T.IntegerType())]))


def shingle_pairs(documents: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, common, either of texts whose shingle sets' Jaccard similarity is at least ``percent`` %. Equal sets are one class, under
    its least key; texts without a token and rows without a key are left out. Shingles are told apart by 64-bit hashes.

    Classes meet in lists of equal parts (``_parts``), of which those of one member go first. Pairs are compared on the whole sets: classes
    that share their longest list lie in one block, and a set is sent once to each two blocks that it has a pair in."""
    ws = Workspace(documents.sparkSession, "shingles")
    docs = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL"))
    rows = ws.keep(_posted(docs, percent).withColumn("cls", F.monotonically_increasing_id()), "rows")
    first = rows.groupBy("digest").agg(F.min(F.struct("key", "cls")).alias("m"))
    classes = ws.keep(first.select("m.cls", "m.key", "digest"), "classes")
    copies = ws.keep(rows.select("cls").join(classes.select("cls"), "cls", "left_anti"), "copies")
    posts = rows.join(_narrow(copies), "cls", "left_anti").select("cls", "n", "own", F.posexplode("posts").alias("k", "post"))
    members = F.count("*").over(Window.partitionBy("post")).alias("c")
    shared = ws.keep(posts.select("cls", "n", (F.col("k") < F.col("own")).alias("own"), "post").select("*", members).where("c > 1"), "shared")
    ws.drop("rows")

    blocks = F.ceil(F.col("c") / LIST_BLOCK).cast("int")
    x = shared.select("post", "own", F.col("n").alias("nx"), F.col("cls").alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    y = shared.select("post", F.col("own").alias("also"), F.col("n").alias("ny"), F.col("cls").alias("b"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    close = 100 * F.least("nx", "ny").cast("long") >= percent * F.greatest("nx", "ny").cast("long")
    pairs = x.join(y, ["post", "block"]).where((F.col("a") < F.col("b")) & (F.col("own") | F.col("also")) & close).select("a", "b").distinct()

    longest = shared.groupBy("cls").agg(F.max(F.struct("c", "post")).alias("l"), F.first("n").alias("n")).select("cls", "n", F.col("l.post").alias("list"))
    parted = longest.groupBy("list").agg(F.ceil(F.greatest(F.sum("n") / SHINGLE_BLOCK, F.count("*") / SET_BLOCK)).cast("int").alias("parts"))
    place = ws.keep_small(longest.join(parted, "list").select("cls", F.xxhash64("list", F.pmod(F.xxhash64("cls"), "parts")).alias("place")), "places")
    side = lambda n: place.select(F.col("cls").alias(n), F.col("place").alias(f"p{n}"))
    group = F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")).alias("g")
    pairs = ws.keep(pairs.join(side("a"), "a").join(side("b"), "b").select(group, "a", "b"), "pairs")

    needs = ws.keep(pairs.select("g", F.explode(F.array("a", "b")).alias("cls")).distinct(), "needs")
    wanted = ws.keep(classes.join(needs.select("cls").distinct(), "cls"), "wanted")
    sets = ws.keep(_sets(docs, wanted), "sets")
    sent = sets.join(_narrow(needs), "cls").select("g", F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "key", "items")
    asked = pairs.select("g", "a", "b", F.lit(None).cast(docs.schema["key"].dataType).alias("key"), F.lit(None).cast("binary").alias("items"))
    return _compared(sent.unionByName(asked).repartition("g").sortWithinPartitions("g", F.col("b").isNotNull(), "a"), percent)


def exact_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sha256, copies, first key of texts that occur more than once."""
    return documents.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min(key).alias("first_id")).where("copies > 1")


def known(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The candidates whose sha256 the registry has."""
    return candidates.join(registry.select("sha256"), "sha256", "left_semi")
