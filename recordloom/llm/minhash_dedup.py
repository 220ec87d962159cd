"""Near-duplicate documents by an inverted join on signature coordinates.

1. Every text becomes its shingle set, a digest of that set and a MinHash signature of ``MINIMA`` minima. Equal sets
   are one class from here on, so exact copies cost one row each and are never paired.
2. A coordinate is made of ``JOINED`` minima, so that chance seldom makes two texts agree on it. Each class posts under
   coordinate-value pairs. Two classes that agree on at least ``t`` of K coordinates share one of the K - t + 1 rarest pairs of either (any fixed order of the pairs gives this; rarest first makes the lists short).
   Pairs that one class alone has are never posted, and a class with K - t + 1 of those posts nothing at all. Frequent
   pairs are thereby skipped wherever rarer ones suffice.
3. Lists are merged around pivots. In a round the most central member of a list (the one whose pairs are the most shared)
   meets the other members that are not yet in its component; then it leaves the list, and lists whose members are one
   component leave too. A list of n near copies thus costs n pairs, not n * n.
4. What is left are lists of classes that share much and yet are no near copies. If few pairs are left, they are made. Else
   these lists are skipped, and their members are met through the rarest shingles of their full sets: two sets that must
   have o shingles in common share one of the first size - o + 1 of either, in any fixed order. A passage that many texts
   share, or a text that many vary, makes long lists of coordinates, but the rarest shingles of a set seldom lie in it. These
   lists are merged around pivots in the same way. The pairs of lists that pivots make no smaller are made at last, those
   that the positions of the shared shingle allow, in blocks of ``BLOCK`` members, so that no task takes a long list whole.
5. Of the candidates those stay with enough equal minima, and each is then confirmed on the full sets. Pairs whose set
   sizes rule the similarity out are never made.

Only links inside one component are ever left untested, so components are exact up to pairs lost by the signature: both
thresholds lie 4.75 standard deviations below the matches expected at the very threshold of similarity (about 1 in 100,000
pairs there, far fewer above it).

Defined cases: null, empty and blank texts have the empty set, stand alone and are kept; very long texts are taken whole; a null
doc_id comes after every integer, so such a row stands for its component only if all ids of it are null; rows that repeat a doc_id
with one text go or stay together (null ones too), rows that repeat it with other texts are judged by their own, each in the
component of its text; ties are decided by the least doc_id, then by the digest; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.components import components
from recordloom.llm.rows import as_bytes, few, join_unique, map_batches, need
from recordloom.llm.shingles import shingle_set
from recordloom.session import Workspace, spread

MINIMA, JOINED = 64, 2
COORDINATES = MINIMA // JOINED
#: Pairs that the last round may make from the coordinates' lists: so many always, and so many for each posting.
FLOOR, PER_POSTING = 100_000, 0.25
#: Another round of pivots follows while the last one has made the pairs that are left fewer by this factor.
PIVOT_GAIN = 8
#: Members of a list that one task pairs with others of it.
BLOCK = 2_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)

_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])


def matches_needed(percent: int, joined: int = 1) -> int:
    """Matches that a pair at the threshold reaches but for 4.75 standard deviations."""
    n, p = MINIMA // joined, (percent / 100) ** joined
    return max(1, math.floor(n * p - 4.75 * math.sqrt(n * p * (1 - p))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over the set, as 32-bit integers."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[at : at + 2048, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _marked(documents: DataFrame) -> DataFrame:
    """doc_id, text and its hash: with the id it tells rows of one id apart."""
    return need(documents, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("mark"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["id"]) & (a["mark"] == b["of"])


def _first(*then: str) -> Column:
    """An order of rows by doc_id, null ones last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *then)


def signed(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, a hash of the text, size of the shingle set, its digest and its signature; both null for the empty set."""

    def batch(b):
        n, digest, sig = [], [], []
        for text in as_bytes(b, "text"):
            s = shingle_set(text or b"", width)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s) if len(s) else None)
        return {"doc_id": b.column("doc_id"), "mark": b.column("mark"), "n": n, "digest": digest, "sig": sig}

    return map_batches(_marked(documents), batch, _SIGNED)


def postings(classes: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """token, cls, n, weight: each class under its rarest shared coordinate-value pairs, as far as its prefix reaches; weight
    tells how shared all of its pairs are. The counts are written first: a join of two plain exchanges splits a hot pair."""
    prefix = COORDINATES - matches_needed(percent, JOINED) + 1
    tokens = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * JOINED + 1, JOINED)))
    each = classes.select("cls", F.explode(tokens).alias("token"))
    shared = ws.keep_small(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    per_class = each.join(shared, "token").groupBy("cls").agg(F.sum("df").alias("weight"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    slots = F.greatest(F.lit(0), F.lit(prefix - COORDINATES) + F.size("tokens"))
    posted = per_class.withColumn("tokens", F.slice("tokens", F.lit(1), slots)).where("size(tokens) > 0").join(classes.select("cls", "n"), "cls")
    return posted.select("cls", "n", "weight", F.explode("tokens").alias("t")).select(F.col("t.token").alias("token"), "cls", "n", "weight")


def _apart(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) < percent * F.greatest(x, y)


def _met(posts: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """The postings of the lists in which two members are close enough in size; the lists are written, as in ``postings``."""
    sizes = posts.select("token", "n").distinct().withColumn("last", F.lag("n").over(Window.partitionBy("token").orderBy("n")))
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"))
    close = sizes.where(~_apart(F.col("n"), F.col("last"), percent)).select("token")
    same = lists.where("c > d").select("token")
    return posts.join(ws.keep_small(close.unionByName(same).distinct(), "close"), "token", "left_semi")


def _sets(documents: DataFrame, classes: DataFrame, posted: DataFrame, width: int, ws: Workspace) -> DataFrame:
    """cls and the full shingle set (64-bit hashes, sorted) of each class that posts."""
    chosen = classes.select("cls", "digest", F.col("doc_id").alias("id"), F.col("mark").alias("of"))
    wanted = ws.keep(posted.select("cls").distinct().join(chosen, "cls"), "wanted")
    marked = _marked(documents)
    rows = marked.join(few(wanted), _same_row(marked, wanted)).select("cls", "digest", "text")

    def batch(b):
        out = {"cls": [], "shingles": []}
        for cls, digest, text in zip(b.column("cls").to_pylist(), b.column("digest").to_pylist(), as_bytes(b, "text"), strict=True):
            s = shingle_set(text or b"", width).tobytes()
            if xxhash.xxh3_128_digest(s) == digest:
                out["cls"].append(cls)
                out["shingles"].append(s)
        return out

    found = ws.keep(map_batches(rows, batch, T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.BinaryType())])), "sets")
    # rows that repeat an id and its text give the set once each
    held = found.agg(F.count("*").alias("n"), F.count_distinct("cls").alias("d")).first()
    return found if held["n"] == held["d"] else ws.keep(found.dropDuplicates(["cls"]), "sets-once")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b and the column of both. The second end brings its value along to the first, of which there are fewer."""
    b = table.select(F.col("cls").alias("b"), F.col(column).alias(f"{column}_b")).join(few(pairs), "b")
    a = table.select(F.col("cls").alias("a"), F.col(column).alias(f"{column}_a")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    return b.join(a, "a")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, needed: int, percent: int, ws: Workspace, label: str) -> DataFrame:
    """The pairs (a, b) with enough coinciding coordinates whose full sets are similar enough."""
    pairs = ws.keep_small(pairs, f"pairs-{label}")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = ws.keep(_with_both(pairs, classes, "sig").where(same >= needed).select("a", "b"), f"likely-{label}")
    both = _with_both(likely, sets, "shingles")

    def batch(b):
        out = {"a": [], "b": []}
        rows = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("shingles_a").to_pylist(), b.column("shingles_b").to_pylist(), strict=True)
        for a, c, x, y in rows:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(c)
        return out

    return map_batches(both.select("a", "b", "shingles_a", "shingles_b"), batch, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return posts.withColumn("label", F.col("cls"))
    named = labels.select(F.col("node").alias("cls"), "label")
    return posts.join(named, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _lists(rows: DataFrame) -> DataFrame:
    """token, the number of cross-label pairs, and the label that most members have, of lists with two labels or more."""
    held = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    sums = held.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.max(F.struct("c", "label")).alias("most"))
    return sums.where("c * c > cc").select("token", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs"), F.col("most.label").alias("major"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))


def _reach(n: Column, other: Column, percent: int) -> Column:
    """How many of a set's rarest shingles must be looked at to meet a set of another size."""
    return n - F.ceil(percent * (n + other) / (100 + percent)) + 1


def _all_pairs(rows: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Every cross-label pair of every list: one of its ends is outside the list's most frequent label. Rows with a
    position among their rarest shingles (``at``) meet only where both positions allow the similarity."""
    live = join_unique(rows, lists, "token").where("blocks IS NOT NULL")
    held = [c for c in ("cls", "n", "label", "at") if c in rows.columns]
    x = live.where("label <> major").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_x") for c in held])
    y = live.select("token", "major", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), *[F.col(c).alias(f"{c}_y") for c in held])
    fits = (F.col("label_y") == F.col("major")) | (F.col("cls_x") < F.col("cls_y"))
    if "at" in held:
        fits &= (F.col("at_x") <= _reach(F.col("n_x"), F.col("n_y"), percent)) & (F.col("at_y") <= _reach(F.col("n_y"), F.col("n_x"), percent))
    met = x.join(y, ["token", "block"]).where((F.col("label_x") != F.col("label_y")) & fits & ~_apart(F.col("n_x"), F.col("n_y"), percent))
    return met.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b"))


def _rare_shingles(live: DataFrame, sets: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Postings (token, cls, n, at) of the live classes under the rarest shingles of their full sets, as far as the
    smallest partner in the list allows."""

    def batch(b):
        return {"cls": b.column("cls"), "shingles": [np.frombuffer(x, np.int64) for x in b.column("shingles").to_pylist()]}

    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    each = map_batches(sets.join(few(live), "cls", "left_semi"), batch, schema).select("cls", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
    shared = ws.keep_small(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-rare")
    per_class = each.join(shared, "token").groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    alone = F.col("n") - F.size("tokens")  # shingles that no other class has come first
    least = F.ceil(F.col("n") * percent / 100)
    slots = F.greatest(F.lit(0), _reach(F.col("n"), least, percent) - alone).cast("int")
    placed = per_class.select("cls", "n", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), slots)).alias("k", "t"))
    posted = ws.keep(placed.select(F.col("t.token").alias("token"), "cls", "n", (F.col("alone") + F.col("k") + 1).alias("at"), F.ceil(F.col("n") * percent / 100).alias("least")), "rare")
    smallest = ws.keep_small(posted.groupBy("token").agg(F.min("n").alias("low")), "smallest")
    # the larger set of a list is the better pivot, as it can hold the others
    return posted.join(smallest, "token").where(F.col("at") <= _reach(F.col("n"), F.greatest("low", "least"), percent)).select("token", "cls", "n", "at", F.col("n").alias("weight"))


def _linked(ws: Workspace, posts: DataFrame, classes: DataFrame, sets: DataFrame, needed: int, percent: int) -> DataFrame | None:
    """Component labels of all classes that are linked to another."""
    labels, step, before, rare = None, 0, math.inf, False
    bound = max(FLOOR, PER_POSTING * posts.count())
    while True:
        step += 1
        rows = _labelled(posts, labels)
        rows = rows if labels is None else ws.keep(rows, f"labelled-{step}")
        lists = ws.keep_small(_lists(rows), f"lists-{step}")
        left = lists.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            return labels
        stuck = left > before / PIVOT_GAIN
        if left > bound and stuck and not rare:
            # the pivots of these lists make them no shorter: their members meet through the rarest shingles instead
            live = ws.keep(rows.join(lists, "token", "left_semi").select("cls").distinct(), "live")
            posts = ws.keep(_rare_shingles(live, sets, percent, ws), "rarest")
            bound, before, rare = max(FLOOR, PER_POSTING * posts.count()), math.inf, True
            continue
        last = left <= bound or stuck
        if last:
            pairs = _all_pairs(rows, lists, percent)
        else:
            central = F.max(F.struct("weight", (-F.col("cls")).alias("order"), "cls", "n", "label")).alias("p")
            pivots = ws.keep_small(rows.groupBy("token").agg(central).join(lists.select("token"), "token", "left_semi"), f"pivots-{step}")
            met = ws.keep(join_unique(rows, pivots, "token").where("cls <> p.cls"), f"met-{step}")
            pairs = met.where((F.col("label") != F.col("p.label")) & ~_apart(F.col("n"), F.col("p.n"), percent)).select(F.col("p.cls").alias("a"), F.col("cls").alias("b"))
            posts = met.select(*posts.columns)
        links = confirmed(pairs.distinct(), classes, sets, needed, percent, ws, str(step))
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = ws.keep_small(components(links, ws, f"links-{step}"), f"labels-{step}")
        for name in ("pairs", "likely", "labelled", "lists", "pivots"):
            ws.drop(f"{name}-{step}")
        for name in ("met", "labels"):
            ws.drop(f"{name}-{step - 1}")
        if last:
            return labels
        before = left


def _judged(documents: DataFrame, width: int, percent: int, ws: Workspace) -> DataFrame:
    """doc_id, mark, n, label (the least doc_id of the component), kept, for every row."""
    needed = matches_needed(percent)
    rows = ws.keep(signed(documents, width), "signed")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(_first("mark")).alias("m"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # numbers that hold from here on, as the table is written
    classes = ws.keep(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "m.doc_id", "m.mark", "copies", "n", "sig"), "classes")
    posts = ws.keep(_met(ws.keep(postings(classes, percent, ws), "posted"), percent, ws), "postings")
    sets = _sets(documents, classes, posts, width, ws)
    labels = _linked(ws, posts, classes, sets, needed, percent)
    grouped = classes.where("copies > 1").select("cls", "digest", F.col("doc_id").alias("label"), F.lit(True).alias("first"))
    if labels is not None:
        named = labels.select(F.col("node").alias("cls"), F.col("label").alias("group"))
        linked = ws.keep(classes.select("cls", "digest", "doc_id").join(named, "cls"), "linked")
        top = linked.groupBy("group").agg(F.min(_first("digest")).alias("top"))
        linked = linked.join(few(ws.keep_small(top, "top")), "group").select("cls", "digest", F.col("top.doc_id").alias("label"), (F.col("digest") == F.col("top.digest")).alias("first"))
        grouped = grouped.join(named, "cls", "left_anti").unionByName(linked)
    # rows of unique texts that are linked to nothing have no group
    out = join_unique(rows.select("doc_id", "mark", "n", "digest"), ws.keep(grouped.drop("cls"), "grouped"), "digest")
    for name in ("shared", "shared-rare", "smallest", "close", "posted", "postings", "wanted", "sets", "sets-once", "classes", "linked", "top", "live", "rare", "rarest"):
        ws.drop(name)
    kept = F.col("first").isNull() | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("label")))
    return out.select("doc_id", "mark", "n", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("label")).alias("label"), kept.alias("kept"))


def members(documents: DataFrame, width: int = 5, percent: int = 80, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept, for every row."""
    ws = workspace or Workspace(documents.sparkSession, "near-duplicates")
    return _judged(documents, width, percent, ws).select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), "kept")


def keep(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another of their component stands for, with all columns. A row is known by its
    doc_id and its text. While few go, the list of them is sent to the documents and not the documents shuffled."""
    ws = Workspace(documents.sparkSession, "near-duplicates")
    gone = _judged(documents, width, percent, ws).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    gone = ws.keep(gone, "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64("text") == F.col("__mark"))
    return documents.join(few(gone), same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: components over shingles of two words."""
    return members(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), width=2)
