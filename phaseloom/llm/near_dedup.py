"""Near-duplicate documents from bottom-k sketches of word shingles.

One hash function gives every shingle a 64-bit value; a document's sketch is its K smallest values. Documents with equal
shingle sets collapse into one node first. Inverted lists of the sketch values then generate overlaps: two sketches that
agree on half of their values or more share one of their rarest K/2+1 values, so only those stand in the lists. The
union sketch of a pair (the K smallest values of both) estimates the similarity and filters; full sets then verify it
exactly. A pair with a true similarity of 0.8 fails the filter at 0.5 with a chance of about 1e-9; sets of up to K
shingles are compared exactly by it.

No list of over PAIRS nodes is expanded into all pairs. The nodes of such lists are listed anew by the rarest shingles of
their full sets, as many as a partner must share one of; the places of a shared one in both sets bound the overlap, and
pairs that cannot reach the similarity are left out. Lists that are still large are compared with one leader a round;
nodes already in one component need no comparison with each other. What lies in different components after ROUNDS rounds
is compared exhaustively, block against block. Shingles, sets, list leaders and components that hold a large part of all rows
are looked up first and dealt to several places wherever their rows are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseloom.llm.common import give_back, hot_join, hot_limit, slices, stored, table
from phaseloom.llm.components import components

K = 64
#: Share of a sketch, and of a union sketch, that must agree before a pair is verified.
AGREE = 0.5
#: Lists of up to so many nodes give all their pairs at once.
PAIRS = 24
ROUNDS = 3
#: Members of a list that are compared exhaustively at once, where that is needed at the end.
BLOCK = 256
#: Fixed odd multiplier of the polynomial over word hashes, and the finalizer's constants.
MULTIPLIER, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text whose shingles are hashed at once.
BYTES = 3_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: size words each; fewer words make one shingle, none make none."""
    words = [(t or "").encode().lower().split() for t in texts]
    hashes = np.fromiter((h for ws in words for h in map(xxhash.xxh3_64_intdigest, ws)), np.uint64, sum(map(len, words)))
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * MULTIPLIER + hashes[k : k + len(rolled)]
    rolled = _mixed(rolled).view(np.int64)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            short = np.uint64(n)
            for h in hashes[at : at + n]:
                short = short * MULTIPLIER + h
            out.append(_mixed(np.array([short])).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += n
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str, full: bool = False) -> DataFrame:
    """(id, mark, sig, n, values): values is the sketch, or with full the whole set."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("sig", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([_signature(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets if full else [s[:K] for s in sets])],
                    names=["id", "mark", "sig", "n", "values"],
                )
        give_back()

    return source.mapInArrow(run, schema)


def _prefixes(nodes: DataFrame, limit: int) -> DataFrame:
    """(v, node): the rarest sketch values of nodes that can have a partner; values of over limit nodes are dealt."""
    entries = nodes.select("node", F.size("values").alias("k"), F.explode("values").alias("v"))
    shared = stored(entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    need = F.ceil(F.col("k") * AGREE).cast("int")
    rare = hot_join(entries, shared, "v", F.col("node"), limit, size="df").groupBy("node").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by"))
    # values that no other sketch has would come first, and count as passed over
    take = F.col("k") - need + 1 - (F.col("k") - F.size("by"))
    return rare.filter(F.size("by") >= need).select("node", F.explode(F.slice("by", 1, F.greatest(take, F.lit(0)))).alias("x")).select(F.col("x.v").alias("v"), "node")


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketches agree enough and whose full sets reach the similarity."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("values").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("values").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    agree = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    near = near.withColumn("union", union).filter(agree >= AGREE * F.size("union")).select("a", "b", "na", "nb")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("i"))
    return both.filter(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _exact_prefixes(sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """(v, node, at, n): the rarest shingles of each full set, n - ceil(n * percent / 100) + 1 of them, with their places."""
    entries = sets.select("node", F.explode("set").alias("v"))
    held = stored(entries.groupBy("v").agg(F.count("*").alias("df")), "held")
    rare = hot_join(entries, held, "v", F.col("node"), limit, size="df").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("by")).withColumn("n", F.size("by"))
    take = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    out = rare.select("node", "n", F.posexplode(F.slice("by", 1, take)).alias("at", "x")).filter("x.df > 1")
    return out.select(F.col("x.v").alias("v"), "node", "at", "n")


def _can_reach(percent: int, at: str, n: str, other_at: str, other_n: str) -> Column:
    """Whether sets whose first shared shingle stands at these places can have the overlap that the similarity needs."""
    most = 1 + F.least(F.col(n) - F.col(at) - 1, F.col(other_n) - F.col(other_at) - 1)
    return (100 + percent) * most >= percent * (F.col(n) + F.col(other_n))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, text_hash, n_shingles, component_id and kept.

    Rows are linked if their sets of word shingles have a Jaccard similarity of percent/100 or more; component_id is the
    smallest id that can be reached over links, kept tells whether it is the row's own. A row without words has no
    shingles and is its own component. Rows may repeat an id: each is judged by its own text. Null ids are passed over in
    the choice of the smallest, so a component of rows with null ids alone has a null component_id, and they are kept.
    Other columns of docs are not read.
    """
    rows = stored(sketches(docs, size, id_col, text_col), "sketches")
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.size("values")).alias("entries"), F.sum("n").alias("shingles")).first()
    limit, entry_limit, shingle_limit = (hot_limit(x or 0) for x in total)
    who = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("who")  # the smallest id, null ids last
    nodes = rows.filter("n > 0").groupBy("sig").agg(who, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("values").alias("values"))
    nodes = stored(nodes.select("sig", F.col("who.id").alias("first"), F.col("who.mark").alias("mark"), "copies", "n", "values").withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    lists = stored(_prefixes(nodes, entry_limit), "entries")
    sizes = stored(lists.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    lists = stored(hot_join(lists, sizes, "v", F.col("node"), size="size"), "lists")
    live = lists.select("node").distinct()
    few = stored(nodes.join(live, "node"), "live")
    wanted = few.select(F.col("first").alias("want"), F.col("mark").alias("want_mark"), F.col("sig").alias("as"), "node")
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__mark"), F.col(text_col).alias("__text"))
    texts = texts.join(wanted.select("want", "want_mark").distinct(), texts["__id"].eqNullSafe(F.col("want")) & (texts["__mark"] == F.col("want_mark")), "left_semi")
    sets = sketches(texts, size, "__id", "__text", full=True).select("sig", F.col("values").alias("set"))
    sets = stored(sets.join(wanted.select(F.col("as").alias("sig"), "node"), "sig").groupBy("node").agg(F.first("set").alias("set")), "sets")

    def all_pairs(members: DataFrame, *more: Column) -> DataFrame:
        a, b = (members.select("v", *(F.col(c).alias(f"{c}_{x}") for c in members.columns if c != "v")) for x in ("a", "b"))
        return a.join(b, "v").filter("node_a < node_b").filter(more[0] if more else F.lit(True)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    def block_pairs(members: DataFrame) -> DataFrame:
        """All pairs of members of a list, block against block: no task gets a whole list."""
        sizes = stored(members.groupBy("v").agg(F.count("*").alias("size")), "sizes").withColumn("of", F.ceil(F.col("size") / BLOCK).cast("int"))
        own = hot_join(members, sizes, "v", F.col("node"), size="size").drop("size").withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), "of").cast("int"))
        a, b = (own.select("v", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "at", "n", "root", "of", "mine"))) for x in ("a", "b"))
        a = a.withColumn("mine_b", F.explode(F.sequence(F.lit(0), F.col("of_a") - 1))).filter("mine_a <= mine_b")
        b = b.withColumn("mine_a", F.explode(F.sequence(F.lit(0), F.col("of_b") - 1))).filter("mine_a <= mine_b")
        return a.join(b, ["v", "mine_a", "mine_b"]).filter("mine_a < mine_b or node_a < node_b")

    hot = lists.filter(F.col("size") > PAIRS).select("node").distinct()
    exact = stored(_exact_prefixes(sets.join(hot, "node"), percent, shingle_limit), "prefixes")
    sizes = stored(exact.groupBy("v").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    exact = stored(hot_join(exact, sizes, "v", F.col("node"), size="size"), "exact")
    large = exact.filter(F.col("size") > PAIRS).drop("size")
    close = _can_reach(percent, "at_a", "n_a", "at_b", "n_b")

    def with_leader(members: DataFrame, turn: int) -> DataFrame:
        """Members that can reach the leader of their list: first the one whose shared shingles begin soonest, then any."""
        by = F.struct("at", "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "node"), "node")
        leader = stored(members.groupBy("v").agg(F.min_by(F.struct("node", "at", "n", "root"), by).alias("lead"), F.count("*").alias("size")), "leaders")
        led = hot_join(members, leader, "v", F.col("node"), size="size").select("node", "at", "n", "root", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "at", "n", "root")))
        return led.filter("root <> lead_root").filter(_can_reach(percent, "at", "n", "lead_at", "lead_n")).select(*_ordered("node", "lead_node"))

    few_pairs = all_pairs(lists.filter(F.col("size") <= PAIRS).select("v", "node")).union(all_pairs(exact.filter(F.col("size") <= PAIRS).drop("size"), close))
    tried = stored(few_pairs.union(with_leader(large.withColumn("root", F.col("node")), 0)).distinct(), "pairs")
    links = stored(_verified(tried, few, sets, percent), "verified")
    roots = components(links)
    for turn in range(1, ROUNDS + 2):
        at = stored(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        open_lists = stored(at.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("v", "size"), "lists")
        at = stored(hot_join(at, open_lists, "v", F.col("node"), size="size").drop("size"), "open")
        if at.isEmpty():
            break
        pairs = with_leader(at, turn) if turn <= ROUNDS else block_pairs(at).filter(close & (F.col("root_a") != F.col("root_b"))).select(*_ordered("node_a", "node_b"))
        new = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue
        tried = tried.union(new)
        found = stored(_verified(new, few, sets, percent), "verified")
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links)

    named = stored(nodes.join(roots, "node", "left").select("sig", "first", "copies", F.coalesce("root", "node").alias("root")), "named")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size")), "components")
    by_sig = stored(hot_join(named, least, "root", F.col("sig"), size="size").select("sig", "copies", "component"), "by-set")
    rows = rows.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("sig")).otherwise(F.unhex(F.hex(F.xxhash64("id", "mark")))).alias("sig"))
    out = hot_join(rows, by_sig, "sig", F.struct("id", "mark"), limit, "left", "copies").withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(id_col), F.col("mark").alias("text_hash"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; same columns."""
    gone = near_duplicates(docs, size, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__mark")).distinct()
    keyed = docs.withColumn("__hash", F.xxhash64(text_col))
    return keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"]) & (keyed["__hash"] == gone["__mark"]), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")
