"""Near-duplicates by SuperMinHash, banding, verification and union-find grouping (operator 4).

1. A text becomes its set of distinct 5-word shingles (64-bit hashes). SuperMinHash lets every shingle visit the ``SLOTS``
   slots in an order of its own: at its visit number j it offers j plus a random fraction. Slots keep the least offer, so
   after level j all slots below j + 1 are final, and a text stops there: about max(n, SLOTS ln SLOTS) visits a text.
2. Equal sets are one node, found by a digest of the set. Bands of ``ROWS`` slots put nodes into buckets. A pair at the
   least linked similarity 0.85 misses all 32 bands with probability 3e-7 (1 - 0.85^6, to the power 32).
3. Buckets are not expanded into pairs. In two rounds every node is compared with one pivot from its buckets and what is
   linked is merged, so a group of near copies costs one comparison a copy. Only nodes in buckets that still hold several
   components go on. They meet by the shingles that may be the first they share, rarest first, the smaller components of
   such a shingle against all of it: no link between components is left out, and copies too far apart do not meet.
4. Before sets are fetched, a pair must pass two tests. Shingles that no other node has cannot be in an intersection, which
   bounds the similarity of a pair (exactly); that settles copies with too many changes of their own without any comparison.
   And one bit of each slot is compared: at most ``MOST_BITS`` of 192 may differ, which a linked pair exceeds with
   probability below 1e-8. Every link is confirmed on the full sets.

Sets are computed a second time, for the nodes in shared buckets only, so that no set of a lone text is ever stored.

Defined cases: a null or wordless text has the empty set, is linked with nothing and kept; a text of fewer than five words has
its whole sequence as its one shingle; a null doc_id is linked like any other, comes after all ids, and a component of such rows
only has a null name; of each component one row stays, rows that repeat an id or have none included; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import giving_back, keep
from fieldaudit.llm.graph import components

WIDTH = 5
SLOTS = 192
ROWS = 6
MOST_BITS = 40
ROUNDS = 2
#: Ids of nodes to look up are broadcast up to this number; beyond, the lookup is a shuffled join.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 100_000
BATCH_CHARS = 1_000_000
SKETCH = "n_shingles long, node binary, bands array<long>, bits array<long>"

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Odd factors without linear relations between them, so that no two orders of the same words share a sum.
FACTORS = mixed(np.arange(1, 9, dtype=U) * GOLDEN) | U(1)


def step(k: int) -> np.uint64:
    return U(k * int(GOLDEN) & (1 << 64) - 1)


class Words(dict):
    """64-bit hashes of words, looked up after the first time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; A-Z are lowered, words are divided by ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, U)
    h = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    if len(h) < WIDTH:
        return mixed((h * FACTORS[:len(h)]).sum(keepdims=True) + step(len(h)))
    total = h[:len(h) - WIDTH + 1] * FACTORS[0]
    for k in range(1, WIDTH):
        total = total + h[k:len(h) - WIDTH + 1 + k] * FACTORS[k]
    return np.unique(mixed(total))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (level << 32 | fraction) of non-empty sets, all advanced level by level."""
    sizes = np.array([len(s) for s in sets])
    sign = np.full(len(sets) * slots, np.iinfo(np.uint64).max, U)
    item, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = None
    for level in range(slots):
        draw = mixed(item + step(level + 1))
        at = level + (((draw & U(0xFFFFFFFF)) * U(slots - level)) >> U(32)).astype(np.int64)
        if order is None:
            slot = at
        else:
            slot = np.take_along_axis(order, at[:, None], 1)[:, 0].astype(np.int64)
        np.minimum.at(sign, doc * slots + slot, U(level << 32) | (draw >> U(32)))
        open_docs = sign.reshape(-1, slots).max(1) >= U((level + 1) << 32)
        stay = open_docs[doc]
        if not stay.any():
            break
        if order is None:
            item, doc, at = item[stay], doc[stay], at[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(item), 1))
        elif stay.mean() < 0.7:
            item, doc, at, order = item[stay], doc[stay], at[stay], order[stay]
        np.put_along_axis(order, at[:, None], order[:, level:level + 1], 1)
    return sign.reshape(-1, slots)


def bands_of(sign: np.ndarray) -> np.ndarray:
    """One hash for each band, which holds the band's number too."""
    parts = sign.reshape(len(sign), -1, ROWS)
    total = (mixed(parts) * FACTORS[:ROWS]).sum(2, dtype=U)
    return mixed(total + np.arange(1, parts.shape[1] + 1, dtype=U) * GOLDEN).view(np.int64)


def bits_of(sign: np.ndarray) -> np.ndarray:
    return np.packbits((mixed(sign) & U(1)).astype(bool), axis=1).view(np.int64)


def pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars > BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def sketch_rows(texts: list[str | None], words: Words) -> list[tuple]:
    sets = [shingles(t, words) for t in texts]
    full = [k for k, s in enumerate(sets) if len(s)]
    rows: list[tuple] = [(0, None, None, None)] * len(sets)
    if full:
        sign = superminhash([sets[k] for k in full])
        for k, bands, bits in zip(full, bands_of(sign), bits_of(sign)):
            rows[k] = (len(sets[k]), xxhash.xxh3_128_digest(sets[k].tobytes()), bands, bits)
    return rows


def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    words = Words()
    for batch in batches:
        rows = [r for part in pieces(batch.tolist()) for r in sketch_rows(part, words)]
        yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="int64" if k == 0 else object)
                            for k, n in enumerate(("n_shingles", "node", "bands", "bits"))})


def node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in pieces(batch.column(0).to_pylist()):
            sets = [s for s in (shingles(t, words) for t in part) if len(s)]
            if sets:
                nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("i4")
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))], ["node", "items"])


def similar_enough(a: str, b: str, percent: int, rest: bool = False) -> Column:
    """What two sketches rule out: too many differing bits, or too few shingles that either has in common with any node.

    The intersection is at most the lesser ``n_common``, and the union at least both sizes less that. ``rest`` are the shingles
    from the one that made the pair on, in an order common to all nodes: no more can be shared if it is the first one shared.
    """
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    both = F.least(F.col(f"{a}.n_common"), F.col(f"{b}.n_common"))
    if rest:
        both = F.least(both, F.col(f"{a}.rest"), F.col(f"{b}.rest"))
    differ = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(SLOTS // 64)), F.lit(0))
    return (both * 100 >= (n + m - both) * percent) & (differ <= MOST_BITS)


def own_counts(sets: DataFrame) -> DataFrame:
    """(node, n_own): the shingles of a node that no other node has."""
    alone = sets.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return alone.where("n = 1").groupBy("node").agg(F.count("*").alias("n_own"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked by their full sets."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("u_items"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("v_items"))
    both = F.size(F.array_intersect("u_items", "v_items")).cast("long")
    joined = pairs.select("u", "v").join(left, "u").join(right, "v")
    return joined.where(both * 100 >= (F.size("u_items") + F.size("v_items") - both) * percent).select("u", "v")


def with_component(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("part", F.col("node"))
    return (members.join(found.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
            .withColumn("part", F.coalesce("root", "node")).drop("root"))


def pivot_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most one pair (node, pivot) for each node that shares a bucket with another component."""
    fields = ["n_shingles", "n_common", *(f"b{k}" for k in range(SLOTS // 64))]
    # First the node with the least of its own, which the others tend to be copies of; then any.
    own = 1 - F.col("n_common") / F.col("n_shingles") if turn == 0 else F.lit(0.0)
    rank = F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("draw"))
    pivot = members.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "node", "part", *fields)).alias("pivot"), F.min("part").alias("one"),
                                          F.max("part").alias("other"))
    pivot = pivot.where("one != other").select("bucket", "pivot.*")
    pairs = members.alias("m").join(pivot.alias("p"), (F.col("m.bucket") == F.col("p.bucket")) & (F.col("m.part") != F.col("p.part"))
                                    & similar_enough("m", "p", percent))
    return pairs.groupBy(F.col("m.node").alias("u")).agg(F.min(F.struct("p.rank", "p.node")).alias("best")).select("u", F.col("best.node").alias("v"))


def rare_first(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes of mixed buckets, once for each shingle that may be the first they share with a linked node.

    With the shingles of all nodes in one order, linked nodes share one of the first n - ceil(n * percent / 100) + 1. The rarest
    come first, so a copy with many changes has only its changes there and meets only nodes that share one of them.
    """
    mixed = members.groupBy("bucket").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one != other").select("bucket")
    nodes = members.where(F.col("n_common") * 100 >= F.col("n_shingles") * percent).join(mixed, "bucket", "left_semi").drop("bucket").dropDuplicates(["node"])
    nodes = keep(nodes, "unsettled")
    items = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("item", "common_item")
    ordered = items.join(often, F.col("item") == F.col("common_item"), "left").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "item"))).alias("items"))
    first = F.slice("items", 1, F.size("items") - F.ceil(F.size("items") * percent / F.lit(100)).cast("int") + 1)
    places = ordered.select("node", F.size("items").alias("size"), F.posexplode(first).alias("place", "x")).where("x.n > 1")
    places = places.select("node", F.col("x.item").alias("bucket"), (F.col("size") - F.col("place")).cast("long").alias("rest"))
    return keep(places.join(nodes, "node"), "rare-first")


def other_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in a bucket: its smaller components against the whole bucket."""
    parts = members.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts"))
    largest = largest.where("parts > 1").select("bucket", F.col("top.part").alias("main"))
    few = members.join(largest, "bucket").where("part != main")
    pairs = few.alias("m").join(members.alias("p"), (F.col("m.bucket") == F.col("p.bucket")) & (F.col("m.part") != F.col("p.part"))
                                & ((F.col("p.part") == F.col("m.main")) | (F.col("m.node") < F.col("p.node"))) & similar_enough("m", "p", percent, rest=True))
    return pairs.select(F.col("m.node").alias("u"), F.col("p.node").alias("v")).distinct()


def lookup(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A kept table of ids as the side of a join: a broadcast below a counted size, shuffled beyond it."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def mark_of(text: str) -> Column:
    """A digest of the text itself, to find a row again that has no id of its own."""
    return F.unhex(F.md5(F.col(text)))


def grouped(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(key, mark, n_shingles, component_id, stays) for every row; one row of each component stays: the least key's, nulls last."""
    rows = docs.select(F.col(key).alias("key"), mark_of(text).alias("mark"), F.pandas_udf(giving_back(sketch), SKETCH)(F.col(text)).alias("s"))
    rows = keep(rows.select(F.monotonically_increasing_id().alias("row"), "key", "mark", "s.*"), "sketches")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row", "mark")).alias("first"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))
    nodes = keep(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = banded.join(shared, "bucket").join(nodes.select("node", "n_shingles", "bits"), "node")
    members = keep(members.select("bucket", "node", "n_shingles", *(F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(SLOTS // 64))), "members")
    wanted = keep(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first.key", "first.mark"), "wanted")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    some = texts.join(lookup(wanted.where("key is not null").select("key").distinct()), "key", "left_semi").select("text")
    # Without an id, a text is found by its digest, once however many copies it has.
    no_key = texts.where("key is null").select("text", mark_of("text").alias("mark"))
    no_key = no_key.join(lookup(wanted.where("key is null").select("mark").distinct()), "mark", "left_semi").dropDuplicates(["mark"])
    some = some.unionByName(no_key.select("text"))
    sets = keep(some.mapInArrow(giving_back(node_sets), "node binary, items array<long>").dropDuplicates(["node"]), "sets")
    own = own_counts(sets)
    common = (F.col("n_shingles") - F.coalesce("n_own", F.lit(0).cast("long"))).alias("n_common")
    members = keep(members.join(own, "node", "left").select("bucket", "node", "n_shingles", common, *(f"b{k}" for k in range(SLOTS // 64))), "members")
    found = None
    for turn in range(ROUNDS + 1):
        at = keep(with_component(members, found), "at")
        pairs = pivot_pairs(at, turn, percent) if turn < ROUNDS else other_pairs(rare_first(at, sets, percent), percent)
        links = keep(confirmed(pairs, sets, percent), "links")
        if not links.isEmpty():
            found = components(links if found is None else links.union(found))
    roots = nodes.select("node", "first")
    if found is not None:
        roots = with_component(roots, found)
        names = roots.groupBy("part").agg(F.min("first").alias("least"))
        roots = roots.join(names, "part").select("node", "least")
    else:
        roots = roots.withColumnRenamed("first", "least")
    linked = rows.where("n_shingles > 0").join(roots, "node")
    linked = linked.select("key", "mark", "n_shingles", F.col("least.key").alias("component_id"), (F.col("row") == F.col("least.row")).alias("stays"))
    alone = rows.where("n_shingles = 0")
    return linked.unionByName(alone.select("key", "mark", "n_shingles", F.col("key").alias("component_id"), F.lit(True).alias("stays")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, stays) for every row; the component is named by the least key it holds."""
    return grouped(docs, key, text, percent).drop("mark")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row of each component: that of the least key, nulls last."""
    found = grouped(docs, key, text, percent).where("n_shingles > 0")
    found = keep(found.groupBy("key", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "near-duplicates")
    names = [F.col("key").alias("gone_key"), F.col("mark").alias("gone_mark")]
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("row_key"), mark_of(text).alias("row_mark"))
    same = F.col("row_key").eqNullSafe(F.col("gone_key")) & (F.col("row_mark") == F.col("gone_mark"))
    # Neither rows that go nor rows that repeat both id and text; then one of each of the latter.
    out = rows.join(lookup(found.where("not stays or n > 1").select(*names)), same, "left_anti").select("row")
    again = rows.join(lookup(found.where("stays and n > 1").select(*names)), same, "left_semi")
    again = again.groupBy("row_key", "row_mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return out.unionByName(again).select("row.*")
