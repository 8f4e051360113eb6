"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

 1. Texts with the same words in the same order collapse to one node, named by a 128-bit digest of the words.  For
    banding, a node's word 5-grams (the whole text where it has fewer words) are hashed to 64 bits.
 2. ``bands(threshold, recall)`` chooses rows and bands so that a pair at the threshold shares a band with
    the wanted probability.  Nodes are shuffled on band hashes; a bucket is named by its least node (hub),
    and a node keeps each distinct hub once.  Two nodes that share a bucket share its hub.
 3. The members of a hub are dealt into tiles of about ``TILE`` nodes (fewer where they are long) and every pair of tiles
    is one unit of work, so that no hub, however large, is gathered into one task.  A unit gets the words of
    its nodes, numbers their n-grams exactly (no hash decides here) and counts common ones by blocks of a matrix
    product; it never emits its pairs, only each node's number of links and a spanning forest.  A pair that meets
    under several hubs is counted under the least one.
 4. Connected components of the forests' edges give the classes.

``n_links`` is the number of other documents at or above the threshold, copies included; it is counted
by weights and copies are never expanded.  ``n_copies``: documents with the same words in the same order, itself included.

Edge cases: a text without a word (null, empty, blank) is a class of its own without links; class_id is
the least doc_id of the class (null if it has none); repeated rows count as copies; other columns
are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .textkit import U64, Texts, as_bytes, constants, give_back, mix, shingles, slices, stored

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 4
#: Stands for a null doc_id where texts are looked up again.
NO_ID = -(1 << 63)
#: A character of a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"
#: Rows whose keys a task of ``keep_one`` remembers, so that it passes on few copies.
REMEMBER = 200_000
#: Nodes of a tile (up to eight times as many in large hubs); rows of a block of the product; columns of a block.
TILE, BLOCK, WIDE = 256, 256, 8192
#: Most n-grams of a tile, on average.
TILE_GRAMS = 1 << 19


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands such that a pair at the threshold meets in one at least with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted set of hashed n-grams of every text."""
    t = Texts(texts)
    found, bounds = shingles(t.hashes(), t.words, SHINGLE)
    return [np.unique(found[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray], n_bands: int, rows: int = ROWS) -> list[list[int]]:
    """Band hashes of every set (none of an empty set)."""
    out: list[list[int]] = [[] for _ in sets]
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    grams = np.concatenate([sets[i] for i in filled])
    start = np.append(0, np.cumsum([len(sets[i]) for i in filled]))[:-1]
    factor = constants(101, n_bands * rows)
    result = np.empty((len(filled), n_bands), dtype=np.int64)
    for band in range(n_bands):
        total = np.full(len(filled), band + 1, dtype=U64)
        for c in factor[band * rows : (band + 1) * rows]:
            total = mix(total + np.minimum.reduceat(grams * c, start))
        result[:, band] = total.view(np.int64)
    for i, row in zip(filled, result.tolist(), strict=True):
        out[i] = row
    return out


def plain_words(text: bytes | None) -> bytes:
    """The words with a blank between them; bytes.split parts at the same six bytes."""
    return b" ".join((text or b"").split())


def node_name(words: bytes) -> bytes | None:
    return hashlib.blake2b(words, digest_size=16).digest() if words else None


def exact_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of word n-grams of every text, as numbers that are equal for equal n-grams only."""
    t = Texts(texts)
    word = np.append(t.ids() + 1, np.zeros(SHINGLE, dtype=np.int64))  # 0: beyond the end of a short text
    many = int(word.max()) + 1 if len(word) else 1
    count = np.where(t.n_words == 0, 0, np.maximum(t.n_words - SHINGLE + 1, 1))
    bounds = np.append(0, np.cumsum(count))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - t.words[:-1], count)
    stop = np.repeat(t.words[1:], count)
    gram, size = np.zeros(len(at), dtype=np.int64), 1
    for k in range(SHINGLE):
        if size * many >= 1 << 62:
            gram = np.unique(gram, return_inverse=True)[1]
            size = len(gram)
        gram = gram * many + np.where(at + k < stop, word[at + k], 0)
        size *= many
    gram = np.unique(gram, return_inverse=True)[1]
    return [np.unique(gram[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def link_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, member: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left[i], right[j]) of indices into sets that reach the threshold, by blocks; each is a pair of arrays.

    member[i]: the smaller hubs of set i; a block whose pairs all share one is another unit's work.
    """
    grams = np.concatenate([sets[i] for i in range(len(sets))])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.append(True, grams[1:] != grams[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # an n-gram of one set is in no intersection
    owner, column = owner[often], column[often]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    width = int(column.max()) + 1 if len(column) else 0
    size = np.array([len(s) for s in sets], dtype=np.float64)
    by_owner = np.argsort(owner, kind="stable")
    owner, column = owner[by_owner], column[by_owner]
    at = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sets))))

    def block(rows: np.ndarray, low: int, high: int) -> np.ndarray:
        m = np.zeros((len(rows), high - low), dtype=np.float32)
        for k, i in enumerate(rows.tolist()):
            c = column[at[i] : at[i + 1]]
            a, b = np.searchsorted(c, low), np.searchsorted(c, high)
            m[k, c[a:b] - low] = 1
        return m

    out = []
    same = left is right
    for a in range(0, len(left), BLOCK):
        rows = left[a : a + BLOCK]
        for b in range(a if same else 0, len(right), BLOCK):
            others = right[b : b + BLOCK]
            if member.shape[1] and (member[rows] @ member[others].T > 0).all():
                continue
            common = np.zeros((len(rows), len(others)), dtype=np.float64)
            for low in range(0, width, WIDE):
                high = min(width, low + WIDE)
                x = block(rows, low, high)
                y = x if same and a == b else block(others, low, high)
                common += x @ y.T
            hit = common >= threshold * (size[rows][:, None] + size[others][None, :] - common) - 1e-9
            if same and a == b:
                hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
            i, j = np.nonzero(hit)
            out.append((rows[i], others[j]))
    return out


def unit(hub: int, first: bool, names: list[bytes], tile: np.ndarray, copies: np.ndarray, hubs: list[list[int]], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node in this unit, and the index of its root in the unit's forest."""
    n = len(names)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    smaller = [tuple(h for h in sorted(own) if h < hub) for own in hubs]
    known = {h: k for k, h in enumerate(sorted({h for own in smaller for h in own}))}
    member = np.zeros((n, len(known)), dtype=np.float32)
    for i, own in enumerate(smaller):
        member[i, [known[h] for h in own]] = 1
    whole = np.array(sorted(range(n), key=lambda i: smaller[i]))  # alike nodes in the same blocks
    if first:  # a tile with itself
        pairs = link_counts(sets, whole, whole, threshold, member)
    else:
        low = (tile == tile.min())[whole]
        pairs = link_counts(sets, whole[low], whole[~low], threshold, member) if low.any() and not low.all() else []
    for i, j in pairs:
        if not len(i):
            continue
        if known:
            for k in range(0, len(i), 1 << 14):
                a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                mine = (member[a] * member[b]).sum(axis=1) == 0
                np.add.at(links, a[mine], copies[b[mine]])
                np.add.at(links, b[mine], copies[a[mine]])
        else:
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
        while True:  # least reachable index, by hooking and jumping
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
            if (root == before).all():
                break
    while (root[root] != root).any():
        root = root[root]
    return links, root


def _classes(docs: DataFrame, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_grams) of every row of docs, and (node, rep, copies, root, links) of every node."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    n_bands = bands(threshold, recall, rows)

    def sign(batches):
        for b in slices(batches):
            texts = as_bytes(b.column("text"))
            sets = gram_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([node_name(plain_words(t)) for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures(sets, n_bands, rows), pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_grams", "bands"],
            )

    signed = stored(docs.mapInArrow(sign, "doc_id long, node binary, n_grams long, bands array<long>"))
    nodes = stored(
        signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    )
    # a node's short name orders nodes; if two nodes share one, their hubs merge, which only adds work
    short = F.xxhash64("node")
    entries = nodes.select("node", "n_grams", short.alias("short"), F.explode("bands").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("short").alias("hub")).filter("n > 1").select("bucket", "hub")
    members = stored(entries.join(hubs, "bucket").select("hub", "node", "n_grams").distinct())
    own_hubs = members.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # at most one a band
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum("n_grams").alias("grams"))
    # tiles grow with the hub, as every node goes to as many units as there are tiles
    wide = F.greatest(F.lit(TILE), F.least(F.lit(8 * TILE), 4 * F.sqrt("size")))
    tiles = F.ceil(F.greatest(F.col("size") / wide, F.col("grams") / TILE_GRAMS)).cast("int")
    placed = members.join(sizes, "hub").select("hub", "node", tiles.alias("tiles"), F.pmod(F.hash("node"), tiles).alias("tile"))
    units = placed.select(
        "hub", "node", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ).select("hub", "node", "tile", "tiles", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    # words of the nodes in question, again from the texts of their representatives
    wanted = own_hubs.join(nodes.select("node", "rep", "copies"), "node")
    reps = wanted.select(F.coalesce("rep", F.lit(NO_ID)).alias("key")).distinct()
    texts = docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).join(reps, "key", "left_semi")

    def gather_words(batches):
        for b in slices(batches):
            words = [plain_words(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([node_name(w) for w in words], pa.binary()), pa.array(words, pa.binary())], names=["node", "words"])

    sets = texts.select("text").mapInArrow(gather_words, "node binary, words binary").join(wanted.select("node", "copies", "hubs"), "node")
    sets = stored(sets.dropDuplicates(["node"]), "lz4")
    # a hub's units go to partitions in turn, so that a large hub's do not meet in one
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.hash("hub").cast("bigint") + F.col("low") * F.col("tiles") + F.col("high"), F.lit(parts)).cast("int")
    work = units.join(sets, "node").repartitionById(parts, turn).sortWithinPartitions("hub", "low", "high")

    def verify(batches):
        key, held = None, []

        def flush():
            hub, low, high = key
            names = [r[0] for r in held]
            links, root = unit(hub, low == high, names, np.array([r[1] for r in held]), np.array([r[2] for r in held], dtype=np.int64), [r[3] for r in held], exact_sets([r[4] for r in held]), threshold)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(names))))
            return [(names[i], int(links[i]), names[root[i]]) for i in some.tolist()]

        out: list = []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("hub", "low", "high", "node", "tile", "copies", "hubs", "words")]
            for hub, low, high, *row in zip(*columns, strict=True):
                if key != (hub, low, high):
                    if len(held) > 1:
                        out += flush()
                    key, held = (hub, low, high), []
                held.append(row)
            if len(out) > 5000:
                yield _links(out)
                out = []
        if len(held) > 1:
            out += flush()
        held.clear()
        give_back()
        yield _links(out)

    found = stored(work.select("hub", "low", "high", "node", "tile", "copies", "hubs", "words").mapInArrow(verify, "node binary, links long, root binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.select("node", "rep", "copies").join(roots, "node", "left").join(links, "node", "left")
    return signed, classes.select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, n_grams) of every row of docs (doc_id, text)."""
    signed, classes = _classes(docs, threshold, recall, rows)
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = stored(classes.join(least, "root").select("node", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    out = signed.select("doc_id", "node", "n_grams").join(named, "node", "left")
    lone = F.col("node").isNull()
    return out.select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), "n_grams"
    )


def _links(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["node", "links", "root"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: one with the least doc_id, or without an id where none has one.

    Rows are told apart by their node, not by doc_id, which may be null or shared by different texts; of several nodes with the
    least doc_id the least is taken, and of several rows with its words and id the one whose columns have the least hash.  Texts
    without a word are classes of their own and all stay.  The row travels as one struct, so no column's name can clash.
    """
    _, classes = _classes(docs, THRESHOLD, RECALL, ROWS)
    pick = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "node")).alias("p")
    kept = stored(classes.groupBy("root").agg(pick).select("p.node", "p.no_id", F.coalesce("p.rep", F.lit(NO_ID)).alias("key")))
    worded = F.coalesce(F.col("text").rlike(WORD_CHAR), F.lit(False))
    key = F.col("doc_id").cast("bigint")
    keyed = docs.filter(worded).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "text", key.isNull().alias("no_id"), F.coalesce(key, F.lit(NO_ID)).alias("key"))
    keyed = keyed.withColumn("tie", F.xxhash64("row"))

    def name(batches):
        seen: set = set()
        for b in slices(batches):
            nodes = [node_name(plain_words(t)) for t in as_bytes(b.column("text"))]
            fresh = []
            for row in zip(nodes, *(b.column(c).to_pylist() for c in on[1:]), b.column("tie").to_pylist(), strict=True):
                fresh.append(row not in seen)
                seen.add(row)
            columns = [b.column(c) for c in ("row", "no_id", "key", "tie")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nodes, pa.binary())], names=["row", "no_id", "key", "tie", "node"]).filter(pa.array(fresh, pa.bool_()))
            if len(seen) > REMEMBER:
                seen.clear()

    on = ["node", "no_id", "key"]
    fields = [f for f in keyed.schema.fields if f.name != "text"]
    named = keyed.mapInArrow(name, T.StructType([*fields, T.StructField("node", T.BinaryType())]))
    one = named.join(kept, on, "left_semi").groupBy(*on).agg(F.min_by("row", "tie").alias("row"))
    return one.select("row.*").unionByName(docs.filter(~worded))
