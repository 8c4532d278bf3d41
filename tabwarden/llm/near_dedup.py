"""Near-duplicate classes: DartMinHash signatures, banded joining, an exact check of links, connected components.

Signatures (after Christiani, DartMinHash: fast sketching for weighted sets): for each element and unit of weight, darts
fall along the rank axis as a Poisson process drawn from a hash, so the same element gets the same darts in any text; a
dart names a coordinate, and each coordinate keeps its earliest dart. Two texts agree on a coordinate with the
probability of their (weighted) Jaccard similarity.

Equal word sequences are one node. Nodes that share a band meet in a bucket; a bucket is never expanded into its
pairs: its members are compared with a pivot, and where they do not all prove connected, once more within the finer buckets
that two bands make. What a bucket then still holds apart meets by rare shingles that similar texts must share (the prefixes of
set similarity joins), with one member of each such group and, where that leaves roots apart, by blocks in numpy. Links are checked on
whole shingle sets and joined to components by contraction; every step works on tables, keyed by hash, and nothing of the
corpus reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, map_batches, see_package, slices, small_broadcast

#: Words of a shingle and least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands and coordinates of each: a pair at the least similarity shares no band once in 16,000 cases.
BANDS, ROWS = 32, 6
#: Bytes of a row number and of a node in a broadcast table, generously.
ROW_BYTES, NODE_BYTES = 32, 64
#: Bytes of shingles in a block of a bucket that is compared in full, and of a bucket's row, without and with pivots, in a broadcast table.
BLOCK_BYTES, KEY_BYTES, PIVOT_BYTES = 2 << 20, 128, 256
#: Finer buckets in which a member and a pivot have to meet to be compared there: those of four bands. Pairs that meet in fewer are left to `rest`.
MEETINGS = 6
#: Slots in which shingles are counted to tell rare ones.
SLOTS = 1 << 20
#: Elements whose darts are thrown at once.
THROWN = 200_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) signatures of weighted sets, given as parallel arrays of row, element hash and weight.

    Weights are cut into strips of width 1, the last one perhaps narrower: a dart of a strip counts if it falls under the
    element's weight. Rows without elements keep 0 throughout.
    """
    total = np.bincount(row, weights=weight, minlength=rows)
    # As many darts as fill k coordinates mostly; a row with an empty coordinate throws twice as far.
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    out = np.zeros((rows, k), U)
    todo = np.flatnonzero(total > 0)
    strips = np.ceil(weight).astype(np.int64)
    one = np.arange(len(row)) if (strips == 1).all() else np.repeat(np.arange(len(row)), strips)
    strip = np.zeros(len(one), np.int64) if len(one) == len(row) else np.arange(len(one)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = mix(element[one] + U(0x9E3779B97F4A7C15) * (strip.astype(U) + U(1)))
    room = np.minimum(weight[one] - strip, 1.0)
    owner = row[one]
    while len(todo):
        place = np.full(rows, -1)
        place[todo] = np.arange(len(todo))
        live = np.flatnonzero(place[owner] >= 0)
        at, s, far, left = place[owner[live]], seed[live], reach[owner[live]], room[live]
        rank = np.zeros(len(live))
        first = np.full(len(todo) * k, np.inf)
        names = np.zeros(len(todo) * k, U)
        while len(at):
            s = mix(s + U(0x632BE59BD9B4E019))
            rank = rank - np.log((s >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            inside = rank <= far
            at, s, far, left, rank = at[inside], s[inside], far[inside], left[inside], rank[inside]
            dart = mix(s ^ U(0xD6E8FEB86659FD93))
            under = (mix(dart + U(1)) >> U(11)).astype(np.float64) * 2.0**-53 < left if (left < 1).any() else slice(None)
            d, r = dart[under], rank[under]
            slot = at[under] * k + (d % U(k)).astype(np.int64)
            np.minimum.at(first, slot, r)
            won = first[slot] == r
            names[slot[won]] = d[won]
        done = np.isfinite(first.reshape(-1, k)).all(axis=1)
        out[todo[done]] = names.reshape(-1, k)[done]
        todo = todo[~done]
        reach[todo] *= 2
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words (runs without white space), and where each text's begin, with the end at last."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    h = own[coded.indices.to_numpy()]
    size = pc.list_value_length(lists).to_numpy()
    real = h != U(xxhash.xxh3_64_intdigest(""))
    owner = np.repeat(np.arange(len(size)), size)[real]
    return h[real], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; a text of fewer words is one shingle of all."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = np.arange(len(words)) - bounds[:-1][owner]
    size = np.diff(bounds)[owner]
    h = np.zeros(len(words), U)
    for j in range(WORDS):
        nxt = np.zeros(len(words), U)
        nxt[: max(0, len(words) - j)] = words[j:]
        inside = place + j < size
        h = np.where(inside, mix(h * U(31) + nxt + U(j + 1)), h)
    begins = (place + WORDS <= size) | (place == 0)
    row, h = owner[begins], h[begins]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


SIGNED = "doc_id long, node binary, n_shingles int, bands array<long>, shingles binary"


def sign(df: DataFrame, text_col: str, id_col: str, row_col: str | None = None) -> DataFrame:
    """Of each document: its node (a hash of its words, null where it has none), shingles and band keys, and what row_col tells rows apart by."""
    given, kind = ([F.col(row_col).alias("_row")], dict(df.dtypes)[row_col]) if row_col else ([], "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_500_000):
            words, bounds = word_hashes(part.column(1))
            n = part.num_rows
            row, h = shingles(words, bounds)
            stops = np.searchsorted(row, np.arange(n + 1))
            keys = np.zeros((n, BANDS), U)
            begin = 0
            while begin < n:  # a bounded number of elements at a time, or one text
                end = max(begin + 1, int(np.searchsorted(stops, stops[begin] + THROWN, "right")) - 1)
                a, b = stops[begin], stops[end]
                sig = dart_signatures(row[a:b] - begin, h[a:b], np.ones(b - a), end - begin, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                acc = np.zeros((end - begin, BANDS), U) + np.arange(1, BANDS + 1, dtype=U)
                for j in range(ROWS):
                    acc = mix(acc * U(0x9E3779B97F4A7C15) + sig[:, :, j])
                keys[begin:end] = acc
                begin = end
            raw, short = words.astype("<u8").tobytes(), h.astype("<u8")
            nodes = [
                hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(nodes, pa.binary()), pa.array(np.diff(stops).astype(np.int32)),
                pa.array([k if b is not None else None for k, b in zip(keys.view(np.int64), nodes)], pa.list_(pa.int64())),
                pa.array([(short[a:b] & U(0xFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for a, b in zip(stops[:-1], stops[1:])], pa.binary()),
                *part.columns[2:],
            ], ["doc_id", "node", "n_shingles", "bands", "shingles", *part.schema.names[2:]])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *given), work, SIGNED + f", _row {kind}" * len(given))


def unpacked(raw: bytes) -> np.ndarray:
    """Sorted 40-bit shingle hashes."""
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return np.sort(wide.view("<u8").ravel())


def compared(pairs: DataFrame, sets: DataFrame, floor: float) -> DataFrame:
    """(a, b) -> (a, b, similarity): exact Jaccard of the whole shingle sets, or 0 where sizes rule out `floor`."""
    pairs = keep(pairs, "near-stars")
    wanted = keep(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "near-wanted")
    used = sets.join(small_broadcast(wanted, NODE_BYTES), "node", "left_semi")
    # Members first, each in a pair or two; then the pivots, whose many pairs Spark can split.
    both = (
        pairs.join(used.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(used.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sb", "sa")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, U)
        for batch in batches:
            found = []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                x, y = sa.as_buffer(), sb.as_buffer()
                small, large = sorted((x.size, y.size))
                if small < floor * large:
                    found.append(0.0)
                    continue
                if last is None or not last.equals(y):
                    last, pivot = y, unpacked(y)
                own = unpacked(x)
                common = len(own) + len(pivot) - len(np.union1d(own, pivot))
                found.append(common / (len(own) + len(pivot) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return map_batches(both, work, "a binary, b binary, similarity double")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows with the root of each node: itself where it has no link yet."""
    if labels is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def star_pairs(rows: DataFrame, both_ends: bool, meetings: int = 1) -> DataFrame:
    """(key, node, root) -> (a, b): each node of a key with a pivot of it that has another root, if the two meet so at least `meetings` times.

    Pivots are the nodes of least and, with `both_ends`, of greatest (root, node): so a key's pairs are as many as its rows, or
    twice as many, and pivots come from partial aggregates however many rows a key has. They are stored before they meet the
    rows: they go to the rows up to a bound, and beyond it Spark can split what rows of one key come together.
    """
    ends = rows.groupBy("key").agg(F.min(F.struct("root", "node")).alias("low"), F.max(F.struct("root", "node")).alias("high")).filter("low.root <> high.root")
    pivots = F.array("low", "high") if both_ends else F.array("low")
    chosen = small_broadcast(keep(ends.select("key", pivots.alias("pivots")), "near-pivots"), PIVOT_BYTES)
    met = rows.join(chosen, "key").select("node", "root", F.explode("pivots").alias("p")).filter("root <> p.root")
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).groupBy("a", "b").agg(F.count("*").alias("_n")).filter(F.col("_n") >= meetings).select("a", "b")


def links(signed: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the nodes that links of `similarity` or more connect, from two rounds of stars and what they leave apart.

    First the members of each bucket are compared with one of them. Where a bucket's members are then not all connected, its
    members are dealt anew by pairs of such buckets: texts that are similar enough share two bands but once in 1,400 cases, and
    far fewer others do. There each member is compared with one or two that it is not connected with, if it meets them in MEETINGS
    of the finer buckets. Of buckets that are still not connected, `rest` proves every pair of members that can be similar at all,
    whether or not they were compared before.
    """
    # One row stands for a node; rows are told apart by number, so that bands and shingles are not aggregated.
    stands = signed.filter("node is not null").groupBy("node").agg(F.min("_row").alias("_row"))
    stands = keep(stands, "near-stands")
    nodes = signed.select("_row", "node", "bands").join(small_broadcast(stands.select("_row"), ROW_BYTES), "_row", "left_semi")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    open_rows = keep(rows.join(shared, "key", "left_semi").select("key", "node"), "near-open")
    met = keep(stands.join(open_rows.select("node").distinct(), "node", "left_semi").select("_row"), "near-met")
    sets = keep(signed.select("_row", "node", "shingles").join(small_broadcast(met, ROW_BYTES), "_row", "left_semi").select("node", "shingles"), "near-sets")

    first = keep(compared(star_pairs(labelled(open_rows, None), False), sets, similarity), "near-pairs").filter(F.col("similarity") >= similarity)
    labels = components(first)
    rooted = labelled(open_rows, labels)
    apart = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    unclear = keep(rooted.join(apart, "key", "left_semi"), "near-unclear")
    # A node has at most BANDS keys.
    own = unclear.groupBy("node").agg(F.first("root").alias("root"), F.sort_array(F.collect_list("key")).alias("keys"))
    twos = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, BANDS), lambda y: F.xxhash64(x, y))))
    by_two = keep(own.select("node", "root", F.explode(twos).alias("key")), "near-two")
    second = keep(compared(star_pairs(by_two, True, MEETINGS), sets, similarity), "near-pairs").filter(F.col("similarity") >= similarity)
    labels = keep(further(labels, components(at_roots(second, unclear.select("node", "root").distinct()))), "near-labels")
    return further(labels, components(keep(rest(labelled(unclear.select("key", "node"), labels), sets, similarity), "near-rest")))


def at_roots(found: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b) of nodes, each in own(node, root) -> (a, b) of their roots."""
    met = found.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a")
    return met.join(own.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def further(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels(node, root) after their roots, and nodes that have had no link, are merged."""
    moved = labels.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return moved.unionByName(merged.join(labels.select("node"), "node", "left_anti").select("node", "root"))


def elements(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of packed shingle sets, and the sets' sizes."""
    raws = column.to_pylist()
    size = np.array([len(x) // 5 for x in raws], np.int64)
    wide = np.zeros((int(size.sum()), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, 5)
    return np.repeat(np.arange(len(raws)), size), wide.view("<u8").ravel(), size


def similar(left: pa.Table, right: pa.Table | None, similarity: float) -> np.ndarray:
    """(rows of left, rows of right, or of left again without it): whether their Jaccard similarity is `similarity` or more."""
    row_a, h_a, size_a = elements(left["shingles"])
    if right is None:
        row_b, h_b, size_b = row_a, h_a, size_a
        ids, times = np.unique(h_a, return_counts=True)
        ids = ids[times > 1]
    else:
        row_b, h_b, size_b = elements(right["shingles"])
        ids = np.intersect1d(h_a, h_b)

    def placed(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(ids, h)
        good = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == h) if len(ids) else np.zeros(0, np.int64)
        order = good[np.argsort(at[good], kind="stable")]
        return row[order], at[order]

    (row_a, at_a), (row_b, at_b) = placed(row_a, h_a), placed(row_b, h_b)
    common = np.zeros((len(size_a), len(size_b)), np.float32)
    wide = max(256, (4 << 20) // max(len(size_a), len(size_b)))
    for begin in range(0, len(ids), wide):  # a bounded number of columns at a time
        w = min(wide, len(ids) - begin)
        grids = []
        for row, at, n in ((row_a, at_a, len(size_a)), (row_b, at_b, len(size_b))):
            x, y = np.searchsorted(at, [begin, begin + w])
            grid = np.zeros((n, w), np.float32)
            grid[row[x:y], at[x:y] - begin] = 1
            grids.append(grid)
        common += grids[0] @ grids[1].T
    common = common.astype(np.float64)
    return common / np.maximum(size_a[:, None] + size_b[None] - common, 1) >= similarity


def counted(sets: DataFrame) -> np.ndarray:
    """How often shingles fall into each of SLOTS slots: an array of fixed size, whatever the number of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount((mix(elements(pa.chunked_array([batch.column(0)]))[1]) % U(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot])], ["slot", "n"])

    found = map_batches(sets.select("shingles"), work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(left: DataFrame, similarity: float) -> DataFrame:
    """(node, root, shingles) -> (key, node, root, index): the groups in which two texts of `similarity` or more surely meet.

    All sets are sorted by one order, rare slots first. Let |x| <= |y| and the two be similar enough: then they have at least
    2s/(1+s)|x| and s|y| shingles in common, so one of the first |x| - 2s/(1+s)|x| + 1 of x ("index") is among the first
    |y| - s|y| + 1 of y. A key is such a shingle with the power of 1/s that holds |x|; y is at that power or the next one.
    """
    counts = left.sparkSession.sparkContext.broadcast(counted(left))
    step = math.log(1 / similarity) if similarity < 1 else 1.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for part in slices(batches, "shingles", 2_000_000):
            keys, owner, index = [], [], []
            for n, raw in enumerate(part.column(2)):
                x = np.unique(unpacked(raw.as_buffer()))
                x = x[np.lexsort((x, often[(mix(x) % U(SLOTS)).astype(np.int64)]))]
                size = len(x)
                short = size - math.ceil(2 * similarity / (1 + similarity) * size - 1e-9) + 1
                x = x[: size - math.ceil(similarity * size - 1e-9) + 1]
                power = math.floor(math.log(size) / step + 1e-9)
                for p in (power, power - 1):
                    keys.append(mix(x * U(0x9E3779B97F4A7C15) + U(p + 1)))
                    owner.append(np.full(len(x), n))
                    index.append((np.arange(len(x)) < short) & (p == power))
            if keys:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(index))],
                    ["key", "node", "root", "index"],
                )

    return map_batches(left.select("node", "root", "shingles"), work, "key long, node binary, root binary, index boolean")


def rest(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, root) -> (a, b): roots that a link connects, of the nodes whose keys hold several roots.

    Such nodes meet by the rare shingles of theirs that similar texts must share, not in whole buckets. Groups of equal
    members are one. Members meet one of their group first; where roots are then still apart, groups or clusters of them meet in blocks.
    """
    apart = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    left = keep(rows.join(apart, "key", "left_semi").select("node", "root").distinct().join(sets, "node"), "near-apart")
    met = keep(prefixes(left, similarity), "near-prefixes")
    member = [F.bit_xor(F.xxhash64("node", "index", F.lit(i))).alias(f"_m{i}") for i in (0, 1)]
    groups = met.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.max("index").alias("_index"), F.count("*").alias("_n"), *member)
    groups = groups.filter("_low <> _high and _index").groupBy("_m0", "_m1", "_n").agg(F.min("key").alias("key"))
    met = keep(met.join(groups.select("key", "_n"), "key"), "near-grouped")
    stars = keep(compared(star_pairs(met.select("key", "node", "root"), False), left.select("node", "shingles"), similarity), "near-pairs")
    found = stars.filter(F.col("similarity") >= similarity)
    found = keep(at_roots(found, left.select("node", "root")), "near-found")
    # Two members have met; of more, those that are still apart have met their pivot only.
    more = met.filter("_n > 2").drop("_n")
    merged = components(found).withColumnRenamed("node", "_of").withColumnRenamed("root", "_to")
    now = more.join(merged, more["root"] == merged["_of"], "left").select("key", "node", F.coalesce("_to", "root").alias("root"), "index")
    sizes = left.select("node", F.octet_length("shingles").cast("long").alias("size"))
    return found.unionByName(in_blocks(fewest(now, sizes), left.select("node", "shingles"), similarity)).distinct()


def fewest(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, node, root, index) -> the same columns, whose groups let every two members of a group of several roots meet, with fewer bytes.

    Groups that share members are a cluster. A cluster takes the place of its groups, so that a set goes to one place, unless its
    blocks would take more bytes than its groups do.
    """
    apart = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("node").alias("_pivot")).filter("_low <> _high")
    rows = keep(rows.join(apart.select("key", "_pivot"), "key").join(sizes, "node"), "near-several")
    clusters = components(rows.select(F.col("node").alias("a"), F.col("_pivot").alias("b"))).withColumnRenamed("root", "_cluster")
    rows = keep(rows.drop("_pivot").join(clusters, "node"), "near-clustered")
    whole = rows.groupBy("_cluster", "node").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.count("*").alias("_n"))
    whole = keep(whole, "near-whole")
    cost = whole.groupBy("_cluster").agg((F.sum("size") * F.ceil(F.sum("size") / BLOCK_BYTES)).alias("_once"), F.sum(F.col("size") * F.col("_n")).alias("_each"))
    cost = keep(cost.select("_cluster", (F.col("_once") <= F.col("_each")).alias("_whole")), "near-cost")
    together = whole.join(cost.filter("_whole"), "_cluster").select(F.xxhash64("_cluster").alias("key"), "node", "root", F.lit(True).alias("index"))
    return together.unionByName(rows.join(cost.filter("not _whole"), "_cluster").select("key", "node", "root", "index"))


def in_blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, root, index) -> (a, b): roots of members of a key that a link connects, one of them by its index.

    Members are dealt by hash into blocks of bounded bytes, those of the commonest root apart from the others and index rows apart
    from the others; each two blocks that can hold such a link meet in a task. Keys of one block share tasks.
    """
    spark = rows.sparkSession
    apart = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key")
    left = rows.join(apart, "key", "left_semi").join(sets.select("node", F.octet_length("shingles").cast("long").alias("size")), "node")
    left = keep(left, "near-left")
    roots = left.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = roots.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main")).select("key", "main.root")
    main = small_broadcast(keep(main.withColumnRenamed("root", "main"), "near-main"), KEY_BYTES)
    left = left.join(main, "key").withColumn("is_main", F.col("root") == F.col("main"))
    # Kinds in the order of their blocks: index rows of other roots, of the commonest, further rows of other roots, of the commonest.
    kind = F.when(F.col("index"), 0).otherwise(2) + F.col("is_main").cast("int")
    left = keep(left.withColumn("kind", kind).select("key", "node", "root", "size", "kind"), "near-kinds")
    sums = [F.sum(F.when(F.col("kind") == i, F.col("size")).otherwise(0)).alias(f"b{i}") for i in range(4)]
    keys = left.groupBy("key").agg(F.sum("size").alias("bytes"), *sums)
    single = F.col("bytes") <= BLOCK_BYTES
    keys = keep(keys.select("key", single.alias("single"), "bytes", *(F.ceil(F.col(f"b{i}") / BLOCK_BYTES).cast("long").alias(f"n{i}") for i in range(4))), "near-keys")
    bins = 1 + (keys.filter("single").agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES
    dealt = left.join(small_broadcast(keys.drop("bytes"), KEY_BYTES), "key")
    n = [F.col(f"n{i}") for i in range(4)]
    first = [F.lit(0).cast("long"), n[0], n[0] + n[1], n[0] + n[1] + n[2]]
    own = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.element_at(F.array(*n), F.col("kind") + 1)))

    def run(begin: Column, end: Column) -> Column:
        return F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<long>"))

    zero, end = first[0], first[3] + n[3]
    others = (
        F.when(F.col("single"), F.array(zero)).when(F.col("kind") == 0, run(zero, end))
        .when(F.col("kind") == 1, F.concat(run(zero, first[1]), run(first[2], first[3])))
        .when(F.col("kind") == 2, run(zero, first[2])).otherwise(run(zero, first[1]))
    )
    block = F.when(F.col("single"), zero).otherwise(F.element_at(F.array(*first), F.col("kind") + 1) + own)
    dealt = dealt.withColumn("block", block).select("key", "node", "root", "single", "block", F.explode(others).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("key", "node", "root", i.alias("i"), j.alias("j"), (F.col("block") == i).alias("low"), F.when(F.col("single"), F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.xxhash64("key", i, j)).alias("task"))
    full = dealt.join(sets, "node").select("task", "key", "i", "j", "low", "root", "shingles")
    see_package(spark)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("low", "ascending")])
        key, i, j, low = (table[c].to_numpy() for c in ("key", "i", "j", "low"))
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        names = table["root"].combine_chunks().dictionary_encode()
        code, found = names.indices.to_numpy(), set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i[a] == j[a]:
                x = y = code[a:b]
                hit = similar(table.slice(a, b - a), None, similarity)
            else:
                mid = a + int((~low[a:b].astype(bool)).sum())
                if mid in (a, b):
                    continue
                x, y = code[mid:b], code[a:mid]
                hit = similar(table.slice(mid, b - mid), table.slice(a, mid - a), similarity)
            hit &= x[:, None] != y[None]
            r, c = np.nonzero(hit)
            found |= set(zip(np.minimum(x[r], y[c]).tolist(), np.maximum(x[r], y[c]).tolist()))
        at = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({n: names.dictionary.take(pa.array(at[:, k])).cast(pa.binary()) for k, n in enumerate(("a", "b"))})

    return full.groupBy("task").applyInArrow(work, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge: contraction to the least neighbour until no edge is left. An edge is one row, not one for each direction."""

    def once(found: DataFrame) -> DataFrame:
        return keep(found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-edges")

    edges, label = once(edges), None
    while not edges.isEmpty():
        ways = edges.select("a", "b").union(edges.select("b", "a"))
        least = keep(ways.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("to")), "near-least")
        if label is None:
            label = least.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            label = label.join(least, label["root"] == least["a"], "left").select("node", F.coalesce("to", "root").alias("root"))
        label = keep(label, "near-label")
        moved = edges.join(least, "a").select("b", F.col("to").alias("x"))
        moved = moved.join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        # a node and the least neighbour it moved to are joined too
        steps = least.join(least.select(F.col("a").alias("to"), F.col("to").alias("z")), "to").select(F.col("to").alias("a"), F.col("z").alias("b"))
        edges = once(moved.unionByName(steps))
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, row_col: str | None = None) -> DataFrame:
    """doc_id, class_id, class_size, kept, n_shingles and row_col, which tells rows apart and stays as it is, where given; one row per input row.

    A class is what links of similarity `similarity` or more connect; class_id is its least doc_id, and that document
    stays. Texts of equal words are one class at any length; a null text, or one without words, is alone. Repeated
    rows are one class, of which one row stays. Null ids come first. Other columns are ignored.
    """
    signed = sign(df, text_col, id_col, row_col)
    signed = keep(signed if row_col else signed.withColumn("_row", F.monotonically_increasing_id()), "near-signed")
    roots = links(signed, similarity)
    docs = signed.select("doc_id", "_row", "node", "n_shingles")
    placed = docs.join(roots, "node", "left").select("doc_id", "_row", "n_shingles", F.coalesce("root", "node").alias("root"))
    placed = keep(placed, "near-placed")
    classes = placed.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "_row")).alias("_first"), F.count("*").alias("_n"))
    joined = placed.join(classes.filter("_n > 1"), "root", "left")
    alone = F.col("_n").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("class_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("_first._row") == F.col("_row"))).alias("kept"),
        F.col("n_shingles").cast("long").alias("n_shingles"), *([F.col("_row").alias(row_col)] if row_col else []),
    )


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_dedup(table(spark, sf_dir, "documents"))
