"""Ranked lexical search by sort-based accumulation, exact whole-number scores.

One pass over the texts cuts them at byte level (words.py) and stores, for each document, its length and how often it has each of the
words that are asked for. From that come the corpus figures. A second pass, over the stored rows only, expands each word of a
document to the items that ask for it: arrays of item, document and impact laid end to end, whose packed keys are sorted by radix and
added up with reduceat. Each task keeps the best of every item; those lists are range-partitioned and selected by heaps.

Items are taken in bands of bounded size, since a task has the words of a band in memory; a band is a pass of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, map_batches, see_package, slices
from .words import cuts, lookup, tallied

#: Documents that an item is answered with.
TOP = 20
#: Bytes of the items' texts in a band.
BAND_BYTES = 8 << 20
#: Triples of item, document and impact that are sorted at once, and documents to which a key has room at least.
TRIPLES = 1 << 20
#: Parts of an impact, of a word's weight, and the share of length in an impact, in hundredths.
SCALE, WEIGHT, LENGTH = 1_000_000_000, 1000, 25

POSTINGS = "doc_id long, n long, term array<int>, tf array<long>"
LISTS = "item int, doc_id long, score long, task int"


@dataclass
class Asked:
    """The items of a band: the number of each word, and for each word which items have it and how often."""

    number: dict[bytes, int]
    begin: np.ndarray
    item: np.ndarray
    times: np.ndarray
    ids: list

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Asked:
        table, number, word, item = lookup(digits=True), {}, [], []
        for cut in cuts(pa.array(texts, pa.large_string()), table):
            for s, e, i in zip(cut.start.tolist(), cut.end.tolist(), cut.text.tolist()):
                word.append(number.setdefault(cut.raw[s:e], len(number)))
                item.append(i)
        keys, times = tallied(np.array(word, np.int64) * max(1, len(ids)) + np.array(item, np.int64))
        return cls(number, np.searchsorted(keys // max(1, len(ids)), np.arange(len(number) + 1)), keys % max(1, len(ids)), times, ids)


def postings(asked):
    """Rows (doc_id, text) into (doc_id, length, asked words, occurrences); a document without any word has no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = lookup(digits=True), asked.value.number
        width = max(1, len(number))
        for part in slices(batches, "text"):
            length, found = np.zeros(part.num_rows, np.int64), []
            for cut in cuts(part.column(1), table):
                length += np.bincount(cut.text, minlength=part.num_rows)
                raw, get = cut.raw, number.get
                word = np.fromiter((get(raw[s:e], -1) for s, e in zip(cut.start.tolist(), cut.end.tolist())), np.int64, len(cut.start))
                hit = word >= 0
                found.append(tallied(cut.text[hit] * width + word[hit]))
            keys, _, tf = tallied(*(np.concatenate([x[j] for x in found] or [np.zeros(0, np.int64)]) for j in (0, 1)))
            there = np.flatnonzero(length)
            begin = np.append(np.searchsorted(keys // width, there), len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(there)), pa.array(length[there]), pa.ListArray.from_arrays(begin, pa.array((keys % width).astype(np.int32))),
                pa.ListArray.from_arrays(begin, pa.array(tf)),
            ], ["doc_id", "n", "term", "tf"])

    return work


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of whole numbers that are not negative: by their 16-bit digits, lowest first, each by numpy's stable sort, which is a radix sort for them."""
    order = np.arange(len(keys))
    top, shift = int(keys.max(initial=0)), 0
    while shift == 0 or top >> shift:
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


def length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L, in Python's own numbers where a product would leave the range of a long."""
    if len(n) and LENGTH * int(n.max()) * docs < 2**63:
        return 100 - LENGTH + (LENGTH * docs * n) // total
    return np.array([100 - LENGTH + LENGTH * int(x) * docs // total for x in n], np.int64)


class Lists:
    """The best documents of each item so far: by score, then smaller doc_id, one without an id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.none = (np.zeros(0, np.int64) for _ in range(4))

    def take(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least[item]
        item, score, doc, none = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
        first = order[place < self.k]
        self.item, self.score, self.doc, self.none = item[place < self.k], score[first], doc[first], none[first]
        full = np.flatnonzero(place == self.k - 1)
        self.least[item[full]] = score[order[full]]


def impacts(asked, weight: np.ndarray, docs: int, total: int, k: int):
    """Postings into the best documents of each item in this task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        q = asked.value
        best, many = Lists(len(q.ids), k), np.diff(q.begin)
        for batch in batches:
            ids, none = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            m = length_part(batch.column(1).to_numpy(), docs, total)
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            impact = weight[term] * ((SCALE * tf) // (WEIGHT * tf + 12 * m[row]))
            # Documents are taken together while their triples are few enough; one with more is taken by itself.
            triples = np.concatenate(([0], np.cumsum(many[term])))[np.concatenate(([0], np.cumsum(size)))]
            at = 0
            while at < len(size):
                until = max(at + 1, int(np.searchsorted(triples, triples[at] + TRIPLES, "right")) - 1)
                p = slice(*np.searchsorted(row, (at, until)))
                of = np.repeat(np.arange(p.start, p.stop), many[term[p]])
                begin = np.cumsum(many[term[p]]) - many[term[p]]
                place = q.begin[term[of]] + np.arange(len(of)) - np.repeat(begin, many[term[p]])
                key = q.item[place] * (until - at) + (row[of] - at)
                order = radix_order(key)
                key, worth = key[order], (impact[of] * q.times[place])[order]
                if len(key):
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    doc = key[first] % (until - at) + at
                    best.take(key[first] // (until - at), np.add.reduceat(worth, first), ids[doc], none[doc])
                at = until
        yield pa.RecordBatch.from_arrays([
            pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.none.astype(bool)), pa.array(best.score, pa.int64()),
            pa.array(np.full(len(best.item), TaskContext.get().partitionId()), pa.int32()),
        ], ["item", "doc_id", "score", "task"])

    return work


def selected(k: int):
    """Rows of lists, those of an item next to each other, into the k best of each item: a heap of k rows at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, item, heap = TaskContext.get().partitionId(), None, []

        def best() -> pa.RecordBatch:
            rows = sorted(heap, reverse=True)
            return pa.RecordBatch.from_pydict({
                "item": pa.array([item] * len(rows), pa.int32()), "doc_id": pa.array([None if x[1] else -x[2] for x in rows], pa.int64()),
                "score": pa.array([x[0] for x in rows], pa.int64()), "task": pa.array([task] * len(rows), pa.int32()),
            })

        for batch in batches:
            for at, doc, score in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != item:
                    if heap:
                        yield best()
                    item, heap = at, []
                row = (score, -1 if doc is None else 0, 0 if doc is None else -doc)
                if len(heap) < k:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)
        if heap:
            yield best()

    return work


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents of the highest scores above 0, ties to the smaller doc_id.

    Words are ASCII letters and digits and all characters beyond ASCII, A-Z in lower case. Whole texts are read. Null texts have no words;
    a document or item without words takes no part. Rows that share a doc_id are documents each; a null doc_id comes last of ties. An item id that
    occurs several times, or is null, asks once, with its least text. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    see_package(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = keep(items.groupBy(F.col(item_col).cast("long").alias("item_id")).agg(F.min(F.col(item_text_col).cast("string")).alias("text")), "search-items")
    bands = max(1, math.ceil((one.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0) / BAND_BYTES))
    found = None
    for band in range(bands):
        mine = one if bands == 1 else one.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(bands)) == band)
        part = searched(spark, given, mine, k)
        found = part if found is None else found.unionByName(part)
    return found


def searched(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The result for a band of items, which is small enough to be in memory."""
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=str)
    asked = Asked.of([r[0] for r in rows], [r[1] for r in rows])
    sent = spark.sparkContext.broadcast(asked)
    kept = keep(map_batches(docs, postings(sent), POSTINGS), "search-postings")
    figures = kept.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    having = np.zeros(len(asked.number), np.int64)
    for r in kept.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each word of the band at most
        having[r["term"]] = r["count"]
    weight = np.floor(WEIGHT * np.log((2.0 * figures["docs"] + 2) / (2.0 * having + 1))).astype(np.int64)
    lists = keep(map_batches(kept, impacts(sent, weight, figures["docs"], figures["total"] or 1, k), LISTS), "search-lists")
    # Rows of an item lie in several ranges, so that an item asked of many tasks is not one task's; then in one.
    some = map_batches(lists.repartitionByRange("item", "task").sortWithinPartitions("item"), selected(k), LISTS)
    best = map_batches(keep(some, "search-best").repartitionByRange("item").sortWithinPartitions("item"), selected(k), LISTS)
    return ranked(best, asked.ids)


def ranked(best: DataFrame, ids: list) -> DataFrame:
    """Rows of lists, the best of an item first, with ranks and the items' ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            items, ranks = batch.column(0).to_pylist(), []
            for item in items:
                last, rank = item, rank + 1 if item == last else 1
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in items], pa.int64()), pa.array(ranks, pa.int32()), batch.column(1), batch.column(2)], ["item_id", "rank", "doc_id", "score"],
            )

    return map_batches(best, work, "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), f AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM f) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t GROUP BY term
), s AS (
  SELECT q.item_id, d.row, d.doc_id,
    sum(q.times * w.weight * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * len(d.words) * f.docs) // f.total))))::BIGINT AS score
  FROM t JOIN w USING (term) JOIN q USING (term) JOIN d ON d.row = t.row, f GROUP BY ALL
), r AS (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
