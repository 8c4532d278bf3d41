"""Packing of tokenised documents into sequences of bounded length.

Documents are tokenised and cut where they lie; what goes to the driver is the histogram of piece lengths, at most one
row per possible length however many documents there are. On it the driver plans by linear grouping: large lengths are
rounded up within groups of equal cardinality, configurations of the few rounded sizes are optimised as a linear program by
column generation, the real lengths are substituted for the rounded ones, and small lengths go best-fit into what is
left. A plan is a list of runs, (length, first rank, pieces) -> sequences and offset, whose number is bounded by
the number of lengths as well; pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import gc
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, keep, map_batches, slices

#: Tokens of a sequence, groups of large lengths, and the share of a sequence above which a length is large.
CAPACITY, GROUPS, LARGE = 2048, 400, 1 / 3
#: Id put after each document.
END_ID = 0
#: Parts of texts whose ids a worker remembers.
REMEMBER = 250_000
#: Parts and words beyond which a worker keeps fewer between tasks.
RESTING = 100_000
#: Bytes of text that are encoded together.
SLICE = 8_000_000
#: Rounds of column generation; it stops by itself where no configuration improves on those it has.
ROUNDS = 2000
#: Rows of one length that one task ranks, about.
RANKED = 20_000


@cache
def plain_words() -> re.Pattern:
    """How the tokenizer cuts lower-case text below U+0300, where normal forms and letter case are simple (fixed rule)."""
    low = [chr(i) for i in range(0x300)]
    of = lambda kind: "".join(map(re.escape, (c for c in low if unicodedata.category(c)[0] == kind)))
    letter, number, space = of("L"), of("N"), "".join(map(re.escape, "\t\n\v\f\r \x85\xa0"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


class Encoder:
    """Ids of whole texts by a word-level tokenizer file, remembering the parts of texts it has seen.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its parts between spaces and
    line ends, in turn. New parts are cut into the tokenizer's words, and the new words encoded together: each
    word's last token bears the end mark, which tells the words' ids apart. Parts with characters from U+0300 on, or that
    might hold a special token, go to the tokenizer as they are.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw, start = ids.tobytes(), 0
            for w, stop in zip(some, stops, strict=True):
                self.words[w] = raw[start:stop]
                start = stop

    def learn(self, parts: set[str]) -> None:
        plain, cuts, new = plain_words(), [], set()
        for p in parts:
            if p in self.before:
                self.known[p] = self.before[p]
            elif not p:
                self.known[p] = b""
            elif max(p) < "\u0300" and "<|" not in p:
                own = plain.findall(p.lower())
                cuts.append((p, own))
                new.update(w for w in own if w not in self.words)
            else:
                self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        self.learn_words(list(new))
        for p, own in cuts:
            self.known[p] = self.words[own[0]] if len(own) == 1 else b"".join(map(self.words.__getitem__, own))

    def rest(self) -> None:
        """Between tasks only the parts seen last stay, since other workers share the memory."""
        if len(self.known) + len(self.before) + len(self.words) > RESTING:
            self.before, self.words = {}, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, as little-endian unsigned 32 bits, and where each text's begin, with the end at last."""
        if len(self.known) > self.remember:  # the parts seen lately stay at hand
            self.before, self.known = self.known, {}
        if len(self.words) > 2 * self.remember:
            self.words = {}
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        parts, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        collecting = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        self.learn({p for p in parts if p not in self.known})
        if collecting:
            gc.enable()
        ids = [self.known[p] for p in parts]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.concatenate([[0], np.cumsum(length)])
        own = length[of]
        stop = np.concatenate([[0], np.cumsum(own)])
        where = np.repeat(begin[of] - stop[:-1], own) + np.arange(stop[-1])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return np.frombuffer(b"".join(ids), "<u4")[where], stop[bounds]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(
    df: DataFrame, tokenizer: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id", remember: int = REMEMBER, together: int = SLICE
) -> DataFrame:
    """The pieces of each document: its ids and END_ID, cut into lengths of `capacity`, the last one perhaps shorter."""
    last = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(Encoder, tokenizer, remember)
        for part in slices(batches, "text", together):
            ids, piece, start, length, crc = [], [], [], [], []
            tokens, bounds = encode(part.column(1))
            for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                raw = tokens[a:b].tobytes() + last
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        encode.rest()

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, PIECES)


class Runs:
    """Runs of sequences that hold the same lengths: [number of sequences, room left, ((length, copies), ...)], by room."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, defaultdict(list), []

    def add(self, n: int, room: int, items: tuple) -> None:
        if n:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((n, items))

    def place(self, length: int, count: int) -> None:
        """Best fit: the tightest room that holds the length, as many copies as it holds; new sequences after that."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            room = self.rooms[at] if at < len(self.rooms) else self.capacity
            copies = room // length
            if at < len(self.rooms):
                n, items = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.rooms[at]
            else:
                n, items = math.ceil(count / copies), ()
            full = min(n, count // copies)
            self.add(full, room - copies * length, (*items, (length, copies)))
            count -= full * copies
            n -= full
            if n and count:  # fewer than `copies` are left: one more sequence takes them
                self.add(1, room - count * length, (*items, (length, count)))
                n, count = n - 1, 0
            if items:
                self.add(n, room, items)

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        for room in self.rooms:
            yield from self.by_room[room]


def rounded(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Lengths falling, with counts -> groups of equal cardinality, each a list of [length, count]; the first is the size."""
    total = sum(n for _, n in large)
    each, out, room = math.ceil(total / groups), [], 0
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append([length, take])
            n, room = n - take, room - take
    merged: dict[int, list[list[int]]] = {}
    for g in out:  # groups that round up to one size are one
        merged.setdefault(g[0][0], []).extend(g)
    return list(merged.values())


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: a knapsack by number of items, since large sizes allow only a few."""
    most = capacity // int(sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        options = np.full((len(sizes), capacity + 1), -1.0)
        for j, s in enumerate(sizes):
            options[j, s:] = best[: capacity + 1 - s] + value[j]
        pick = options.argmax(axis=0)
        top = options[pick, np.arange(capacity + 1)]
        better = top > best + 1e-12
        picks.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    count, room = np.zeros(len(sizes), int), capacity
    for layer in reversed(picks):
        if layer[room] >= 0:
            count[layer[room]] += 1
            room -= int(sizes[layer[room]])
    return float(value @ count), count


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, for least sequences: simplex with columns generated as needed."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[j] * min(capacity // int(sizes[j]), 1 << 30) for j in range(k)]
    x = np.array([counts[j] / columns[j][j] for j in range(k)], float)
    inverse = np.diag([1.0 / columns[j][j] for j in range(k)])
    for _ in range(ROUNDS):
        price = np.maximum(np.ones(k) @ inverse, 0)
        worth, pattern = best_pattern(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
        columns[out] = pattern
    return [(c, v) for c, v in zip(columns, x) if v > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Histogram of lengths -> runs (number of sequences, ((length, copies), ...))."""
    runs = Runs(capacity)
    rest = sorted(histogram.items(), reverse=True)
    if rest and rest[0][0] == capacity:
        runs.add(rest[0][1], 0, ((capacity, 1),))
        rest = rest[1:]
    large = [(s, n) for s, n in rest if s > capacity * LARGE]
    small = [(s, n) for s, n in rest if s <= capacity * LARGE]
    if large:
        groups = rounded(large, GROUPS)
        sizes, counts = np.array([g[0][0] for g in groups]), np.array([sum(n for _, n in g) for g in groups])
        left = [[list(x) for x in g] for g in groups]
        for pattern, times in sorted(configurations(sizes, counts, capacity), key=lambda c: -(c[0] @ sizes)):
            n = int(times + 1e-9)
            slots = [j for j in np.flatnonzero(pattern) for _ in range(pattern[j])]
            n = min([n, *(sum(c for _, c in left[j]) // pattern[j] for j in set(slots))])
            # Substitution: runs over which the real length in every slot stays the same.
            taken = []
            for j in slots:
                need, own = n, []
                while need:
                    length, c = left[j][0]
                    t = min(need, c)
                    own.append([length, t])
                    need -= t
                    if t == c:
                        left[j].pop(0)
                    else:
                        left[j][0][1] -= t
                taken.append(own)
            while n:
                same = min(own[0][1] for own in taken)
                items = tuple((own[0][0], 1) for own in taken)
                runs.add(same, capacity - sum(s for s, _ in items), items)
                for own in taken:
                    own[0][1] -= same
                    if not own[0][1]:
                        own.pop(0)
                n -= same
        over: dict[int, int] = defaultdict(int)  # what rounding the program's solution down left over
        for g in left:
            for s, c in g:
                over[s] += c
        for s, c in sorted(over.items(), reverse=True):
            if c:
                runs.place(s, c)
    for s, c in small:
        runs.place(s, c)
    return list(runs)


def places(runs: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows (length, first rank, copies side by side, first sequence, offset)."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, items in runs:
        offset = 0
        for length, copies in items:
            rows.append((length, next_rank[length], copies, sequence, offset))
            next_rank[length] += n * copies
            offset += length * copies
        sequence += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "copies", "sequence", "offset"))}


PACKED = PIECES + ", sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece its sequence and its offset there.

    pieces: doc_id, piece, start, length, ids_crc32, stored (they are read twice). Ties in length are settled by id, piece
    and the rest, so a rerun task finds the same places; equal rows are one as good as the other.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    # Rank among the pieces of a length: within salted parts, whose sizes added up give where each part begins.
    salts = max(64, math.ceil(max(histogram.values(), default=0) / RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(inside) - 1).join(begins, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_begin") + F.col("_r")).alias("_rank"))
    order = where["length"] * (1 << 44) + where["rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            t, copies = rank - where["rank"][at], where["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(where["sequence"][at] + t // copies), pa.array(where["offset"][at] + t % copies * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return map_batches(ranked, work, PACKED)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(
    df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id", remember: int = REMEMBER, together: int = SLICE
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of every document.

    A null or empty text is the end id alone. Repeated rows are packed each. Other columns are ignored; an empty table
    gives no sequences. `remember`, parts of texts whose ids a worker keeps at hand,
    and `together`, bytes of text that it encodes at once, change no result.
    """
    return pack(keep(cut(df, tokenizer or tokenizer_path(), capacity, text_col, id_col, remember, together), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))
