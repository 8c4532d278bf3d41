"""Language-model scoring: a small causal self-attention model over subword ids, trained in numpy, beside a word model.

One pass turns the texts into subword ids, which are stored; the others read the ids, and none shuffles texts. Counting: word
counts by hash and subword counts over every training text, summed by Spark. Training: in each round every task fits its own copy of the model by Adam on
its share of the round's texts, and Spark averages the copies, weighted by what each has read; every training text is read in
exactly one round. Scoring: each text is cut into blocks; a block's queries
look at the block before it and at its own past, so windows of two blocks overlap by one and each token is scored once.

The model predicts the class of the next subword and, within the class, its leaf: nearly all ids in use are leaves of their own; rare
ids share leaves, in which their counts over the corpus decide. The word counts of the base score meet the documents
in two ways: those of the most frequent words, up to a fixed number, are broadcast; the others are joined by hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import rank_in_order
from .common import crc_of_id, held, keep, map_batches, slices

#: Tokens of a block (a window is two blocks), width of the model, ids with an input vector of their own.
BLOCK, WIDTH, INPUTS = 16, 16, 4096
#: Classes of ids, the last being the end of a text, leaves of a class, and how many of these are of one id each.
CLASSES, LEAVES, OWN = 48, 48, 36
#: Rounds of training, over which the training texts are dealt. Blocks of a step, Adam's step size.
ROUNDS, STEP_BLOCKS, RATE = 2, 224, 0.045
#: Of the step size, what is left at the end of the last round; it falls evenly until then.
LAST_PACE = 0.1
#: Ids that a copy is trained on in a round, about, and copies that are averaged at once.
SHARE_TOKENS, FAN = 4_000_000, 16
#: Words whose counts may be broadcast (16 bytes each: 16 MB).
FREQUENT = 1 << 20
#: Words that a worker remembers, characters of text and bytes of ids handled at once.
REMEMBER, SLICE, IDS = 150_000, 2_000_000, 1_000_000
#: Blocks of one batch of masked attention in scoring, rows of a tile, and rows whose logits are held at once.
BATCH, TILE, CHUNK = 256, 32, 1024


class Tokens:
    """Subword ids of texts' words, each word with one space before it; words seen lately are remembered within bounds."""

    def __init__(self, path: str):
        import tiktoken

        from public_tokenizers import PATTERN

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Ids that begin with a space: a word's first id does, and no other.
        self.spaced = np.zeros(len(ranks) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        plain = []
        for w in words:
            if w in self.before:
                self.known[w] = self.before[w]
            elif w and w.isprintable():
                plain.append(w)
            else:  # what white space around a text leaves, and words with characters that might be cut like white space
                self.known[w] = np.array(self.encoding.encode_ordinary(" " + w) if w else [], "<u2").tobytes()
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(some)), "<u2")
            starts = 2 * np.flatnonzero(self.spaced[ids])
            raw = ids.tobytes()
            cuts = map(slice, starts.tolist(), [*starts[1:].tolist(), len(raw)])
            self.known.update(zip(some, map(raw.__getitem__, cuts), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and where each text's begin, with the end at last."""
        if len(self.known) > REMEMBER:
            self.before, self.known = self.known, {}
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.string())))
        coded = lists.flatten().dictionary_encode()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        ids = list(map(self.known.get, words))
        new = [n for n, x in enumerate(ids) if x is None]
        self.learn([words[n] for n in new])
        for n in new:
            ids[n] = self.known[words[n]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        begin = np.concatenate([[0], np.cumsum(size)])
        own = size[of]
        stop = np.concatenate([[0], np.cumsum(own)])
        where = np.repeat(begin[of] - stop[:-1], own) + np.arange(stop[-1])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return np.frombuffer(b"".join(ids), "<u2")[where], stop[bounds]


def tokens_of(path: str) -> Tokens:
    return held(Tokens, path)


def read(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, train, ids): the only pass over the texts; ids are little-endian unsigned 16 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            ids, bounds = tokens_of(path)(part.column(2))
            raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), raw], ["doc_id", "train", "ids"])

    return map_batches(rows, work, "doc_id long, train boolean, ids binary")


def streams(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids in turn, each text's followed by `end`, and where each text's begin, with the end at last."""
    length = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    bounds = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(bounds[-1], end, np.int32)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    out[inside] = flat
    return out, bounds


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(flat: np.ndarray, bounds: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word: a hash of its ids in turn, and a word has just one sequence of ids."""
    first = np.flatnonzero(spaced[flat])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(flat)))
    part = flat[first[0] :].astype(U) + U(1)
    part += (np.arange(len(part)) - np.repeat(first - first[0], length)).astype(U) << U(20)
    part = mix(part * U(0x9E3779B97F4A7C15))
    ends = bounds[1:] - 1 - first[0]
    part[ends[ends >= 0]] = 0
    return np.searchsorted(bounds, first, "right") - 1, mix(np.add.reduceat(part, first - first[0])).view(np.int64)


class Layout:
    """How ids map to input vectors, and to classes and leaves of classes, from their counts over the corpus.

    Ids that begin a word and ids that go on with one are ordered by count apart, and cut into classes of about equal counts; in
    a class the frequent ids are leaves of their own, the rest share leaves of about equal counts, where their counts decide.
    """

    def __init__(self, counts: np.ndarray, spaced: np.ndarray):
        n = len(counts)
        end = n - 1
        order = np.argsort(-counts[:end], kind="stable")
        self.input = np.full(n, 0, np.int32)
        self.input[order[: INPUTS - 3]] = np.arange(3, 3 + min(INPUTS - 3, end))  # 0: rare, 1: padding, 2: what begins a text
        self.input[end] = 2
        smooth = counts + 1.0
        order = np.concatenate([order[spaced[order]], order[~spaced[order]]])
        self.target = np.full(n, (CLASSES - 1) * LEAVES, np.int32)
        of_class = bands(smooth[order], CLASSES - 1)
        for c in range(CLASSES - 1):
            own = order[of_class == c]
            own = own[np.argsort(-counts[own], kind="stable")]
            self.target[own[:OWN]] = c * LEAVES + np.arange(min(OWN, len(own)))
            self.target[own[OWN:]] = c * LEAVES + OWN + bands(smooth[own[OWN:]], LEAVES - OWN)
        leaf = np.bincount(self.target, weights=smooth, minlength=CLASSES * LEAVES)
        self.within = np.log(smooth / leaf[self.target]).astype(np.float32)
        leaf = leaf.reshape(CLASSES, LEAVES)
        total = leaf.sum(axis=1)
        self.bias = np.log(np.maximum(total, 1) / total.sum()).astype(np.float32)
        self.leaf_bias = np.log(np.maximum(leaf, 1e-9) / np.maximum(total, 1)[:, None]).astype(np.float32)

    def blocks(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input symbols (blocks, 2 BLOCK) and targets (blocks, BLOCK), class * LEAVES + leaf, with -1 for padding."""
        length = np.diff(bounds)
        n = -(-length // BLOCK)
        first = np.concatenate([[0], np.cumsum(n)])
        inside = (np.arange(len(ids)) - np.repeat(bounds[:-1], length)).astype(np.int32)
        flat = np.repeat(first[:-1] * BLOCK, length) + inside
        fed = np.full((first[-1] + 1) * BLOCK, 1, np.int32)
        target = np.full(first[-1] * BLOCK, -1, np.int32)
        target[flat] = self.target[ids]
        own = self.input[ids]
        after = np.flatnonzero(inside > 0)
        fed[flat[after]] = own[after - 1]
        fed[flat[bounds[:-1][length > 0]]] = 2
        fed = fed.reshape(-1, BLOCK)
        before = np.arange(first[-1]) - 1
        before[first[:-1][n > 0]] = first[-1]  # the block of padding
        return np.hstack([fed[before], fed[:-1]]), target.reshape(-1, BLOCK)


def bands(weight: np.ndarray, n: int) -> np.ndarray:
    """Of each element the band, 0 to n - 1, in which the middle of its weight lies; bands have about equal weights."""
    mass = np.cumsum(weight)
    return np.minimum((n * (mass - weight / 2) / mass[-1:]).astype(np.int64), n - 1)


#: Added to the scores of a block, by key and query: a query sees the block before it and its own past.
MASK = np.where(np.arange(2 * BLOCK)[:, None] <= BLOCK + np.arange(BLOCK)[None], 0, -1e9).astype(np.float32)
#: Gradients below it count as it: numbers that float32 holds only in part make products many times slower.
TINY = np.float32(1e-15)


def summed(x: np.ndarray) -> np.ndarray:
    """Sums of rows."""
    return x @ np.ones(x.shape[-1], x.dtype)


class Sums:
    """Sums of rows by the number (below 2^16) that each row has."""

    def __init__(self, numbers: np.ndarray):
        self.order = np.argsort(numbers.astype(np.uint16), kind="stable")
        own = numbers[self.order]
        self.cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        #: The numbers that occur, in order.
        self.numbers = own[self.cuts]

    def ranks(self) -> np.ndarray:
        """Of each row the place of its number among those that occur."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.cuts)), np.diff(np.append(self.cuts, len(out))))
        return out

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The sums for `numbers`; as complex numbers two columns are added at a time."""
        pairs = values.take(self.order, axis=0).view(np.result_type(values, np.complex64))
        return np.add.reduceat(pairs, self.cuts, axis=0).view(values.dtype)


class Tiles:
    """Rows that have a target, sorted by its class, in tiles of TILE rows of one class, so that the matrices of all tiles are multiplied at once.

    The first tiles of all classes come first, then the second ones, and so on: tiles of a turn have different classes.
    """

    def __init__(self, of_class: np.ndarray):
        size = np.bincount(of_class[of_class >= 0], minlength=CLASSES)
        self.rows = np.argsort(of_class.astype(np.uint8), kind="stable")[: size.sum()]  # without a target: 255, at the end
        tiles = -(-size // TILE)
        first = np.cumsum(tiles) - tiles
        turn = np.arange(tiles.sum()) - np.repeat(first, tiles)
        order = np.argsort(turn, kind="stable")
        self.of_class, self.turns = np.repeat(np.arange(CLASSES), tiles)[order], np.bincount(turn).tolist()
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        tile, inside = np.divmod(np.arange(len(self.rows)) + np.repeat(first * TILE - (np.cumsum(size) - size), size), TILE)
        self.place = number[tile] * TILE + inside
        #: Of each row its place; of one without a target the place behind all.
        self.where = np.full(len(of_class), len(order) * TILE)
        self.where[self.rows] = self.place

    def dealt(self, rows: np.ndarray) -> np.ndarray:
        """Rows in tiles; empty places get the last one."""
        source = np.full(len(self.of_class) * TILE, len(rows) - 1)
        source[self.place] = self.rows
        return rows.take(source, axis=0).reshape(-1, TILE, rows.shape[1])

    def by_class(self, values: np.ndarray) -> np.ndarray:
        """The sums of matrices, one of each tile, by class."""
        out, at = np.zeros((CLASSES, *values.shape[1:]), values.dtype), 0
        for n in self.turns:
            out[self.of_class[at : at + n]] += values[at : at + n]
            at += n
        return out


def odds(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, exp() of them and its sums over rows; logits with which it would overflow or lose digits are clipped."""
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(logits)
        sums = summed(e)
    if not (sums.max(initial=0) < 1e26 and sums.min(initial=1) > 1e-26):
        e = np.exp(np.clip(logits, -60, 60, out=logits), out=e)
        sums = summed(e)
    return logits, e, sums


def chances(e: np.ndarray, sums: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """From odds and their sums, in place, chances times share."""
    e *= (share / sums)[..., None]
    return e if sums.max(initial=0) < 1e10 else np.maximum(e, TINY, out=e)


class Attention:
    """One causal self-attention layer with a residual path, and its gradient; it gives a class, and within the class a leaf."""

    NAMES = ("embed", "q", "k", "v", "o", "near", "out", "bias", "leaf", "leaf_bias")

    def __init__(self, layout: Layout):
        draw = np.random.default_rng(7)
        d = WIDTH
        self.p = {
            "embed": draw.normal(0, 0.3, (INPUTS, d)), **{n: draw.normal(0, d**-0.5, (d, d)) for n in "qkvo"},
            "near": np.zeros((BLOCK, 2 * BLOCK)), "out": draw.normal(0, 0.05, (d, CLASSES)), "bias": layout.bias,
            "leaf": draw.normal(0, 0.05, (CLASSES, d, LEAVES)), "leaf_bias": layout.leaf_bias,
        }
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Attention:
        """Take parameters from `flat`; from float32 they are views of it."""
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = flat[at : at + size].astype(np.float32, copy=False).reshape(self.p[n].shape)
            at += size
        return self

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        """Matrices that give, of a symbol's input vector, its scaled query and the vector itself, and its key and its value by way of `o`."""
        p = self.p
        return np.hstack([p["q"] * np.float32(WIDTH**-0.5), np.eye(WIDTH, dtype=p["q"].dtype)]), np.hstack([p["k"], p["v"] @ p["o"]])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What maps() gives, for every symbol: it does not depend on where the symbol stands."""
        own, fed = self.maps()
        return self.p["embed"] @ own, self.p["embed"] @ fed

    def attend(self, fed: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Queries, keys and values (block, place, width each), weights (block, key, query), their sums, what they mix, and hidden rows with a 1
        behind each, and a row of 0 at last."""
        own, seen = tables[0].take(fed[:, BLOCK:], axis=0), tables[1].take(fed, axis=0)
        q, k, v = own[:, :, :WIDTH], seen[:, :, :WIDTH], seen[:, :, WIDTH:]
        weight = k @ np.ascontiguousarray(q.transpose(0, 2, 1))
        weight += self.p["near"].T + MASK
        if weight.max(initial=0) > 60:
            np.minimum(weight, 60, out=weight)
        np.exp(weight, out=weight)
        total = (np.ones((1, 2 * BLOCK), weight.dtype) @ weight).reshape(-1, BLOCK, 1)
        mixed = weight.transpose(0, 2, 1) @ v
        mixed /= total
        rows = np.ones((mixed.shape[0] * BLOCK + 1, WIDTH + 1), weight.dtype)
        np.add(own[:, :, WIDTH:].reshape(-1, WIDTH), mixed.reshape(-1, WIDTH), out=rows[:-1, :WIDTH])
        rows[-1] = 0
        return q, k, v, weight, total, mixed, rows

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes, and of each class's leaves, with the biases as their last row."""
        p = self.p
        return np.vstack([p["out"], p["bias"]]), np.concatenate([p["leaf"], p["leaf_bias"][:, None]], axis=1)

    def score(self, fed: np.ndarray, target: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural log-probability of each target; padding gets 0."""
        rows, aim = self.attend(fed, tables)[-1], target.ravel()
        of_class, leaf = np.divmod(aim, LEAVES)  # padding has class -1
        tiles, (top, leaves) = Tiles(of_class), self.heads()
        out = np.empty(len(aim), rows.dtype)
        for a in range(0, len(aim), CHUNK):
            own = of_class[a : a + CHUNK]
            logits, _, sums = odds(rows[a : min(a + CHUNK, len(aim))] @ top)
            out[a : a + CHUNK] = logits[np.arange(len(own)), own] - np.log(sums)
        logits, _, sums = odds(tiles.dealt(rows) @ leaves[tiles.of_class])
        out[tiles.rows] += logits.reshape(-1, LEAVES)[tiles.place, leaf[tiles.rows]] - np.log(sums.ravel()[tiles.place])
        return np.where(aim >= 0, out, 0).reshape(target.shape)

    def gradient(self, fed: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, kind = self.p, self.p["out"].dtype
        seen = Sums(fed.ravel())  # tables are made for the symbols that occur
        vectors, maps, short = p["embed"][seen.numbers], self.maps(), seen.ranks().reshape(fed.shape)
        q, k, v, weight, total, mixed, rows = self.attend(short, tuple(vectors @ m for m in maps))
        of_class, leaf = np.divmod(target.ravel(), LEAVES)
        tiles, (top, leaves) = Tiles(of_class), self.heads()
        share = 1 / max(1, len(tiles.rows))
        own_share = np.where(of_class >= 0, share, 0).astype(kind)
        d_hidden, d_top, back_top = np.empty((len(of_class), WIDTH), kind), np.zeros_like(top), np.ascontiguousarray(p["out"].T)
        for a in range(0, len(of_class), CHUNK):
            some, own = rows[a : min(a + CHUNK, len(of_class))], own_share[a : a + CHUNK]
            d = chances(*odds(some @ top)[1:], own)
            d.reshape(-1)[np.arange(len(own)) * CLASSES + np.maximum(of_class[a : a + CHUNK], 0)] -= own
            d_top += some.T @ d
            np.matmul(d, back_top, out=d_hidden[a : a + CHUNK])
        dealt = tiles.dealt(rows)
        d = chances(*odds(dealt @ leaves[tiles.of_class])[1:], share)
        d.reshape(-1)[tiles.place * LEAVES + leaf[tiles.rows]] -= share
        d_leaves = tiles.by_class(dealt.transpose(0, 2, 1) @ d)
        back = np.zeros((d.shape[0] * TILE + 1, WIDTH), kind)
        np.matmul(d, np.ascontiguousarray(p["leaf"].transpose(0, 2, 1))[tiles.of_class], out=back[:-1].reshape(-1, TILE, WIDTH))
        d_hidden += back.take(tiles.where, axis=0)
        g = {"out": d_top[:WIDTH], "bias": d_top[WIDTH], "leaf": d_leaves[:, :WIDTH], "leaf_bias": d_leaves[:, WIDTH]}

        # Of each symbol as itself the gradient of query and vector, and as one looked at those of key and value.
        as_own, as_seen = np.empty((*mixed.shape[:2], 2 * WIDTH), kind), np.empty((*fed.shape, 2 * WIDTH), kind)
        d_hidden = as_own[:, :, WIDTH:] = d_hidden.reshape(mixed.shape)
        d_mixed = d_hidden / total
        d_score = v @ np.ascontiguousarray(d_mixed.transpose(0, 2, 1))
        mixed *= d_mixed
        d_score -= summed(mixed)[:, None]
        d_score *= weight
        g["near"] = (np.ones(len(fed), kind) @ d_score.reshape(len(fed), -1)).reshape(2 * BLOCK, BLOCK).T
        np.matmul(d_score.transpose(0, 2, 1), k, out=as_own[:, :, :WIDTH])
        np.matmul(d_score, q, out=as_seen[:, :, :WIDTH])
        np.matmul(weight, d_mixed, out=as_seen[:, :, WIDTH:])
        own = Sums(short[:, BLOCK:].ravel())
        as_own, as_seen = own(as_own.reshape(-1, 2 * WIDTH)), seen(as_seen.reshape(-1, 2 * WIDTH))
        d_vectors = as_seen @ maps[1].T
        d_vectors[own.numbers] += as_own @ maps[0].T
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][seen.numbers] = d_vectors
        g["q"] = vectors[own.numbers].T @ as_own[:, :WIDTH] * np.float32(WIDTH**-0.5)
        by_map = vectors.T @ as_seen
        return g | {"k": by_map[:, :WIDTH], "v": by_map[:, WIDTH:] @ p["o"].T, "o": p["v"].T @ by_map[:, WIDTH:]}


class Adam:
    """Steps of a model whose parameters become views of one vector, which is handled in pieces that stay in a core's cache."""

    PIECE = 1 << 13

    def __init__(self, model: Attention):
        self.model, self.t, self.flat = model, 0, model.flat()
        model.load(self.flat)
        #: Sums that fade by 0.9 and 0.98; their means are a tenth and a fiftieth of them.
        self.m, self.s = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, g: dict[str, np.ndarray], pace: float = 1.0) -> None:
        self.t += 1
        g = np.concatenate([g[n].ravel() for n in self.model.NAMES])
        root = (0.02 / (1 - 0.98**self.t)) ** 0.5
        rate, least = np.float32(0.1 * pace * RATE / (1 - 0.9**self.t) / root), np.float32(1e-6 / root)
        for at in range(0, len(g), self.PIECE):
            x, m, s, p = (y[at : at + self.PIECE] for y in (g, self.m, self.s, self.flat))
            m *= np.float32(0.9)
            m += x
            s *= np.float32(0.98)
            x *= x
            s += x
            np.sqrt(s, out=x)
            x += least
            np.divide(m, x, out=x)
            x *= rate
            p -= x
            if self.t % 50 == 0:  # what has faded goes, before float32 holds it only in part
                m[np.abs(m) < 1e-30] = 0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count(learned: DataFrame, path: str) -> DataFrame:
    """(kind, key, n): of training texts, counts of words by hash (kind 0), of subword ids (1), and of texts (2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, docs = tokens_of(path).spaced, 0
        totals = np.zeros(len(spaced), np.int64)
        out = lambda kind, key, n: pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key).cast(pa.int64()), pa.array(n).cast(pa.int64())], ["kind", "key", "n"]
        )
        for part in slices(batches, "ids", IDS):
            flat, bounds = streams(part.column(0), len(spaced) - 1)
            totals += np.bincount(flat, minlength=len(spaced))
            docs += part.num_rows
            words = pc.value_counts(pa.array(word_hashes(flat, bounds, spaced)[1]))
            yield out(0, words.field(0), words.field(1))
        yield out(1, np.flatnonzero(totals), totals[totals > 0])
        yield out(2, np.zeros(1, np.int64), np.array([docs]))

    return map_batches(learned.select("ids"), work, "kind int, key long, n long")


def dealt(learned: DataFrame) -> DataFrame:
    """(ids, rank): training texts in the order of a hash of id and text, numbered from 0, whatever partitions they lie in. Equal rows are split like others."""
    told = learned.select("ids", F.xxhash64("doc_id", "ids", F.lit("lm")).alias("order"), F.monotonically_increasing_id().alias("tie"))
    return rank_in_order(told, [], [F.col("order"), F.col("tie")], "rank").select("ids", (F.col("rank") - 1).alias("rank"))


def train(learned: DataFrame, path: str, layout: Layout, tokens: int, rounds: int = ROUNDS) -> Attention:
    """The model after `rounds` rounds of local training and averaging; every text is read once, in the round that is its rank mod `rounds`.

    In a round texts are dealt by rank into shares of about SHARE_TOKENS ids; each share trains a copy, and copies are averaged by the ids that they
    have seen, up a tree. Shares follow from the texts alone, so the model does not depend on how these are partitioned.
    """
    model, rows = Attention(layout), dealt(learned)
    shares = max(1, round(tokens / (rounds * SHARE_TOKENS)))
    for r in range(rounds):
        start = model.flat()

        def work(share: pa.Table) -> pa.Table:
            end, seen = len(tokens_of(path).spaced) - 1, 0
            own = Attention(layout).load(start)
            adam, number = Adam(own), share["share"][0].as_py()
            size = max(1, pc.sum(pc.binary_length(share["ids"])).as_py() // 2)
            for part in slices(iter(share.sort_by("rank").select(["ids"]).combine_chunks().to_batches()), "ids", IDS):
                fed, target = layout.blocks(*streams(part.column(0), end))
                order = np.random.default_rng(seen).permutation(len(fed))
                for at in range(0, len(order), STEP_BLOCKS):
                    some = order[at : at + STEP_BLOCKS]
                    done = (r + min(1.0, (seen + at * BLOCK) / size)) / rounds
                    adam.step(own.gradient(fed[some], target[some]), 1 - (1 - LAST_PACE) * done)
                seen += int((target >= 0).sum())
            return one_row(number, own.flat().astype(np.float64) * seen, seen)

        chosen = rows.filter(F.col("rank") % rounds == r).select("ids", "rank", (F.floor(F.col("rank") / rounds) % shares).cast("int").alias("share"))
        fitted, left = chosen.groupBy("share").applyInArrow(work, COPIES), shares
        while left > FAN:
            left = -(-left // FAN)
            fitted = fitted.withColumn("share", F.floor(F.col("share") / FAN).cast("int")).groupBy("share").applyInArrow(together, COPIES)
        copies = fitted.toArrow().sort_by("share")  # FAN rows at most
        if copies.num_rows:
            total = together(copies)
            seen = total["seen"][0].as_py()
            if seen:
                model.load(np.frombuffer(total["weights"][0].as_py(), np.float64) / seen)
    return model


COPIES = "share int, weights binary, seen long"


def one_row(share: int, weights: np.ndarray, seen: int) -> pa.Table:
    return pa.table({"share": pa.array([share], pa.int32()), "weights": pa.array([weights.tobytes()], pa.binary()), "seen": pa.array([seen], pa.int64())})


def together(copies: pa.Table) -> pa.Table:
    """The sums of copies that meet, in the order of their shares."""
    copies = copies.sort_by("share")
    total = sum((np.frombuffer(w.as_buffer(), np.float64) for w in copies["weights"]), np.zeros(1))
    return one_row(copies["share"][0].as_py(), total, sum(copies["seen"].to_pylist()))


SCORED = "doc_id long, n_tokens long, usual_n long, usual_log double, score double, hash array<long>, times array<int>"


def score_texts(rows: DataFrame, path: str, layout: Layout, model: Attention, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each text: tokens, what the frequent words add to the base score, the model's score, and its other words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, tables = tokens_of(path).spaced, model.tables()
        usual, logs = frequent[0], np.log10(frequent[1] + 1.0)
        for part in slices(batches, "ids", IDS):
            n = part.num_rows
            flat, bounds = streams(part.column(1), len(spaced) - 1)
            row, own = word_hashes(flat, bounds, spaced)
            coded = pa.array(own).dictionary_encode()
            hashes, of = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(usual, hashes), max(0, len(usual) - 1))
            hit = usual[at] == hashes if len(usual) else np.zeros(len(hashes), bool)
            worth = np.where(hit, logs[at] if len(usual) else 0.0, 0.0)
            known = hit[of]
            rare_key, rare_n = np.unique(row[~known] * max(1, len(hashes)) + of[~known], return_counts=True)
            rare_row, rare_hash = rare_key // max(1, len(hashes)), hashes[rare_key % max(1, len(hashes))]
            cuts = np.searchsorted(rare_row, np.arange(n + 1))

            total = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), weights=layout.within[flat], minlength=n)
            fed, target = layout.blocks(flat, bounds)
            whose = np.repeat(np.arange(n), -(-np.diff(bounds) // BLOCK))
            by_block = np.concatenate([np.zeros(0), *(model.score(fed[b : b + BATCH], target[b : b + BATCH], tables).sum(axis=1) for b in range(0, len(fed), BATCH))])
            total += np.bincount(whose, weights=by_block, minlength=n)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.bincount(row, minlength=n) + 1), pa.array(np.bincount(row[known], minlength=n)),
                pa.array(np.bincount(row, weights=worth[of], minlength=n).astype(np.float64)), pa.array(total / np.log(10)),
                lists(rare_hash, pa.int64()), lists(rare_n, pa.int32()),
            ], ["doc_id", "n_tokens", "usual_n", "usual_log", "score", "hash", "times"])

    return map_batches(rows.select("doc_id", "ids"), work, SCORED)


def lm_score(df: DataFrame, train_on: Column, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    Learns from the rows for which `train_on` holds (an expression over doc_id). Tokens are runs of characters other than
    space and U+0009 to U+000D, with A to Z lower-cased, and one end. base_score: sum of log10((c + 1) / (N + V + 1)); n_known:
    tokens with c > 0. score: the model's log10 probability of the text's subword ids and end. A null text counts as empty:
    its one token is the end. With nothing to learn from, N and V are 0 and the model is as it began. Repeated rows and null
    ids are rows like others (a row for which `train_on` is null is no training row); other columns are ignored.
    """
    path = path or vocabulary_path()
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = keep(read(named.select("doc_id", F.coalesce(train_on, F.lit(False)).alias("train"), "text"), path), "lm-read")
    learned = rows.filter("train")
    counts = keep(count(learned, path).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")

    of_ids = counts.filter("kind = 1").toArrow()
    id_counts = np.zeros(len(tokens_of(path).spaced))
    id_counts[of_ids.column("key").to_numpy()] = of_ids.column("n").to_numpy()
    layout = Layout(id_counts, tokens_of(path).spaced)
    model = train(learned, path, layout, int(id_counts.sum()))

    words = counts.filter("kind = 0").select(F.col("key").alias("hash"), F.col("n").alias("c"))
    by_size = words.groupBy(F.floor(F.log2("c")).alias("size")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    docs = int(id_counts[-1])
    n_train, v_train = sum(r["n"] for r in by_size) + docs, sum(r["v"] for r in by_size) + (docs > 0)
    least, room = 62, FREQUENT
    for r in sorted(by_size, key=lambda r: -r["size"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["size"]
    usual = words.filter(F.col("c") >= (1 << int(least))).toArrow()
    order = np.argsort(usual.column("hash").to_numpy())
    frequent = usual.column("hash").to_numpy()[order], usual.column("c").to_numpy()[order]

    scored = keep(score_texts(rows, path, layout, model, frequent).withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    others = scored.select("_row", F.explode(F.arrays_zip("hash", "times")).alias("w")).select("_row", F.col("w.hash").alias("hash"), F.col("w.times").alias("times"))
    met = others.join(words.filter(F.col("c") < (1 << int(least))), "hash", "left")
    added = met.groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known"),
    )
    end_log, end_known = float(np.log10(docs + 1.0)), int(docs > 0)
    return scored.drop("hash", "times").join(added, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("usual_n") + F.coalesce("known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("usual_log") + F.coalesce("log", F.lit(0.0)) + end_log - F.col("n_tokens") * float(np.log10(n_train + v_train + 1.0))).alias("base_score"),
        "score",
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(id_col) % 7 == 2, F.lit(False))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = lm_score(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
