"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch of texts are laid end to end and indexed by a suffix array; a binary search gives for every piece
of the vocabulary the range of suffixes that begin with it; the resulting edges (start, end, piece) are sorted by position
and relaxed from left to right. For a unigram model relaxing would keep the best score; the vocabulary here is of the
merging kind, whose encoding of a text is the one chain of edges in which each two neighbours are what merging makes of
their joined text. So each prefix of a word has exactly one last piece, and an edge is taken if it suits the last piece of
the prefix at its start. Which pairs suit each other is worked out once per pair and remembered.

No piece of the vocabulary holds a space mark after another character, so a text's encoding is that of its words, each with
the spaces before it; words already seen are remembered within bounds. All of it happens where the rows lie.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_batches, slices

#: Fixed values of the format: the mark that stands for a space, and what an unknown id decodes to.
SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Words and pairs of pieces that a worker remembers.
REMEMBER, PAIRS = 600_000, 2_000_000
#: Characters of new words indexed at once; a longer word is indexed alone.
INDEXED = 400_000
#: Characters of text encoded at once.
SLICE = 8_000_000
#: Edges' names: one character's code is added to CHAR; BEGIN stands before a word.
CHAR, BEGIN = 1 << 21, 1 << 23
#: Characters of words that are relaxed together, and a table of no pairs.
TOGETHER, NO_PAIRS = 48, np.array([-1])
#: Put between words before they are split; texts that hold it take a slower way.
CUT = "\x1e"


class Vocabulary:
    """Pieces of a model file of the merging kind with byte fallback and a space put before each text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if i not in special}
        self.id = {p: i for i, p in enumerate(self.pieces) if i not in special}
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in special:
            raw[i] = b""
        raw[self.unknown] = UNKNOWN_TEXT.encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_begin = np.concatenate([[0], np.cumsum(self.raw_size)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.byte.values())] = True

    def merge(self, symbols: list[str], wall: int = -1) -> bool:
        """Merge neighbours, best score first and then leftmost, until none is a piece; false as soon as the symbols on both sides of `wall` merge.

        wall: characters before it; -1 for none.
        """
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if wall >= 0 and sum(map(len, symbols[: at + 1])) == wall:
                return False
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return True

    def solid(self, piece: str) -> bool:
        """Whether a piece is the encoding of its own text."""
        own = list(piece)
        self.merge(own)
        return len(own) == 1

    def suits(self, left: str, right: str) -> bool:
        """Whether two pieces, each solid, stay apart where their texts meet."""
        return left + right not in self.score and self.merge(list(left + right), len(left))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` codes (ties by position), by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty_like(rank)
        rank[order] = fresh
        if fresh[-1] == len(rank) - 1:
            break
        h *= 2
    return order


class Matcher:
    """All occurrences of the pieces of two or more characters in a text, through its suffix array."""

    def __init__(self, pieces: list[str]):
        self.depth = max(map(len, pieces), default=1)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.codes = np.zeros((len(pieces), self.depth), np.int64)
        for i, p in enumerate(pieces):
            self.codes[i, : len(p)] = [ord(ch) + 1 for ch in p]

    def ranges(self, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, low, high): the pieces that occur and their ranges of `order`, by binary search for all at once."""
        padded = np.concatenate([codes, np.zeros(self.depth, codes.dtype)])
        first = codes[order]
        live = np.arange(len(self.size))
        low = np.searchsorted(first, self.codes[:, 0], "left")
        high = np.searchsorted(first, self.codes[:, 0], "right")
        done = []
        for k in range(1, self.depth + 1):
            some = high > low
            live, low, high = live[some], low[some], high[some]
            ended = self.size[live] == k
            done.append((live[ended], low[ended], high[ended]))
            live, low, high = live[~ended], low[~ended], high[~ended]
            if not len(live):
                break
            want = self.codes[live, k]
            bounds = []
            for upper in (False, True):
                a, b = low.copy(), high.copy()
                for _ in range(int((b - a).max()).bit_length()):
                    mid = (a + b) >> 1
                    seen = padded[order[np.minimum(mid, len(order) - 1)] + k]
                    right = (mid < b) & ((seen <= want) if upper else (seen < want))
                    a, b = np.where(right, mid + 1, a), np.where(right | (a >= b), b, mid)
                bounds.append(a)
            low, high = bounds
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence, sorted by start and then by length."""
        order = suffix_array(codes, self.depth)
        piece, low, high = self.ranges(codes, order)
        n = high - low
        piece = np.repeat(piece, n)
        start = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else low, n) + np.arange(n.sum())]
        by = np.lexsort((self.size[piece], start))
        return start[by], piece[by]


class Codec:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.long = [p for p in v.score if len(p) > 1 and v.solid(p)]
        self.matcher = Matcher(self.long)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.long_ids = [np.array([v.id[p]], "<u4").tobytes() for p in self.long]
        self.chars: dict[int, bytes] = {}
        self.pair, self.pair_fits = NO_PAIRS, np.zeros(1, bool)

    def char_ids(self, code: int) -> bytes:
        """Ids of one character: its own piece, or else its bytes."""
        v, ch = self.vocabulary, chr(code)
        i = v.id.get(ch)
        own = [i] if i is not None else [v.byte.get(b, v.unknown) for b in ch.encode("utf-8", "replace")]
        return np.array(own, "<u4").tobytes()

    def text_of(self, edge: int) -> str:
        return self.long[edge] if edge < CHAR else chr(edge - CHAR)

    def index(self, words: list[str]) -> None:
        """Encode new words together. An edge is named by its piece's number, or by CHAR and the code of its one character."""
        if not words:
            return
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(len(text)) + np.repeat(np.arange(len(words)), sizes)
        codes = np.zeros(len(text) + len(words), np.int64)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[place] = chars + 1
        start, piece = self.matcher.edges(codes)
        start, end = np.concatenate([place, start]), np.concatenate([place + 1, start + self.matcher.size[piece]])
        named = np.concatenate([CHAR + chars, piece])
        begins = np.cumsum(sizes + 1) - sizes - 1
        last, came = self.relax(start, end, named, start - begins[np.searchsorted(begins, start, "right") - 1], begins, len(codes) + 1)
        begins = begins.tolist()
        long_ids, char_ids = self.long_ids, self.chars
        for word, b, n in zip(words, begins, sizes.tolist()):
            chain, e = [], b + n
            while e > b:
                k = last[e]
                if k < CHAR:
                    chain.append(long_ids[k])
                else:
                    own = char_ids.get(k)
                    if own is None:
                        own = char_ids[k] = self.char_ids(k - CHAR)
                    chain.append(own)
                e = came[e]
            chain.reverse()
            self.known[word] = b"".join(chain)

    def relax(
        self, start: np.ndarray, end: np.ndarray, named: np.ndarray, inside: np.ndarray, begins: np.ndarray, n: int
    ) -> tuple[list[int], list[int]]:
        """For each position the last edge of the encoding of its word up to there, and where that edge starts.

        All words take a step at a time, by the edges' places inside them; what is left of long words goes edge by edge.
        """
        last, came = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        last[begins] = BEGIN
        by = np.argsort(inside, kind="stable")
        cuts = np.searchsorted(inside[by], np.arange(min(TOGETHER, int(inside.max(initial=0)) + 1) + 1))
        for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            some = by[a:b]
            some = some[last[end[some]] < 0]
            if p:
                some = some[self.fit(last[start[some]], named[some])]
            last[end[some]] = named[some]
            came[end[some]] = start[some]
        tail = by[cuts[-1] :]
        last, came = last.tolist(), came.tolist()
        if len(tail):
            tail = tail[np.argsort(start[tail], kind="stable")]
            known: dict[tuple[int, int], bool] = {}
            for s, e, k in zip(start[tail].tolist(), end[tail].tolist(), named[tail].tolist()):
                if last[e] < 0:
                    fits = known.get((last[s], k))
                    if fits is None:
                        fits = known[last[s], k] = bool(self.fit(np.array([last[s]]), np.array([k]))[0])
                    if fits:
                        last[e], came[e] = k, s
        return last, came

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of edges suits each other: looked up among the pairs known, new ones worked out."""
        key = left * (1 << 22) + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        new = np.unique(key[self.pair[at] != key])
        if len(new):
            if len(self.pair) > PAIRS:
                self.pair, self.pair_fits = NO_PAIRS, np.zeros(1, bool)
                new = np.unique(key)
            text_of, suits = self.text_of, self.vocabulary.suits
            fits = np.array([suits(text_of(k >> 22), text_of(k & ((1 << 22) - 1))) for k in new.tolist()], bool)
            place = np.searchsorted(self.pair, new)
            self.pair, self.pair_fits = np.insert(self.pair, place, new), np.insert(self.pair_fits, place, fits)
            at = np.searchsorted(self.pair, key)
        return self.pair_fits[at]

    def learn(self, words: list[str]) -> None:
        some, size = [], 0
        for w in words:
            if w in self.before:
                self.known[w] = self.before[w]
                continue
            if size and size + len(w) > INDEXED:
                self.index(some)
                some, size = [], 0
            some.append(w)
            size += len(w) + 1
        self.index(some)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn and where each text's begin, with the end at last."""
        if len(self.known) > REMEMBER:
            self.before, self.known = self.known, {}
        plain = pc.replace_substring(texts.fill_null("").cast(pa.string()), SPACE, " ")
        if pc.any(pc.match_substring(plain, CUT)).as_py():
            lists = pa.array([re.findall(" +[^ ]*|[^ ]+", " " + t) if t else [] for t in plain.to_pylist()], pa.list_(pa.string()))
        else:
            spaced = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
            lists = pc.split_pattern(pc.replace_substring_regex(spaced, "([^ ]) ", r"\1" + CUT + " "), CUT)
        coded = lists.flatten().dictionary_encode()
        words = [w.replace(" ", SPACE) for w in coded.dictionary.to_pylist()]
        self.learn([w for w in words if w not in self.known])
        ids = [self.known[w] for w in words]
        of = coded.indices.to_numpy(zero_copy_only=False)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.concatenate([[0], np.cumsum(length)])
        own = length[of]
        stop = np.concatenate([[0], np.cumsum(own)])
        where = np.repeat(begin[of] - stop[:-1], own) + np.arange(stop[-1])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return np.frombuffer(b"".join(ids), "<u4")[where], stop[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids cut at `bounds`; ids outside the vocabulary decode like the unknown id."""
        v = self.vocabulary
        ids = ids.astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(v.pieces)), ids, v.unknown)
        n = v.raw_size[ids]
        stop = np.concatenate([[0], np.cumsum(n)])
        raw = v.raw[np.repeat(v.raw_begin[ids] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        out = []
        for a, b in zip(stop[bounds[:-1]].tolist(), stop[bounds[1:]].tolist()):
            try:
                text = raw[a:b].decode()
            except UnicodeDecodeError:
                text = mended(raw[a:b])
            out.append(text[1:] if text[:1] == " " else text)
        return out


def mended(raw: bytes) -> str:
    """Text of bytes of which some are no UTF-8: each such byte is U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def codec(path: str) -> Codec:
    return held(Codec, path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>): the encoding of each whole text, one row per input row.

    A null or empty text has no ids. Repeated rows and null ids are rows like others; other columns are ignored, an
    empty table gives an empty result.
    """
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            ids, bounds = codec(path).encode(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"]
            )

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text of each list of ids, one row per input row. Null ids, and null lists, count as unknown and empty."""
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec(path).decode(flat, bounds), pa.string())], ["doc_id", "text"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), work, "doc_id long, text string")


DIGESTS = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_crc32 long, restored boolean"


def round_trip(df: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each text encoded and decoded again where it lies: counts and digests, and whether decoding restored it.

    ids_crc32 is of the ids as little-endian unsigned 32 bits, decoded_crc32 of the decoded text in UTF-8. A text with the
    space mark itself decodes to spaces there and counts as restored.
    """
    path = path or model_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            own = codec(path)
            ids, bounds = own.encode(part.column(1))
            fell = np.concatenate([[0], np.cumsum(own.vocabulary.is_byte[ids])])
            back = own.decode(ids, bounds)
            texts = [(t or "").replace(SPACE, " ") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(bounds)), pa.array(fell[bounds[1:]] - fell[bounds[:-1]]),
                pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64()),
                pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([t == u for t, u in zip(texts, back)]),
            ], ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_crc32", "restored"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, DIGESTS)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return round_trip(table(spark, sf_dir, "documents"))
