"""Language identification: nearest of several clustered centroids per language over TF-IDF n-gram vectors.

Three passes, each linear and parallel over the documents: document frequencies of hashed character n-grams over every
training text; a bounded, hash-chosen sample of training vectors per language, clustered in a task per language; prediction.
Nothing but the D document frequencies, a few centroids per language and a bound per length reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, held, map_batches, slices, small_broadcast

#: Hashed n-gram dimensions and n-gram orders.
D, ORDERS = 4096, (1, 2, 3)
#: Training vectors per language that the clustering sees; document frequencies see every training text.
TRAIN_PER_LANG = 1000
#: Centroids per language and rounds of clustering.
CENTROIDS, ROUNDS = 3, 12
#: Similarity to the nearest centroid rises with the number of different n-grams, so bounds go by its binary logarithm. A text is
#: rejected under this share of the least similarity of training texts that took no part in clustering (one in HELD_BACK).
REJECT_SHARE, HELD_BACK = 0.7, 4
#: Numbers of that kind, how many training texts a bound needs, and by what it falls for each number below those that have them.
LENGTHS, ENOUGH, FALL = 13, 20, 0.75
#: Bytes of a language and its count in a broadcast table, generously.
LANG_BYTES = 128
#: Documents whose vectors are held at once.
ROWS = 256
#: Characters of text whose n-grams are hashed at once: their numbers take some 90 times as many bytes.
SLICE = 250_000
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Code point -> itself for letters, space for others."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    which = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), dtype=np.int64)
    out[which] = which
    return out


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, D) counts of hashed character n-grams of lower-cased letters, all else being one space; and has-letter."""
    known = held(letters)
    codes = [known[np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)] for t in texts]
    has = np.array([bool((c != 32).any()) for c in codes])
    chars = np.concatenate(codes).astype(np.uint64)
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    blank = chars == 32
    once = np.ones(len(chars), bool)
    once[1:] = ~(blank[1:] & blank[:-1])
    once[0] = False
    chars, doc = chars[once], doc[once]
    found = []
    for n in ORDERS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ chars[j : len(chars) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        same = doc[: len(h)] == doc[n - 1 :]
        found.append((doc[: len(h)] * D + (h >> np.uint64(64 - D.bit_length() + 1)).astype(np.int64))[same])
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.bincount(flat, minlength=len(texts) * D).reshape(-1, D), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def small_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, text, SLICE):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    least: np.ndarray  # by length_of(): similarity under which a text is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        counts, has = term_counts(texts)
        if not len(self.langs):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        near = vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
        lang = [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)]
        return lang, np.where(has, score, 0.0).tolist(), ((score < self.least[length_of(counts)]) | ~has).tolist()


def length_of(counts: np.ndarray) -> np.ndarray:
    """Binary logarithm of the number of different n-grams of each row."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(np.int64)


def bounds(length: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The least similarity that is accepted at each length, from held-back texts of these lengths and similarities."""
    out = np.full(LENGTHS, np.nan)
    for i in range(LENGTHS):
        own = near[length == i]
        if len(own) >= ENOUGH:
            out[i] = REJECT_SHARE * own.min()
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.full(LENGTHS, REJECT_SHARE * FALL * near.min() if len(near) else 0.0)
    for i in range(LENGTHS):
        if np.isnan(out[i]):
            longer = known[known > i]
            out[i] = out[longer[0]] * FALL ** (longer[0] - i) if len(longer) else out[known[known < i][-1]]
    return out


def cluster(v: np.ndarray) -> np.ndarray:
    """Spherical k-means, begun at the first vector and then each time at the one farthest from those chosen."""
    start = [0]
    near = v @ v[0]
    while len(start) < min(CENTROIDS, len(v)):
        start.append(int(near.argmin()))
        near = np.maximum(near, v @ v[start[-1]])
    c = v[start]
    for _ in range(ROUNDS):
        of = (v @ c.T).argmax(axis=1)
        c = np.array([v[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(df: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from the rows for which `train` holds and neither text nor language is null. Repeated rows are rows like others."""
    rows = df.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_sum, n = np.zeros(D, np.int64), 0
        for part in small_batches(batches, "text"):
            counts, _ = term_counts(part.column(part.schema.get_field_index("text")).to_pylist())
            df_sum += (counts > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_pydict({"term": pa.array([*range(D), -1], pa.int32()), "n": pa.array([*df_sum.tolist(), n], pa.int64())})

    seen = {r["term"]: r["n"] for r in map_batches(rows.select("text"), frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = seen.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([seen.get(i, 0) for i in range(D)]))).astype(np.float32) + np.float32(1)

    # At most TRAIN_PER_LANG rows of each language, those of the smallest hash; a hash bound thins large ones first.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(1.3 * TRAIN_PER_LANG + 100) / F.col("_n"))
    chosen = (
        rows.withColumn("_h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))).join(small_broadcast(sizes, LANG_BYTES), "lang").filter(F.col("_h") < share * (1 << 30))
        .withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "id", F.xxhash64("text"))))
        .filter(F.col("_r") <= TRAIN_PER_LANG).select("lang", "text")
    )

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "text"):
            counts, has = term_counts(part.column(1).to_pylist())
            v, length = vectors(counts, idf).astype(np.float16), length_of(counts)
            yield pa.RecordBatch.from_arrays([
                part.column(0).filter(pa.array(has)), pa.array([x.tobytes() for x in v[has]], pa.binary()), pa.array(length[has], pa.int32())
            ], ["lang", "v", "length"])

    def clustered(table: pa.Table) -> pa.Table:
        table = table.sort_by([("v", "ascending"), ("length", "ascending")])
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float16).reshape(-1, D).astype(np.float32)
        back = np.arange(len(v)) % HELD_BACK == HELD_BACK - 1
        c = cluster(v[~back])
        return pa.table({
            "lang": [table["lang"][0].as_py()], "centroids": pa.array([c.astype(np.float32).tobytes()], pa.binary()),
            "length": [table["length"].to_numpy()[back].tolist()], "near": [(v[back] @ c.T).max(axis=1, initial=0).astype(np.float64).tolist()],
        }, schema=pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("length", pa.list_(pa.int32())), ("near", pa.list_(pa.float64()))]))

    seen = map_batches(chosen, vectorised, "lang string, v binary, length int").groupBy("lang").applyInArrow(clustered, "lang string, centroids binary, length array<int>, near array<double>")
    found = sorted(seen.collect(), key=lambda r: r["lang"])
    centroids = [np.frombuffer(bytes(r["centroids"]), np.float32).reshape(-1, D) for r in found]
    langs = tuple(r["lang"] for r, c in zip(found, centroids) for _ in c)
    least = bounds(np.array([x for r in found for x in r["length"]], int), np.array([x for r in found for x in r["near"]]))
    return Model(idf, np.concatenate([*centroids, np.zeros((0, D), np.float32)]), langs, least)


def identify(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected; one row per input row, whatever other columns it has.

    A text that is null or has no letter is `und`, score 0, rejected. Texts are read whole. Ties go to the language that
    sorts first. An untrained model rejects all. Null ids and repeated rows are rows like others; an empty table gives an empty
    result. The columns of `carry` follow behind, unchanged.
    """
    carry = carry or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "_text"):
            lang, score, rejected = model.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), *part.columns[2:]],
                ["doc_id", "lang_pred", "score", "rejected", *(f"_c{i}" for i in range(len(carry)))],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = dict(df.dtypes)
    found = map_batches(rows, work, ", ".join(["doc_id long, lang_pred string, score double, rejected boolean", *(f"_c{i} {kinds[c]}" for i, c in enumerate(carry))]))
    return found.select("doc_id", "lang_pred", "score", "rejected", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
