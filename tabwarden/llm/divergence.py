"""Source divergence audit: how far the words of one source are from those of another, and from their language.

Texts are cut at byte level (words.py) into a count for each language, source and word, which is all that leaves a task. Words in
enough documents of a language are kept, and a group's counts of them become whole-number shares. Cells (language, source, word,
share) are dealt by word into blocks of bounded size; a task has a block as a sparse matrix, sources by words, and adds up the
differences of each two sources over it with reduceat. Only such sums, one for each two sources and block, meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, map_batches, see_package, slices, small_broadcast
from .words import WINDOW, cuts, grouped, lookup, tallied, word_array, words_of

#: Documents of a language that a kept word is in, the parts that shares are counted in, and what is added to a count.
LEAST_DOCS, PARTS, PRIOR = 30, 1_000_000_000, 5
#: The last rank of part `term`.
TOP = 50
#: Sources of a tile, cells of a block at least, and bytes of a row of groups, generously.
TILE, CELLS, GROUP_BYTES = 256, 1 << 14, 400
#: Tasks that the words of one group are ranked in before their first ones meet.
SALTS = 32

COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, i int, o int, value long"


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) into partial counts: occurrences, and documents that have the word. A row with a null term tells that the group occurs."""
    table = lookup(digits=False)
    for part in slices(batches, "text"):
        lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
        wide = max(1, len(source.dictionary))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide + source.indices.to_numpy(zero_copy_only=False)

        def rows(of: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            said = [lang.dictionary.take(pa.array(of // wide)), source.dictionary.take(pa.array(of % wide)), term, pa.array(n), pa.array(docs)]
            return pa.RecordBatch.from_arrays(said, ["lang", "source", "term", "n", "docs"])

        there = np.unique(group)
        none = np.zeros(len(there), np.int64)
        yield rows(there, pa.nulls(len(there), pa.string()), none, none)
        # A slice that takes several windows is one long text: a word that was in an earlier window is in no further document.
        long, seen = len(group) == 1 and part.nbytes > WINDOW, set()
        for cut in cuts(part.column(2), table):
            word, chosen = grouped(cut)
            if not len(word):
                continue
            width = len(chosen)
            both, n = tallied(cut.text * width + word)
            docs = np.ones(len(both), np.int64)
            if long:
                said = words_of(cut, chosen[both % width])
                docs = np.array([w not in seen for w in said], np.int64)
                seen.update(said)
            key, _, n, docs = tallied(group[both // width] * width + both % width, n, docs)
            yield rows(key // width, word_array(cut, chosen[key % width]), n, docs)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + PARTS (count + PRIOR) div (total + PRIOR terms), null where there are no terms.

    A count whose product would leave the range of a long is divided in three steps of a thousand each; totals may be up to 9 x 10^15.
    """
    whole = F.nullif(total + PRIOR * terms, F.lit(0))
    rest, found = count + PRIOR, F.lit(0).cast("long")
    found, rest = F.call_function("div", rest, whole), rest % whole
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + F.call_function("div", rest, whole), rest % whole
    return F.when(count < (2**63 - 1) // PARTS - PRIOR, F.call_function("div", (count + PRIOR) * PARTS, whole)).otherwise(found) + 1


def differences(cells: pa.Table, tile: int) -> pa.Table:
    """Cells (lang, a, b, ix, term, p) of a block and of the sources of tiles a and b, of `tile` sources each, into sums (lang, i, o, value).

    Rows without a term give a source's share of a word that it lacks. value is the sum of |p(i) - p(o)| over the words of the block
    less what it would be if neither source had any of them.
    """
    cells = cells.combine_chunks()
    a, b, lang = cells["a"][0].as_py(), cells["b"][0].as_py(), cells["lang"][0]
    term = cells["term"].combine_chunks()
    bare = term.is_null().to_numpy(zero_copy_only=False)
    ix, p = cells["ix"].to_numpy(), cells["p"].to_numpy()
    sources, at = np.unique(ix[bare], return_index=True)
    without, m = p[bare][at], len(sources)
    word = term.filter(pa.array(~bare)).dictionary_encode()
    t, n = word.indices.to_numpy(zero_copy_only=False), len(word.dictionary)
    c, p = np.searchsorted(sources, ix[~bare]), p[~bare]
    order = np.lexsort((t, c))  # the sparse matrix: a row of words for each source
    c, t, p = c[order], t[order], p[order]
    begin = np.searchsorted(c, np.arange(m + 1))
    full = np.flatnonzero(np.diff(begin))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    others = np.flatnonzero(sources // tile == b)
    for i in np.flatnonzero(sources // tile == a):
        mine = slice(begin[i], begin[i + 1])
        x = np.full(n, without[i])
        x[t[mine]] = p[mine]
        # As if the others had none of the words, then what their words change.
        apart = np.abs(without - without[i])
        value = (n - (begin[i + 1] - begin[i])) * apart - n * apart
        for k in range(begin[i], begin[i + 1], 4096):
            value = value + np.abs(without[:, None] - p[k : min(k + 4096, begin[i + 1])]).sum(axis=1)
        if len(full):
            value[full] += np.add.reduceat(np.abs(p - x[t]) - np.abs(without[c] - x[t]), begin[full])
        o = others[others != i]
        out.append((np.full(len(o), sources[i]), sources[o], value[o]))
        if a != b:
            out.append((sources[o], np.full(len(o), sources[i]), value[o]))
    i, o, value = (np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3))
    return pa.table({"lang": pa.array([lang.as_py()] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "o": pa.array(o, pa.int32()), "value": pa.array(value, pa.int64())})


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occur.

    Words are letters and characters beyond ASCII, A-Z in lower case; a language keeps those in at least `least_docs` of its documents.
    Part `pair`: each other source of the language and the sum of the differences of shares over the kept words (0 without kept words),
    all of them. Part `term`: the `top` words whose share is furthest above the language's.

    Null text, lang and source are empty ones; every row counts, repeated ones too; other columns are ignored; whole texts are
    read, long ones by windows. Ties go to the item that is less by its bytes. An empty table gives an empty result.
    """
    see_package(df.sparkSession)
    given = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = map_batches(given, word_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = keep(counted, "divergence-counts")

    of = Window.partitionBy("lang", "term")
    every = counts.filter("term is not null").select(
        "lang", "source", "term", "n", F.sum("docs").over(of).alias("df"), F.sum("n").over(of).alias("total"), F.row_number().over(of.orderBy("source")).alias("at"),
    )
    kept = keep(every.filter(F.col("df") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("at") == 1).cast("long").alias("first")), "divergence-kept")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("all"), F.count("*").alias("cells"))
    places = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    there = counts.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", zero("size"), zero("terms"), zero("all"), zero("cells"),
        (F.row_number().over(places.orderBy("source")) - 1).cast("int").alias("ix"), F.count("*").over(places).alias("sources"),
    )
    # A block has at least as many cells as it gives sums, four times over.
    wide = F.least("sources", F.lit(TILE))
    groups = keep(there.select(
        "lang", "source", "ix", "size", "terms", "all", share(F.lit(0).cast("long"), F.col("size"), F.col("terms")).alias("without"),
        F.floor(F.col("ix") / TILE).cast("int").alias("tile"), F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.col("cells") / F.greatest(F.lit(CELLS), 4 * wide * wide))).cast("int").alias("blocks"),
    ), "divergence-groups")
    small = small_broadcast(groups, GROUP_BYTES)
    cells = kept.join(small, ["lang", "source"]).select(
        "lang", "source", "ix", "tile", "tiles", "blocks", "term", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("all"), F.col("terms")).alias("q"),
    )
    return pairs(cells, groups, small).unionByName(terms(cells, top))


def pairs(cells: DataFrame, groups: DataFrame, small: DataFrame) -> DataFrame:
    """Part `pair`. Every two sources of a language are a result row, so each two tiles of sources meet in each block of words."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    ends = [F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")]
    said = cells.select("lang", "ix", "tile", other, F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "term", "p")
    lacking = groups.select("lang", "ix", "tile", other, "blocks", "without").select(
        "lang", "ix", "tile", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.coalesce("without", F.lit(0)).alias("p"),
    )
    dealt = said.unionByName(lacking).select("lang", *ends, "block", "ix", "term", "p")
    tile = TILE  # as the driver has it
    sums = dealt.groupBy("lang", "a", "b", "block").applyInArrow(lambda block: differences(block, tile), SUMS).groupBy("lang", "i", "o").agg(F.sum("value").alias("value"))
    mine = small.select("lang", F.col("ix").alias("i"), "source", "terms", F.col("without").alias("_mine"))
    theirs = small.select("lang", F.col("ix").alias("o"), F.col("source").alias("item"), F.col("without").alias("_theirs"))
    value = F.coalesce(F.col("terms") * F.abs(F.col("_mine") - F.col("_theirs")) + F.col("value"), F.lit(0).cast("long"))
    found = sums.join(mine, ["lang", "i"]).join(theirs, ["lang", "o"]).select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order).cast("int"))


def terms(cells: DataFrame, top: int) -> DataFrame:
    """Part `term`: ranked in parts of a group first, so that a source with very many words is not one task's."""
    above = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    order = [F.col("value").desc(), F.col("item")]
    some = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int")).filter(F.col("rank") <= top)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, kept.term, kept.total, count(w.doc) AS n FROM g JOIN kept ON kept.lang = g.lang
  LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = kept.term GROUP BY g.lang, g.source, kept.term, kept.total
), s AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::HUGEINT * (total + 5)) // (sum(total) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM c
), pair AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(v.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
  ON v.lang = x.lang AND v.source = x.source AND v.item = y.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
