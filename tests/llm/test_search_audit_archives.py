"""Ranked search, source audit and archives against brute force, on tables with nulls, empty and long texts, ties, repeats and odd columns."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabwarden.llm import divergence, lexical, warc, words
from tabwarden.llm.common import see_package

DRAW = random.Random(8)
KNOWN = ["".join(DRAW.choice("abcdefgé7") for _ in range(DRAW.randint(1, 7))) for _ in range(120)]
LETTERS, LETTERS_AND_DIGITS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(n):
    return " ".join(DRAW.choice(KNOWN) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    see_package(spark)
    texts = [None, "", "  \n\t", "İ ﬁ ÀÉ straße 日本語🙂x 12a_B-c", "a" * 3000, "x\x00y\x7fz", prose(4000), "A.b,C", "a", "a", *[prose(DRAW.randint(1, 120)) for _ in range(60)]]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None, 7, "k") for i, t in enumerate(texts)]
    rows += [rows[20], (None, "a b c", "en", "s1", 7, "k"), (900, prose(30), "xx", "alone", 7, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, term string").cache()


@pytest.mark.parametrize("window", [40, 4 << 20])
@pytest.mark.parametrize("digits", [False, True])
def test_words_are_those_of_the_pattern(docs, window, digits):
    """Whatever the windows, also within a slice of a larger array, words are cut as the pattern cuts them."""
    texts = [r["text"] for r in docs.select("text").collect()]
    for part, given in ((pa.array(texts, pa.string()), texts), (pa.array([None, "no", *texts], pa.large_string()).slice(2), texts)):
        got = [[] for _ in texts]
        for cut in words.cuts(part, words.lookup(digits), window):
            for s, e, t in zip(cut.start, cut.end, cut.text):
                got[t].append(cut.raw[s:e].decode())
        assert got == [re.findall(LETTERS_AND_DIGITS if digits else LETTERS, low(t)) for t in given]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Where the hash says little, the bytes decide."""
    monkeypatch.setattr(words.xxhash, "xxh3_64_intdigest", lambda w: len(w) % 2)
    said = "to be or not to be that is the question whether nobler questiom whetherwhetherx whetherwhethery to".split()
    cut = next(words.cuts(pa.array([" ".join(said)]), words.lookup(False)))
    group, chosen = words.grouped(cut)
    assert [words.words_of(cut, chosen[[g]])[0].decode() for g in group] == said
    assert len(set(group.tolist())) == len(set(said))


def plain_search(rows, items, k):
    count = [(i, Counter(re.findall(LETTERS_AND_DIGITS, low(t)))) for i, t in rows]
    count = [(i, c) for i, c in count if c]
    n, total = len(count), sum(sum(c.values()) for _, c in count)
    df = Counter(w for _, c in count for w in c)
    out = []
    for item, text in items.items():
        asked = Counter(re.findall(LETTERS_AND_DIGITS, low(text)))
        found = []
        for i, c in count:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("band, triples", [(None, None), (150, 50)])
def test_search_against_brute_force(spark, docs, monkeypatch, band, triples):
    """In one band and in many, with few triples at a time: all documents, exact scores, ties by id."""
    if band:
        monkeypatch.setattr(lexical, "BAND_BYTES", band)
    items = {1: prose(9), 2: "a A a", 3: None, 4: "nothing-like-it", 5: " ".join(KNOWN), None: "b c", 7: "12a B"}
    table = spark.createDataFrame([(i, t, 3) for i, t in items.items()] + [(1, "zz " + items[1], 3)], "item_id long, text string, rank int")
    got = lexical.lexical_search(docs, table, 5)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], items | {1: min(items[1], "zz " + items[1])}, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert lexical.lexical_search(docs.filter("doc_id = -1"), table).count() == 0 and lexical.lexical_search(docs, table.filter("item_id = -1")).count() == 0


def test_parts_of_the_search():
    keys = np.array([DRAW.randrange(1 << 40) for _ in range(500)] + [5, 5, 0])
    assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all()
    n = np.array([1, 2**40], np.int64)
    assert lexical.length_part(n, 10**11, 10**13).tolist() == [75 + 25 * int(x) * 10**11 // 10**13 for x in n]
    best = lexical.Lists(2, 2)
    for scores in ([5, 9], [9, 1], [9, 7]):
        best.take(np.array([0, 1]), np.array(scores), np.array([scores[0], scores[1]]), np.zeros(2, np.int64))
    assert best.item.tolist() == [0, 0, 1, 1] and best.score.tolist() == [9, 9, 9, 7]


def plain_audit(rows, least, top):
    texts = [(r["lang"] or "", r["source"] or "", Counter(re.findall(LETTERS, low(r["text"])))) for r in rows]
    groups, out = {(a, b) for a, b, _ in texts}, []
    for lang in {a for a, _, _ in texts}:
        df = Counter(w for a, _, c in texts if a == lang for w in c)
        kept = [w for w in df if df[w] >= least]
        count = {s: Counter() for a, s in groups if a == lang}
        for a, s, c in texts:
            if a == lang:
                count[s].update({w: c[w] for w in kept})
        whole = sum(count.values(), Counter())
        p = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        shares, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = sorted((-sum(abs(shares[s][w] - shares[o][w]) for w in kept), o.encode(), o) for o in count if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            over = sorted((q[w] - shares[s][w], w.encode(), w) for w in kept if count[s][w] and shares[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, r) for r, (v, _, w) in enumerate(over, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile, cells, salts, window", [(256, 1 << 14, 32, None), (2, 1, 3, 200)])
def test_audit_against_brute_force(spark, docs, monkeypatch, tile, cells, salts, window):
    """In one block and in many blocks of tiles of two sources; long texts by windows; groups without text or kept words."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SALTS", salts)
    if tile != divergence.TILE:
        monkeypatch.setattr(divergence, "TILE", tile)
    got = divergence.source_divergence(docs, least_docs=3, top=6)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == plain_audit(docs.collect(), 3, 6)
    assert divergence.source_divergence(docs.filter("doc_id = -1")).count() == 0


def test_a_word_of_a_long_text_counts_for_one_document():
    """A text of several windows is one document, whatever its windows repeat."""
    text = "again " * (words.WINDOW // 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["s"], "text": pa.array([text])})
    found = pa.Table.from_batches(divergence.word_counts(iter([batch]))).to_pylist()
    assert sum(r["docs"] for r in found if r["term"]) == 1 and sum(r["n"] for r in found if r["term"]) == words.WINDOW // 3


def test_shares_are_exact(spark):
    """Also where a product would leave the range of a long."""
    cases = [(0, 0, 1), (3, 10, 7), (9_300_000_000, 9_300_000_001, 5), (10**15, 10**15, 3), (5, 10**15, 10**6), (1, 1, 0)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = {tuple(r)[:3]: r["p"] for r in df.select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()}
    assert all(got[c, n, v] == 1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases)
    assert spark.createDataFrame([(0, 0, 0)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] is None


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "same words " * 40
    htmls = [long, long, "short", "short", None, "", "x" * 99, "x" * 99, "é" * 50, "é" * 50, "<html>WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" + "y" * 200, "z" * 2_000_000, "z" * 2_000_000, long]
    rows = [(i + 10, f"http://h/{i}" if i % 4 else None, h, 1, "k") for i, h in enumerate(htmls)]
    rows += [(5, "http://h/\r\nX-Evil: 1", long, 1, "k"), (None, "http://n", "x" * 99, 1, "k"), (None, "http://n", long, 1, "k"), (5, "http://again", long, 1, "k")]
    rows += [(None, "u", "of no one" * 20, 1, "k"), (None, "u", "of no one" * 20, 1, "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, first string").cache()


def plain_archive(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = len(data) >= 100 and f is not None and f != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [None, 0])
def test_archives_against_brute_force(spark, pages, tmp_path, monkeypatch, bound):
    """Written, read back, and told apart, by a broadcast and beyond its bound."""
    if bound is not None:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", bound)
    path = str(tmp_path / "out.warc")
    warc.archive_pages(pages, path)
    got = warc.read_pages(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_archive([(r["page_id"], r["html"]) for r in pages.collect()])
    raw = spark.read.format("warc").load(path)
    assert raw.filter("warc_type = 'warcinfo'").count() >= 1
    evil = raw.filter("record_id = 'urn:page:5'").collect()
    assert {r["target_uri"] for r in evil} == {"http://h/%0D%0AX-Evil: 1", "http://again"} and all("x-evil" not in r["headers"] for r in evil)
    empty = str(tmp_path / "none.warc")
    warc.archive_pages(pages.filter("page_id = -1"), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_archive_predicates_and_payloads(spark, pages, tmp_path, monkeypatch):
    """Predicates on headers go down to the reader and are applied before a payload is inflated; payloads of other columns' reads never are."""
    path = str(tmp_path / "out.warc")
    warc.archive_pages(pages, path)
    wanted = spark.read.format("warc").schema("warc_type string, record_id string, `WARC-Payload-Length` long").load(path)
    some = wanted.filter("warc_type = 'revisit' and record_id in ('urn:page:11', 'urn:page:22', 'urn:page:10')")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert {(r[1], r[2]) for r in some.collect()} == {("urn:page:10", 443), ("urn:page:11", 443), ("urn:page:22", 2_000_000)}
    kept = wanted.filter("record_id like 'urn:page:1%' and warc_type <> 'response' and refers_to is null" if "refers_to" in wanted.columns else "record_id like 'urn:page:1%' and not warc_type = 'response'")
    assert {r[1] for r in kept.collect()} == {"urn:page:10", "urn:page:11", "urn:page:19"}
    # The reader itself: what is not wanted is stepped over, not inflated.
    file = next(p for p in sorted((tmp_path / "out.warc").iterdir(), key=lambda p: -p.stat().st_size) if p.name.endswith(".warc.gz"))
    with open(file, "rb") as f:
        for r in warc.records(f, str(file)):
            assert r.after is not None
            r.block = None  # never asked for


def test_archives_of_other_writers(spark, tmp_path):
    """Plain archives, and gzip members that do not say how long they are; folded headers; a damaged file is an error."""
    def record(kind, uri, body, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: %s\r\n%sContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, uri, extra, len(body), body)

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    made = [record(b"response", b"http://a", http + b"one" * 9000), record(b"request", b"http://b", b"GET /\r\n\r\n"), record(b"response", b"http://c", http + b"WARC/1.0 two", b"X-Long: first\r\n  second\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    warc.use_warc(spark)
    for name in ("a.warc", "b.warc.gz"):
        got = spark.read.format("warc").load(str(tmp_path / name)).orderBy("offset").collect()
        assert [(r["warc_type"], r["target_uri"], r["payload"]) for r in got] == [("response", "http://a", b"one" * 9000), ("request", "http://b", b""), ("response", "http://c", b"WARC/1.0 two")]
        assert got[2]["headers"]["x-long"] == "first second"
        assert spark.read.format("warc").schema("target_uri string").load(str(tmp_path / name)).filter("target_uri = 'http://c'").count() == 1
    (tmp_path / "c.warc").write_bytes(made[0][:-5000])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(made[0])[:-20])
    for name in ("c.warc", "d.warc.gz"):
        with pytest.raises(Exception, match="cut off"):
            spark.read.format("warc").schema("payload binary").load(str(tmp_path / name)).collect()


def test_archives_that_a_failed_write_leaves(spark, tmp_path):
    """A task that fails leaves nothing to be read; an overwrite takes the place of what was there; files are rolled by size."""
    warc.use_warc(spark)
    path = str(tmp_path / "o.warc")
    rows = spark.range(40).select(F.concat(F.lit("urn:"), "id").alias("record_id"), F.lit("resource").alias("warc_type"), F.lit(b"data").alias("payload"))
    rows.write.format("warc").mode("append").save(path)
    with pytest.raises(Exception):
        rows.withColumn("record_id", F.when(F.substring("record_id", 5, 9).cast("int") < 35, F.col("record_id")).otherwise(F.raise_error(F.lit("no")).cast("string"))).write.format("warc").mode("append").save(path)
    read = lambda: spark.read.format("warc").load(path).filter("warc_type = 'resource'")
    assert read().count() == 40 and {bytes(r["payload"]) for r in read().collect()} == {b"data"}
    rows.limit(3).write.format("warc").mode("overwrite").save(path)
    assert read().count() == 3


COLUMNS = {
    "op11_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_the_queries(spark, name):
    import os

    from tabwarden.llm.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes) == COLUMNS[name]
