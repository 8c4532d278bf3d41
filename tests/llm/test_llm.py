"""The operators of the subpackage against brute force, on tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabwarden.llm import license_scan as lic
from tabwarden.llm import lm_scoring as lm
from tabwarden.llm import packing, pii
from tabwarden.llm import sentencepiece_codec as spc
from tabwarden.llm.chat_format import HOSTILE, chat_format, escape, read_back, unescape
from tabwarden.llm.common import see_package
from tabwarden.llm.exact_dedup import exact_dedup
from tabwarden.llm.langid import fit, identify
from tabwarden.llm.near_dedup import near_dedup
from tabwarden.llm.topk import top_k

DRAW = random.Random(5)
WORDS = ["".join(DRAW.choice("abcdefghijklmno") for _ in range(DRAW.randint(2, 9))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with everything that is odd, and columns whose names might clash."""
    see_package(spark)
    first = prose(300)
    words = first.split()
    near = [w if i % 60 else "changed" for i, w in enumerate(words)]
    texts = [
        first, first, " ".join(near), None, "", "   \n\t ", "one", "one two three", "one  two three", prose(9000), "x" * 50_000, "é ﬁ 日本語 🙂 \x00 a\x1eb",
        "Mail a.b@c-d.org, 10.0.0.256 or 10.0.0.1, +49 (30) 1234-5678, 4111 1111 1111 1111.", "Licensed under the Apache License, Version 2.0.\n\n" + prose(40),
        *[prose(DRAW.randint(1, 400)) for _ in range(40)],
    ]
    rows = [(i, t, "en" if i % 2 else None, 1, "k", 0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, prose(20), "en", 2, "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int, node string, kept int").cache()


def told(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_exact_dedup(spark, docs):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()), key=str)
    rows = told(docs)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = [(i, max(groups[t or ""], key=lambda x: -1 if x is None else x), len(groups[t or ""])) for i, t in rows]
    assert sorted((g[:3] for g in got), key=str) == sorted(want, key=str)
    assert sum(g[3] for g in got) == len(groups)
    assert exact_dedup(docs.filter("doc_id = -5")).count() == 0


def test_exact_dedup_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    from tabwarden.llm import common, exact_dedup as module

    said = lambda: sorted((tuple(r) for r in exact_dedup(docs).collect()), key=str)
    usual = [r[:3] for r in said()]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(module, "BITS", 1 << 15)  # bits that several keys share hash more rows, and change nothing
    assert [r[:3] for r in said()] == usual


def shingles(text):
    w = (text or "").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near_dedup_against_all_pairs(spark, docs):
    rows = told(docs)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    classes = {}
    for n, (i, _) in enumerate(rows):
        classes.setdefault(find(n), []).append(i)
    want = sorted((sorted(c, key=str) for c in classes.values()), key=str)
    found = {}
    kept = {}
    for n, r in enumerate(near_dedup(docs).collect()):
        key = (r["class_id"], r["class_size"]) if r["class_size"] > 1 else n
        found.setdefault(key, []).append(r["doc_id"])
        kept[key] = kept.get(key, 0) + r["kept"]
    assert sorted((sorted(c, key=str) for c in found.values()), key=str) == want
    assert set(kept.values()) == {1}
    assert near_dedup(docs.filter("doc_id = -5")).count() == 0


def test_near_dedup_recall_over_a_large_group(spark):
    base = prose(400).split()
    texts = [" ".join(w if DRAW.random() > 0.01 else DRAW.choice(WORDS) for w in base) for _ in range(150)] + [prose(200) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = sorted((r["class_size"] for r in near_dedup(df).collect()), reverse=True)
    assert sizes[0] >= 148 and sizes[-1] == 1


def test_near_dedup_links_of_the_test_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = told(df)
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for n, b in enumerate(ids) for a in ids[:n] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of = {r["doc_id"]: r["class_id"] for r in near_dedup(df).collect()}
    assert linked and sum(of[a] == of[b] for a, b in linked) >= 0.98 * len(linked)


def test_darts_agree_as_often_as_weighted_sets_overlap():
    from tabwarden.llm import near_dedup as near

    np = near.np
    element = np.arange(1, 41, dtype=np.uint64)
    a, b = np.where(element < 30, 0.3 + (element % 5), 0.0).astype(float), np.where(element > 8, 0.7 + (element % 3), 0.0).astype(float)
    both = near.dart_signatures(np.repeat([0, 1], 40), near.mix(np.tile(element, 2)), np.concatenate([a, b]), 2, 4096)
    assert (both[0] == both[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_near_dedup_finds_pairs_within_a_family_below_the_threshold(spark, monkeypatch):
    from tabwarden.llm import near_dedup as near

    core, texts = prose(354).split(), []
    for pair in range(150):  # 0.81 within a pair, 0.75 to 0.79 with the rest of the family
        both = [f"pair{pair}x{i}" for i in range(8)]
        texts += [" ".join(core + both + [f"own{pair}y{k}z{i}" for i in range(36 + pair % 5)]) for k in range(2)]
    sets = [shingles(t) for t in texts]
    close = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    linked = {(a, b) for b in range(300) for a in range(b) if close(a, b) >= 0.8}
    assert linked == {(2 * i, 2 * i + 1) for i in range(150)} and 0.75 <= close(0, 299) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i - i % 2 for i in range(300)}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup(df).collect()} == want
    monkeypatch.setattr(near, "BLOCK_BYTES", 40_000)  # so that buckets take several blocks
    assert {r["doc_id"]: r["class_id"] for r in near_dedup(df).collect()} == want


def test_prefixes_and_blocks_lose_no_link_of_a_bucket(spark, monkeypatch):
    from tabwarden.llm import near_dedup as near

    np, draw = near.np, random.Random(11)
    pool, sets = [draw.getrandbits(40) for _ in range(400)], []
    for n in range(240):  # families that drop or swap a fifth or less of a base, very small sets, parts of one another
        base = pool[: draw.choice([1, 2, 3, 5, 9, 20, 40, 90, 390])]
        lost = draw.random() * 0.2
        sets.append({x for x in base if draw.random() > lost} | {draw.getrandbits(40) for _ in range(int(len(base) * draw.random() * 0.1))} or {base[0]})
    ids = [n.to_bytes(16, "big") for n in range(len(sets))]
    packed = [b"".join(x.to_bytes(5, "little") for x in sorted(s)) for s in sets]
    linked = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = {n: n for n in range(len(sets))}
    for a, b in sorted(linked):
        x, y = sorted((want[a], want[b]))
        want = {n: x if r == y else r for n, r in want.items()}
    rows = spark.createDataFrame([(7, i, i) for i in ids], "key long, node binary, root binary")
    texts = spark.createDataFrame(list(zip(ids, packed)), "node binary, shingles binary")

    def classes():
        found = near.components(near.rest(rows, texts, 0.8)).collect()
        return {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in found}

    joined = {n: r for n, r in want.items() if list(want.values()).count(r) > 1}
    assert len(set(joined.values())) > 5 and len(joined) < len(sets)
    assert classes() == joined
    monkeypatch.setattr(near, "BLOCK_BYTES", 600)  # so that groups take several blocks
    assert classes() == joined


def test_sentencepiece(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spc.model_path())
    ids = spc.encode(docs.select("doc_id", "text", "kept"))
    got = sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=str)
    assert got == sorted(((i, model.encode(t or "")) for i, t in told(docs)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in spc.decode(ids).collect()), key=str) == sorted(((i, model.decode(model.encode(t or ""))) for i, t in told(docs)), key=str)
    assert spc.round_trip(docs).filter("not restored").count() == 0
    odd = spark.createDataFrame([(1, [3 + 255, 3 + 0x61, -7, 10**6, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in spc.decode(odd.coalesce(1)).collect()] == ["�a ⁇  ⁇ ", "", ""]


def test_pieces_match_wherever_they_occur():
    m = spc.Matcher(["ab", "aba", "ba", "zz"])
    codes = spc.np.array([ord(c) + 1 for c in "ababa"])
    assert sorted(zip(*(x.tolist() for x in m.edges(codes)))) == [(0, 0), (0, 1), (1, 2), (2, 0), (2, 1), (3, 2)]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(docs, capacity=256).collect()
    pieces = {}
    for i, t in told(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            key = (i, n, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    places = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == pieces
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.03 * math.ceil(sum(r["length"] for r in rows) / 256) + 2
    assert packing.pack_documents(docs.filter("doc_id = -5")).count() == 0


BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base_by_patterns(text):
    ok = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0,
        lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15,
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, t in zip(pii.KINDS, BASE, ok) for m in re.finditer(p, text) if t(m[0]))


def test_pii_base(spark, docs):
    odd = ["a@b.c@d.e x@y 1@2.3", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256", "4111-1111 1111-1111 4111111111111111 0", "+1 (2) 3.4-5 67 89 +12345678 +1234567", "@@a@b.co +a@b.co"]
    odd += ["".join(DRAW.choice("ab1234567890@.+- ()%_") for _ in range(120)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(-1, None)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = sorted(((i, base_by_patterns(t or "")) for i, t in told(df)), key=str)
    got = pii.find_pii(df).collect()
    assert sorted(((r["doc_id"], r["base"]) for r in got), key=str) == texts
    for r in got:
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))


def test_pii_field_adds_and_redacts(spark):
    df = spark.createDataFrame([(1, "Please call (555) 321-7654 tonight."), (2, "There were 12 ships in 1984.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df, redact=True).collect()}
    assert got[1]["spans"] == "phone:12:26" and got[1]["redacted"] == "Please call [PHONE] tonight."
    assert got[2]["spans"] == "" and got[2]["redacted"] == "There were 12 ships in 1984."


def test_field_fits_its_table_and_decodes_whole_texts():
    model = pii.field()
    texts, marks = pii.labelled()
    assert sum([(k, a, b) for a, b, k in m] == f for m, f in zip(marks, model.spans(texts))) >= 0.98 * len(texts)
    # What is decided without Viterbi is what Viterbi over whole texts says.
    odd = ["".join(DRAW.choice(["at", "dot", "@", ".", " ", " ", "call", "email", "12", "345", "x", "Word", "(", ")", "-", "card"]) for _ in range(DRAW.randint(0, 300))) for _ in range(60)]
    odd += [prose(300) + " call 030 1234567 now " + prose(200), "", "\n", prose(3000)]
    assert model.spans(odd) == model.spans(odd, whole=True)
    assert [model.spans([t])[0] for t in odd] == model.spans(odd)


def test_field_finds_planted_data_and_leaves_prose(spark):
    names, hosts = ["omar", "lena.k", "zoe_w", "finn"], [("acme", "com"), ("blue", "org"), ("north", "net"), ("tiny", "de")]
    made = []
    for i in range(60):
        name, (host, top) = DRAW.choice(names), DRAW.choice(hosts)
        area, mid, end = DRAW.randint(200, 899), DRAW.randint(200, 899), DRAW.randint(1000, 9999)
        made.append(DRAW.choice([
            (f"write to {name} at {host} dot {top}", 0), (f"email: {name} (at) {host}.{top}", 0), (f"contact {name} AT {host}.{top}", 0),
            (f"call ({area}) {mid}-{end}", 3), (f"phone: {area}-{mid}-{end}", 3), (f"server {DRAW.randint(10, 99)}[.]{DRAW.randint(10, 99)}[.]7[.]{DRAW.randint(1, 254)}", 1),
            ("card number: 4111.1111.1111.1111", 2),
        ]))
    texts = [f"{prose(40)}. {t}. {prose(30)}" for t, _ in made]
    clean = [prose(200), "See pages 10-20 of the order. It was at home. He met 25 guests on 2019-04-03.", "at. at, at dot. Look at it.", "Totals: 12.50 1,200 13 14 15 2020 2021"] + [prose(80) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df, redact=True).collect()}
    hit = sum(pii.KINDS[k] + ":" in got[i]["spans"] for i, (_, k) in enumerate(made))
    assert hit >= 0.8 * len(made)
    for i in range(len(texts), len(texts) + len(clean)):
        assert got[i]["spans"] == "" and got[i]["redacted"] == (texts + clean)[i]


def test_licenses(spark, docs):
    got = {r["doc_id"]: r for r in lic.license_scan(docs.filter("doc_id is not null")).collect()}
    assert got[13]["license"] == "Apache-2.0" and got[13]["dice"] == 1.0
    assert all(r["license"] is None for i, r in got.items() if i != 13)
    mit = lic.TEMPLATES["MIT"].replace("copy", "Copy").replace("\n", " \n ")
    changed = " ".join(w for i, w in enumerate(mit.split()) if i % 25)
    df = spark.createDataFrame([(1, "Copyright 2001\n" + mit), (2, changed), (3, mit + " " + mit + " " + mit)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lic.license_scan(df).collect()}
    whole = {i: {m["license"] for m in r["matches"] if m["unit"] == "text"} for i, r in got.items()}
    assert whole == {1: {"MIT"}, 2: {"MIT"}, 3: set()}  # bigrams count as often as they come
    assert got[1]["license"] == "MIT" and got[1]["dice"] == 1.0  # a run of its paragraphs, word for word
    assert got[2]["license"] == "MIT" and 0.8 <= got[2]["dice"] < 1


def test_license_in_the_middle_of_a_long_document(spark):
    before, after = prose(700) + "\n\n" + prose(60), prose(80) + "\n\n" + prose(900)
    names = sorted(lic.TEMPLATES)
    df = spark.createDataFrame([(i, f"{before}\n\n{lic.TEMPLATES[n].strip()}\n\n{after}") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lic.license_scan(df).collect()}
    for i, n in enumerate(names):
        assert n in {m["license"] for m in got[i]["matches"]} and got[i]["dice"] == 1.0, n
        assert sum(m["unit"] == "run" for m in got[i]["matches"]) <= 1
    assert lic.license_scan(df.filter("doc_id < 0")).count() == 0


def test_license_anchors_lose_nothing(spark):
    """Dice over all templates by brute force, on shuffled parts of templates."""
    known = lic.templates(lic.TEMPLATES)
    texts = []
    for _, text in sorted(lic.TEMPLATES.items()):
        w = lic.normalised(text)
        for _ in range(6):
            cut = [x for x in w if DRAW.random() > 0.06]
            texts.append(" ".join(cut))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in lic.license_scan(df).collect()}
    for i, t in enumerate(texts):
        b = lic.numbered(t.split())
        scores = [(-2 * len(set(b) & set(o)) / (len(b) + len(o)), name) for name, o in known]
        best = min(scores)
        assert got[i] == (best[1] if best[0] <= -0.8 else None)


def test_language(spark):
    def text(letters, n=60):
        return " ".join("".join(DRAW.choice(letters) for _ in range(DRAW.randint(2, 8))) for _ in range(n))

    kinds = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    rows = [(i, text(kinds[k]), k) for i, k in enumerate(list(kinds) * 60)] + [(500, None, "aa"), (501, "123 !?", "aa"), (502, "", None), (503, "жзийк " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in identify(df, model).collect()}
    held = [(i, k) for i, _, k in rows if i < 500 and i % 4 == 2]
    assert sum(got[i]["lang_pred"] == k for i, k in held) >= 0.98 * len(held)
    for i in (500, 501, 502):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[503]["rejected"]
    none = identify(df, fit(df.filter("doc_id < 0"), F.lit(True))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_by_plain_python(spark):
    """Frequencies, vectors and cosines of the test tables' documents without arrays."""
    import os

    from tabwarden.llm import langid

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("score", F.lit("clash"))
    model = fit(df, ~langid.held_out())

    def grams(text):
        chars, out = [], {}
        for c in (text or "").lower() + " ":
            c = c if c.isalpha() else " "
            if c != " " or chars[-1:] not in ([], [" "]):
                chars.append(c)
        for n in langid.ORDERS:
            for i in range(len(chars) - n + 1):
                h = n
                for c in chars[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                out[h >> (64 - langid.D.bit_length() + 1)] = out.get(h >> (64 - langid.D.bit_length() + 1), 0) + 1
        return out

    rows = df.collect()
    bags = [grams(r["text"]) for r in rows]
    train = [b for r, b in zip(rows, bags) if (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2) and r["text"] is not None and r["lang"] is not None]
    seen = {}
    for b in train:
        for g in b:
            seen[g] = seen.get(g, 0) + 1
    idf = [math.log((1 + len(train)) / (1 + seen.get(g, 0))) + 1 for g in range(langid.D)]
    assert [float(x) for x in model.idf] == pytest.approx(idf, abs=1e-5)
    centroids = [(lang, [float(x) for x in c]) for lang, c in zip(model.langs, model.centroids)]
    want = {}
    for r, b in zip(rows, bags):
        v = {g: math.log1p(n) * idf[g] for g, n in b.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        near = [(sum(x * c[g] for g, x in v.items()) / size, lang) for lang, c in centroids]
        want[r["doc_id"]] = max(near) if any(ch.isalpha() for ch in r["text"] or "") else (0.0, "und")
    got = identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]][0], abs=1e-3) and r["lang_pred"] == want[r["doc_id"]][1]


def test_language_rejects_junk_and_keeps_prose(spark):
    import os

    from tabwarden.llm import langid

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(df, ~langid.held_out())
    assert identify(df, model).filter("rejected").count() <= 1
    junk = ["asdkjh qwlekj zxmcnb 1kjh2 qpwoe lkjsd mnxcb " * 8, "你好世界" * 30, "Привет мир это русский текст " * 9, "def f(x): return x+1 # 12345 " * 5, "qzxj " * 400]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert identify(odd, model).filter("rejected").count() == len(junk)
    assert identify(df.filter("doc_id < -1"), model).count() == 0


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, []), (304, [1.0, 2.0]), (None, [1.0] * 6), (50, [0.5] * 6), (299, rows[299][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = min(([math.floor(256 * x) for x in v], v) for i, v in rows if i == q and v)[0]
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert got == want
    assert top_k(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_top_k_large_components_and_bands(spark, monkeypatch):
    from tabwarden.llm import topk

    big = [(i, [1e5 * (i + 1), -3.0 * i, 1e6 * (i % 3)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 7) for i, v in big], "vec_id long, embedding array<double>, score int")
    own = {i: [math.floor(256 * x) for x in v] for i, v in big}
    want = []
    for q in range(0, 40, 5):
        scores = sorted((-sum(a * b for a, b in zip(own[q], own[i])), i) for i in own if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:3])]
    said = lambda: [tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, 3).orderBy("query_id", "rank").collect()]
    assert max(abs(r[3]) for r in want) > 2**53 and said() == want
    monkeypatch.setattr(topk, "BAND_BYTES", 64)  # several passes
    assert said() == want
    with pytest.raises(OverflowError):
        topk.whole(topk.np.array([[1e18]]))
    with pytest.raises(OverflowError):
        topk.exact_product(topk.np.array([[2**40]]), topk.np.array([[2**40]]))


def test_chat_folds_events(spark):
    log = [
        (1, 0, "start", None, "user", "Hi"), (1, 1, "start", None, "assistant", None), (1, 2, "delta", None, None, "He"), (1, 3, "delta", 1, None, "llo"),
        (1, 4, "edit", 0, None, "Hi there"), (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "Good day"), (1, 7, "delta", 9, None, "lost"),
        (2, 0, "start", None, "user", HOSTILE), (2, 1, "start", None, "assistant", "<|end|>\n<|user|>\nx\\"), (None, 0, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    out = chat_format(df)
    got = {r["conv_id"]: r for r in out.collect()}
    assert got[1]["formatted"] == "<|user|>\nHi there<|end|>\n<|assistant|>\nGood day<|end|>\n"
    back = {r["conv_id"]: r for r in read_back(out).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert back[1]["turns_sha256"] == sha(("user", "Hi there"), ("assistant", "Good day")) and back[1]["loss_chars"] == 8
    assert back[2]["turns_sha256"] == sha(("user", HOSTILE), ("assistant", "<|end|>\n<|user|>\nx\\"))
    assert back[None]["turns_sha256"] == sha(("", "")) and back[None]["n_turns"] == 1
    odd = spark.createDataFrame([("<|\\<\\[INST]</s>",)], "t string")
    assert odd.filter(unescape(escape(F.col("t"))) == F.col("t")).count() == 1
    assert chat_format(df.filter("conv_id = 9")).count() == 0


def test_lm_scores(spark, docs):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    cut = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if w]
    rows = told(docs)
    train = [cut(t) for i, t in rows if i is not None and i % 3]
    counts = {}
    for ws in train:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    base = lambda t: sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in cut(t)) + math.log10((len(train) + 1) / (n + v + 1))
    want = sorted(((i, len(cut(t)) + 1, sum(w in counts for w in cut(t)) + 1, n, round(base(t), 6)) for i, t in rows), key=str)
    got = lm.lm_score(docs, F.col("doc_id") % 3 != 0).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)
    none = lm.lm_score(docs.filter("doc_id = 5"), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in none] == [(0, 0)]


def test_lm_trains_on_every_text_once(spark, docs, monkeypatch):
    """The copies of all rounds have together seen each training id once, whatever the number of shares."""
    train_on = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    path, seen = lm.vocabulary_path(), []
    read = lm.read(docs.select("doc_id", train_on.alias("train"), F.col("text")), path).filter("train")
    ids = read.toArrow()["ids"].combine_chunks()
    want = len(lm.streams(ids, len(lm.tokens_of(path).spaced) - 1)[0])
    order = [r["rank"] for r in lm.dealt(read).collect()]
    assert sorted(order) == list(range(len(ids)))
    own = lm.together

    def met(copies):
        total = own(copies)
        seen.append(total["seen"][0].as_py())
        return total

    monkeypatch.setattr(lm, "together", met)
    for share in (10**9, 3000):
        seen.clear()
        monkeypatch.setattr(lm, "SHARE_TOKENS", share)
        lm.lm_score(docs, train_on)
        assert len(seen) == lm.ROUNDS and sum(seen) == want


def test_lm_does_not_depend_on_partitions(spark, docs, monkeypatch):
    """One, four and many partitions give the same scores, with a tree of many shares."""
    monkeypatch.setattr(lm, "SHARE_TOKENS", 500)
    monkeypatch.setattr(lm, "FAN", 3)
    found = [sorted(((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.lm_score(docs.repartition(n), F.col("doc_id") % 7 != 2).collect())) for n in (1, 4, 64)]
    for other in found[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in found[0]]
        assert [x[2] for x in other] == pytest.approx([x[2] for x in found[0]], rel=1e-6)


def test_lm_frequent_and_other_words_agree(spark, docs, monkeypatch):
    few = lambda: sorted(((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in lm.lm_score(docs, F.col("doc_id") % 3 != 0).collect()), key=str)
    all_sent = few()
    monkeypatch.setattr(lm, "FREQUENT", 3)
    assert few() == all_sent


def a_layout():
    np = lm.np
    return lm.Layout(np.random.default_rng(2).integers(0, 50, 50_257).astype(float), np.arange(50_257) % 3 == 0)


def test_attention_is_causal_and_its_gradient_right():
    np = lm.np
    rng = np.random.default_rng(1)
    model = lm.Attention(a_layout())
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    fed = rng.integers(0, 50, (3, 2 * lm.BLOCK))
    target = rng.integers(0, lm.CLASSES * lm.LEAVES, (3, lm.BLOCK))
    target[2, 5:] = -1
    before = model.score(fed, target, model.tables())
    later = fed.copy()
    later[:, lm.BLOCK + 7 :] += 1
    assert np.allclose(before[:, :7], model.score(later, target, model.tables())[:, :7])
    loss = lambda: -model.score(fed, target, model.tables()).sum() / (target >= 0).sum()
    g = model.gradient(fed, target)
    for name in model.NAMES:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3), name


def test_lm_probabilities_of_all_ids_sum_to_one():
    np = lm.np
    layout = a_layout()
    model = lm.Attention(layout)
    ids = np.arange(len(layout.target))
    fed = np.tile(np.random.default_rng(3).integers(0, 50, (1, 2 * lm.BLOCK)), (-(-len(ids) // lm.BLOCK), 1))
    fed[:, lm.BLOCK :] = fed[:, :1]
    for place in (0, lm.BLOCK - 1):  # each id in turn as the target of one place
        target = np.full((len(ids), lm.BLOCK), -1)
        target[:, place] = layout.target
        chance = sum(
            np.exp(model.score(np.repeat(fed[:1], 1000, axis=0)[: len(t)], t, model.tables())[:, place].astype(np.float64) + w).sum()
            for t, w in ((target[b : b + 1000], layout.within[b : b + 1000]) for b in range(0, len(ids), 1000))
        )
        assert chance == pytest.approx(1, abs=1e-3)


def test_lm_tiles_hold_each_row_with_a_target_once():
    """Classes from none to many tiles, and padding: rows and sums of tiles are those of the classes."""
    np = lm.np
    rng = np.random.default_rng(4)
    for of_class in (rng.choice([-1, 0, 5, lm.CLASSES - 1], 700, p=[0.1, 0.7, 0.15, 0.05]), np.full(9, -1), np.arange(-1, lm.CLASSES), np.full(2 * lm.TILE, 3)):
        rows = np.vstack([rng.normal(size=(len(of_class), 3)), np.zeros((1, 3))])
        tiles = lm.Tiles(of_class)
        dealt = tiles.dealt(rows)
        back = np.vstack([dealt.reshape(-1, 3), np.full((1, 3), 7.0)])[tiles.where]
        assert (back == np.where((of_class >= 0)[:, None], rows[:-1], 7)).all() and (np.sort(tiles.rows) == np.flatnonzero(of_class >= 0)).all()
        assert np.allclose(tiles.by_class(dealt.sum(axis=1)), [rows[:-1][of_class == c].sum(axis=0) for c in range(lm.CLASSES)])


def test_lm_step_makes_tables_of_the_symbols_that_occur(monkeypatch):
    """A step's tables hold its own symbols, not all; its gradient is that of probabilities also where logits are cut off."""
    np, made, own = lm.np, [], lm.Attention.attend
    monkeypatch.setattr(lm.Attention, "attend", lambda self, fed, tables: made.append([len(x) for x in tables]) or own(self, fed, tables))
    rng, model = np.random.default_rng(5), lm.Attention(a_layout())
    fed = rng.integers(7, 60, (40, 2 * lm.BLOCK))
    target = rng.integers(0, lm.CLASSES * lm.LEAVES, (40, lm.BLOCK))
    for bias in (0, 100):
        model.p["bias"] = model.p["bias"] + np.float32(bias) * (np.arange(lm.CLASSES) == 2)
        made.clear()
        g = model.gradient(fed, target)
        assert made == [[len(np.unique(fed))] * 2] and all(np.isfinite(x).all() for x in g.values())
        assert np.flatnonzero(np.abs(g["embed"]).sum(axis=1)).tolist() == np.unique(fed).tolist()
        assert abs(g["bias"].sum()) < 1e-4 and np.isfinite(model.score(fed, target, model.tables())).all()


def test_lm_steps_leave_no_numbers_too_small_for_float32():
    """The running means of what no longer occurs fade to 0, not to numbers below the smallest normal one, which are slow."""
    np, model = lm.np, lm.Attention(a_layout())
    adam, g = lm.Adam(model), {n: np.full_like(x, 1e-3) for n, x in model.p.items()}
    adam.step(g)
    for _ in range(1100):
        adam.step({n: np.zeros_like(x) for n, x in g.items()})
    means = np.concatenate([np.ravel(x) for x in adam.m.values()]) if isinstance(adam.m, dict) else adam.m
    assert not ((means != 0) & (np.abs(means) < np.finfo(np.float32).tiny)).any()


def test_lm_beats_counts_and_pairs_of_ids(spark):
    """Held-out log10 probability against the ids' counts alone, and against counts of id pairs smoothed by them (Witten and Bell)."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    np, path = lm.np, lm.vocabulary_path()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.lm_score(docs, ~lm.held_out()).withColumn("held", lm.held_out()).filter("held").agg(F.sum("score")).first()[0]
    read = lm.read(docs.select("doc_id", (~lm.held_out()).alias("train"), "text"), path).toArrow()
    end = len(lm.tokens_of(path).spaced) - 1
    train, test = (lm.streams(read.filter(x)["ids"].combine_chunks(), end)[0] for x in (read["train"], lm.pc.invert(read["train"])))
    counts = np.bincount(train, minlength=end + 1)
    alone = np.log10((counts + 1) / (counts.sum() + end + 1))
    seen, times = np.unique(np.append(end, train[:-1]) * (end + 1) + train, return_counts=True)
    after = np.bincount(seen // (end + 1), minlength=end + 1)
    before = np.append(end, test[:-1])
    at = np.minimum(np.searchsorted(seen, before * (end + 1) + test), len(seen) - 1)
    both = np.where(seen[at] == before * (end + 1) + test, times[at], 0)
    starts = np.bincount(np.append(end, train[:-1]), minlength=end + 1)
    pairs = np.log10((both + np.maximum(after[before], 1) * 10 ** alone[test]) / (starts[before] + np.maximum(after[before], 1))).sum()
    assert got > 0.8 * alone[test].sum() and got > pairs


def each_operator(docs):
    """Every operator over the columns doc_id and text, by name: a row per document."""
    model = fit(docs, F.lit(True))
    return {
        "exact": lambda: exact_dedup(docs), "near": lambda: near_dedup(docs), "pieces": lambda: spc.encode(docs), "license": lambda: lic.license_scan(docs),
        "pii": lambda: pii.find_pii(docs), "language": lambda: identify(docs, model), "lm": lambda: lm.lm_score(docs, F.lit(True)),
        "packing": lambda: packing.pack_documents(docs, capacity=1 << 20),
    }


def test_odd_rows_and_clashing_columns_give_a_row_each(spark, docs):
    """Nulls, empty and very long texts, repeated rows, null ids, and extra columns with the operators' own names."""
    clash = ["_text", "_size", "_hash", "_plain", "ids", "bands", "shingles", "rejected", "lang_pred", "score", "spans", "base", "piece", "length", "root", "train", "_units"]
    odd = docs.unionByName(spark.createDataFrame([(900, "word " * 60_000, None, 1, "k", 0)], docs.schema)).select("*", *[F.lit("x").alias(c) for c in clash])
    want = sorted((r["doc_id"] for r in odd.select("doc_id").collect()), key=str)
    for name, run in each_operator(odd).items():
        assert sorted((r["doc_id"] for r in run().select("doc_id").collect()), key=str) == want, name


def test_empty_tables(spark, docs):
    for name, run in each_operator(docs.filter("doc_id = -5")).items():
        assert run().count() == 0, name


def test_chat_repeated_rows_and_other_columns(spark):
    log = [(1, 0, "start", None, "user", "Hi", "x"), (1, 1, "start", None, "assistant", "Yo", "x"), (1, 1, "start", None, "assistant", "Yo", "x")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string, message string")
    df = df.select("*", F.lit(1).alias("_at"), F.lit("z").alias("formatted"), F.lit("z").alias("mask"))
    assert chat_format(df).first()["formatted"] == "<|user|>\nHi<|end|>\n" + "<|assistant|>\nYo<|end|>\n" * 2


def test_top_k_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, "a", 1, 2) for i in range(10)], "vec_id long, embedding array<double>, id int, vector string, block int, score int")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") == 3, 2).orderBy("rank").collect()]
    assert got == [(3, 1, 9, 256 * 256 * 28), (3, 2, 8, 256 * 256 * 25)]


CONTRACT = {
    "op2_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_of_the_queries(spark, name):
    import os

    from tabwarden.llm.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert CONTRACT[name].items() <= dict(df.dtypes).items()
    if "held_out" in df.columns:
        rest, out = (4, 2) if name.startswith("op10") else (7, 2)
        rows = df.select("doc_id", "held_out").collect()
        assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % rest == out) for r in rows)
