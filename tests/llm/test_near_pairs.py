"""Pairs in which near duplicates are compared."""

import random

from tabwarden.llm import near_dedup


def test_texts_that_share_a_passage_are_compared_a_few_times_and_none_is_lost(spark, monkeypatch):
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{draw.randrange(10**9)}" for _ in range(12)])) for i in range(150)]
    rows += [(1000 + i, t + " end") for i, t in rows[:20]]  # near copies among them
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, real = {}, near_dedup.keep

    def keep(df, what):
        out = real(df, what)
        if what in ("near-stars", "near-edges"):
            counts.setdefault(what, []).append(out)
        return out

    monkeypatch.setattr(near_dedup, "keep", keep)

    def run():
        counts.clear()
        found = sorted(map(tuple, near_dedup.near_dedup(docs).collect()))
        return found, counts["near-stars"][1].count(), counts["near-edges"][0]

    found, few, edges = run()
    assert edges.filter("a >= b").isEmpty()  # an edge is one row
    monkeypatch.setattr(near_dedup, "MEETINGS", 1)
    same, many, _ = run()
    assert found == same and sum(not r[3] for r in found) == 20 and all(r[1] == r[0] - 1000 for r in found if r[0] >= 1000)
    assert 2 * few < many, (few, many)
