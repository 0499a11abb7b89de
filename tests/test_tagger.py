"""Decoding against enumeration, fitting, held-out spans, offsets, odd texts."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from wardstream.operators import tagger
from wardstream.queries import entities

SCHEMA = "id long, note string, marks array<struct<start:int,end:int,label:string>>"


def test_viterbi_equals_enumeration():
    rnd, tags = np.random.default_rng(3), tagger.tags_of(["X", "Y"])
    for n in range(1, 6):
        for _ in range(20):
            emit, move = rnd.normal(size=(n, 5)), rnd.normal(size=(6, 5)) + tagger.allowed(tags)
            worth = lambda p: move[-1, p[0]] + emit[0, p[0]] + sum(move[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
            best = max(itertools.product(range(5), repeat=n), key=worth)
            got = tagger.viterbi(emit, move)
            assert tuple(got) == best
            assert all(tags[b][0] != "I" or tags[a][2:] == tags[b][2:] for a, b in zip([0, *got], got))
    assert tagger.viterbi(np.zeros((0, 5)), np.zeros((6, 5))).size == 0


def test_spans_and_tags():
    words, tags = [(0, 2), (3, 5), (6, 8), (9, 10)], tagger.tags_of(["A", "B"])
    spans = [{"start": 3, "end": 8, "label": "B"}, {"start": 9, "end": 10, "label": "B"}]
    path = tagger.gold(words, spans, {t: i for i, t in enumerate(tags)})
    assert [tags[i] for i in path] == ["O", "B-B", "I-B", "B-B"] and tagger.spans_of(words, path, tags) == spans


def test_learns_names_by_context(spark):
    """Two labels told apart by what stands before them; the drugs of the last notes were never seen."""
    drugs, sites = ["amikacin", "cefepime", "linezolid", "colistin", "meropenem", "ampicillin"], ["left chest", "right arm", "lower back", "upper lip"]
    rows = []
    for i in range(240):
        d, s = (drugs[i % 6], sites[i % 4]) if i < 200 else (f"novomycin{'abcdefg'[i % 7]}", sites[i % 4])
        t = f"통증 {s} 부위, start {d} iv" if i % 2 else f"on {s} pain; start {d} today"
        rows.append((i, t, [(t.index(d), t.index(d) + len(d), "DRUG"), (t.index(s), t.index(s) + len(s), "SITE")]))
    df = spark.createDataFrame(rows, SCHEMA)
    model = tagger.fitted(df.where("id < 200"), "note", "marks", "id", rounds=3, buckets=1 << 12)
    out = tagger.tagged(df, "note", model)
    a = {r["label"]: r["f1"] for r in tagger.agreement(out.where("id >= 200"), "entities", "marks").collect()}
    assert a[None] >= 0.95 and set(a) == {None, "DRUG", "SITE"}
    again = tagger.fitted(df.where("id < 200").repartition(7), "note", "marks", "id", rounds=3, buckets=1 << 12)
    assert np.array_equal(model.emit, again.emit) and np.array_equal(model.move, again.move)
    long = "start colistin today. " * 3000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, long), (5, "😀 start colistin iv")], "id long, note string")
    got = {r["id"]: r["entities"] for r in tagger.tagged(odd, "note", model).collect()}
    assert got[1] == got[2] == got[3] == [] and len(got[4]) == 3000 and all(long[e["start"]:e["end"]] == e["text"] == "colistin" for e in got[4])
    assert [tuple(e) for e in got[5]] == [(8, 16, "DRUG", "colistin")]
    none = tagger.fitted(df.where("false"), "note", "marks", "id", rounds=1, buckets=64)
    assert none.tags == ("O",) and tagger.tagged(df.where("id = 1"), "note", none).first()["entities"] == []


def test_held_out_patients(spark, sf_dir):
    out = entities.learned(spark, sf_dir).cache()
    assert out.where("held_out").count() > 0 and out.where("NOT held_out").count() > 0
    a = {r["label"]: r for r in tagger.agreement(out.where("held_out"), "entities", "_marks").collect()}
    print({k: round(r["f1"], 4) for k, r in a.items()})
    assert a[None]["f1"] >= 0.99 and set(a) == {None, *entities.MARKS}
    same = out.select(F.explode("entities").alias("e"), "note").where("substr(note, e.start + 1, e.end - e.start) <> e.text")
    assert same.isEmpty()


def test_copies_of_a_text_weigh_as_rows_do():
    """One row of n copies leaves the weights and means that n rows leave, taken in turn."""
    tags, buckets = tagger.tags_of(["X", "Y"]), 256
    k, bars = len(tags), tagger.allowed(tags)
    rng, rows = np.random.default_rng(5), []
    for t in ("give ten mg now", "no ten of nine", "nine mg", "ten ten ten"):
        words = t.split()
        path = rng.integers(0, 2, len(words)) * 2 + 1  # no I-, so any path is allowed
        rows.append((tagger.features(words, buckets).astype(np.int32).tobytes(), path.astype(np.int16).tobytes(), int(rng.integers(2, 9))))
    rows.append((rows[-1][0], np.array([1, 3, 1], np.int16).tobytes(), 4))  # the same text, marked otherwise

    class Sent:
        value = (np.zeros((buckets, k)), np.zeros((k + 1, k)))

    run = lambda data: pd.concat(tagger._pass(Sent, k, bars)([pd.DataFrame(data, columns=["found", "right", "copies"])]))
    for rows_ in (rows, rows[:3], rows[:1]):
        one, each = run(rows_), run([(f, y, 1) for i in range(9) for f, y, n in rows_ if i < n])
        assert one["bucket"].tolist() == each["bucket"].tolist() and len(one) > 10
        assert all(np.array_equal(a, b) for c in ("weights", "mean") for a, b in zip(one[c], each[c]))


@pytest.mark.parametrize("name", ["learned_entities", "learned_numbers"])
def test_queries_mark_and_tag_a_text_once(spark, monkeypatch, name):
    read = []
    monkeypatch.setattr(entities, "marked", lambda df, *a, f=entities.marked: read.append(df.count()) or f(df, *a))
    monkeypatch.setattr(tagger, "tagged", lambda df, *a, f=tagger.tagged: read.append(df.count()) or f(df, *a))
    assert entities.R.queries[name](spark, SMALL).count() > 5000
    assert len(read) == 2 and 0 < max(read) <= 400  # of 1,000
