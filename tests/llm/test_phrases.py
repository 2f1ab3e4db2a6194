"""Phrase mining: the automaton against plain counts, the whole against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landmatch.llm import phrases


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6), st.integers(1, 4))
def test_automaton(pieces, depth):
    ids = np.array([x for p in pieces for x in p], np.int64)
    reach = np.array([min(k + 1, depth) for p in pieces for k in range(len(p))], np.int64)
    a = phrases.Automaton(ids, reach, depth)
    places: dict[tuple, set] = {}
    at = 0
    for p in pieces:
        for e in range(len(p)):
            for k in range(1, min(depth, e + 1) + 1):
                places.setdefault(tuple(p[e - k + 1 : e + 1]), set()).add(at + e)
        at += len(p)
    for k in range(1, depth + 1):
        got = {tuple(ids[e - k + 1 : e + 1]): c for e, c in zip(*a.sequences(k), strict=True)}
        assert got == {s: len(x) for s, x in places.items() if len(s) == k}
    # one state for each class of places; links lead to the next longer class
    assert len(a.count) == len({frozenset(x) for x in places.values()})
    for s in range(len(a.count)):
        word = lambda n, e=a.end[s]: tuple(ids[e - n + 1 : e + 1])
        assert places[word(a.shortest[s])] == places[word(a.longest[s])]
        if a.link[s] < 0:
            assert a.shortest[s] == 1
        else:
            assert a.longest[a.link[s]] == a.shortest[s] - 1
            assert places[word(a.shortest[s] - 1)] > places[word(a.shortest[s])]


def plain(rows, least, share, top):
    counts: dict[str, Counter] = {}
    for text, lang in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        scored = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and v >= least and 100 * v >= share * a and p in (q[:2], q[1:]) for q, v in c.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(t, x, "e", 1) for t, x in rows], "text string, lang string, phrase string, n int").repartition(4)
    return sorted(tuple(r) for r in phrases.mine(df, **options).collect())


def test_against_plain_python(spark):
    rng = random.Random(5)
    vocabulary = ["the", "The", "new", "york", "city", "Ünï", "é", "a-b", "x y", "𝄞"]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; "]
    text = lambda n: "".join(rng.choices(vocabulary, [5, 5, 4, 4, 4, 1, 1, 1, 1, 1])[0] + rng.choices(gaps, [20, 2, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(n))
    rows = [(text(rng.randrange(60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(60)] + [(None, "en"), ("", "xx"), ("...", "en"), (text(3000), "en")] + [("same words here", "fr")] * 12
    options = {"least": 4, "share": 50, "top": 25}
    assert found(spark, rows, **options) == plain(rows, **options)


@pytest.mark.parametrize("most", [8, 40, 200])
def test_slices_count_like_the_whole(most):
    rng = random.Random(most)
    text = "".join(rng.choice(["aa", "b", "c" * rng.randrange(1, 900)]) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(400)).encode()

    def count(parts):
        total = Counter()
        for part in parts:
            ids, distinct, piece, context = phrases.words([part])
            for size in (1, 2, 3):
                fits = np.array([i >= size - 1 and piece[i] == piece[i - size + 1] for i in range(len(ids))], bool)
                end, n = phrases.Automaton(ids, np.where(fits & ~context, size, 0), size).sequences(size)
                for e, c in zip(end, n, strict=True):
                    total[tuple(distinct[int(x)].as_py() for x in ids[e - size + 1 : e + 1])] += int(c)
        return total

    cut = list(phrases.slices(text, most))
    assert len(cut) > 2
    assert count(cut) == count([(text, 0)])


def test_full_bit_set_changes_nothing(spark, monkeypatch):
    rows = [("one two three four", "en")] * 11 + [("two three", "en")] * 30 + [("rare thing", "en")]
    before = found(spark, rows, least=10)
    monkeypatch.setattr(phrases, "bit_set", lambda _: np.full(phrases.FILTER_BITS // 64, 2**64 - 1, np.uint64))
    assert found(spark, rows, least=10) == before == plain(rows, 10, phrases.SHARE, phrases.TOP)


def test_empty_table(spark):
    assert found(spark, []) == []
