"""Quality rules, language identification, near-duplicates, line dedup, licences, resharding, neighbours and the pipeline."""

from __future__ import annotations

import math
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from landmatch.llm import ann, language, licenses, quality, registry, sharding, simhash
from landmatch.llm.components import components

SENTENCE = "the harbour master kept a careful list of every boat that came in before the storm and counted them twice each night"
ODD = [
    None, "", "   \n\t ", "word", SENTENCE, SENTENCE, SENTENCE + " again", SENTENCE.upper(), "Released under the MIT License.", "# $ % & | < > *",
    "a b c a b c a b c d", "line one\nline one\n\nline two\nline one", " nbsp em", "12345 67890", " ".join([SENTENCE] * 400), "x " * 60_000, "日本語のテキスト", "!!!", None,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_lines string, kept string, score string, shard string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    langs = [None, "en", "de"]
    return spark.createDataFrame([(k, t, langs[k % 3], None, None, "f", "n", "k", "s", "h", None) for k, t in enumerate(ODD)], SCHEMA)


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


# ---- quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def check_quality(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, texts[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_quality_query(spark, small):
    check_quality(registry.op5_quality_rules(spark, small).collect(), texts_of(spark, small))


def test_quality_of_odd_texts(odd):
    judged = quality.judge(quality.measure(odd.drop("kept")))
    check_quality(judged.collect(), dict(enumerate(ODD)))
    assert quality.judge(quality.measure(odd)).columns.count("n_lines") == 1
    assert quality.judge(quality.measure(odd.limit(0))).count() == 0


def test_quality_is_one_projection(odd):
    plan = quality.judge(quality.measure(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- language


def test_language_held_out_accuracy(spark, small):
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op6_language_id(spark, small).collect()
    assert len(rows) == len(labels)
    held = [r for r in rows if r.held_out and labels[r.doc_id] is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_equals_plain_naive_bayes(odd):
    docs = odd.where("doc_id in (4, 5, 7, 8, 10, 11)")
    names, logs = language.train(docs)
    rows = [(r.text, r.lang) for r in docs.collect() if r.lang]
    assert names == sorted({x for _, x in rows})
    counts = {name: Counter(g for t, x in rows if x == name for part in language.grams(t) for g in part.tolist()) for name in names}
    buckets = 1 << language.BITS
    for text in ("the boats", SENTENCE, "Schiffe im Hafen"):
        sums = [
            math.log(sum(x == name for _, x in rows) / len(rows)) + sum(math.log((counts[name][g] + 0.5) / (counts[name].total() + 0.5 * buckets)) for part in language.grams(text) for g in part.tolist())
            for name in names
        ]
        got = language.identify(docs.limit(1).withColumn("text", F.lit(text)), (names, logs)).first()
        odds = np.exp(np.array(sums) - max(sums))
        assert got.lang_pred == names[int(np.argmax(sums))]
        assert got.score == pytest.approx(odds.max() / odds.sum(), abs=1e-3)


@pytest.mark.parametrize("part", [1, 2, 3, 7, 1000])
def test_grams_in_parts(part):
    text = "Straße und ÉTÉ, 日本語 " * 5
    whole = sorted(np.concatenate(list(language.grams(text))).tolist())
    assert sorted(np.concatenate(list(language.grams(text, part))).tolist()) == whole
    assert len(whole) == 3 * (len(text.lower()) + 2) - 3


def test_language_of_odd_texts(odd):
    found = {r.doc_id: r for r in language.identify(odd, language.train(odd)).collect()}
    letters = {k for k, t in enumerate(ODD) if t and any(c.isalpha() for c in t)}
    assert {k for k, r in found.items() if r.lang_pred != "und"} == letters
    assert all(found[k].score == 0 for k in found.keys() - letters)
    none = language.identify(odd, language.train(odd.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


# ---- near-duplicates


def brute_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, texts):
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    groups = Groups()
    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                groups.join(a, b)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == groups.root(r.doc_id)


def test_simhash_query(spark, small):
    check_simhash(registry.op7_simhash(spark, small).collect(), texts_of(spark, small))


def test_simhash_of_odd_texts(odd):
    found = simhash.near_duplicates(odd).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
    check_simhash(found.collect(), dict(enumerate(ODD)))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_links_find_every_pair(spark, block):
    """Random fingerprints with planted partners at 1 to 4 bits, and a dense group that spans several blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, 1 + k % 4, replace=False)) for k, x in enumerate(base)]
    dense = [int(base[0]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for _ in range(120)]
    prints = sorted({*map(int, base), *near, *dense})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    wanted = Groups()
    values = np.array(prints, np.uint64)
    for i, x in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ x) <= 4):
            wanted.join(i, i + 1 + int(j))
    got = Groups()
    at = {s[0]: i for i, s in enumerate(signed)}
    for r in simhash.links(spark.createDataFrame(signed, "fingerprint long"), block=block).collect():
        assert (prints[at[r.a]] ^ prints[at[r.b]]).bit_count() <= 4
        got.join(at[r.a], at[r.b])
    assert [wanted.root(i) for i in range(len(prints))] == [got.root(i) for i in range(len(prints))]


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 300, (200, 2)) if p[0] != p[1]} | {(1000 + k, 1001 + k) for k in range(70)}
    groups = Groups()
    for a, b in pairs:
        groups.join(a, b)
    rows = components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {x: groups.root(x) for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- licences


def brute_licence(text):
    best = []
    wanted = [(name, Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) for name, notice in licenses.TEMPLATES for w in [re.findall("[a-z0-9]+", notice.lower())]]
    split = (text or "").split("\n")
    parts = re.split(r"\n[ \t]*\n", text or "")
    paragraphs = [(-2 - k, p) for k, p in enumerate(parts) if len(parts) > 1 and "\n" in p]
    for line, unit in [*([(-1, text)] if text and len(split) > 1 else []), *paragraphs, *enumerate(split)]:
        words = re.findall("[a-z0-9]+", (unit or "").lower())
        grams = Counter([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words)
        found = [(-2 * (grams & t).total() / (grams.total() + t.total()), name) for name, t in wanted if words]
        if found and min(found)[0] <= -0.8:
            best.append((min(found)[0], min(found)[1], line))
    return len(best), *(min(best)[1:] if best else (None, None))


def test_licence_query(spark, small):
    texts = texts_of(spark, small)
    rows = registry.op8_license_scan(spark, small).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_matches, r.license, r.line) for r in rows} == {k: brute_licence(t) for k, t in texts.items()}


def test_licences_of_odd_texts(odd):
    rows = {r.doc_id: r for r in licenses.licences(odd).collect()}
    assert {k: (r.n_matches, r.license, r.line) for k, r in rows.items()} == {k: brute_licence(t) for k, t in enumerate(ODD)}
    assert rows[8].license == "MIT" and rows[8].dice == 1.0
    assert licenses.licences(odd.limit(0)).count() == 0


def test_licence_texts(spark):
    """Ordinary headers and texts, wrapped over lines and commented, inside longer documents."""
    wrap = lambda text, mark="", width=60: "\n".join(mark + x for x in textwrap.wrap(text, width))
    mit = f"MIT License\n\nCopyright (c) 2024 A. Person\n\n{wrap(licenses.MIT_GRANT)}\n\n{wrap(licenses.MIT_NOTICE)}\n\n{wrap(licenses.MIT_WARRANTY)}"
    texts = {
        0: (mit, "MIT"), 1: (f"import os\nimport sys\n\n{mit}\n\ndef f():\n    pass", "MIT"), 2: (f"#!/bin/sh\n\n{wrap(licenses.APACHE_HEADER, '# ')}\n\necho", "Apache-2.0"),
        3: (f"/* code */\n\n{wrap(licenses.gnu_header(*licenses.GNU['GPL-3.0']), ' * ')}\n\nint main;", "GPL-3.0"), 4: (f"x\n\n{wrap(licenses.BSD_HEAD + ' ' + licenses.BSD_CLAUSES)}\n\ny", "BSD-2-Clause"),
        5: ("Some words about a licence.\nAnd about the software that it covers.\n\nNothing is granted here,\nnothing at all.", None),
        6: ("a\n\nThis work is licensed under the GNU General\nPublic License, version 2.\n\nb", "GPL-2.0"),
    }
    rows = licenses.licences(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in rows} == {k: name for k, (_, name) in texts.items()}
    assert {r.doc_id: r.n_matches for r in rows} == {k: brute_licence(t)[0] for k, (t, _) in texts.items()}


def test_anchors_lose_no_unit():
    """Whatever a unit keeps of a template, at the least Dice coefficient it holds an anchor."""
    marks = licenses.anchors()
    for _, notice in licenses.TEMPLATES:
        words = re.findall("[a-z0-9]+", notice.lower())
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        bare = [g for g in grams if not any(m in w for m in marks for w in g.split())]
        # the best that a unit without an anchor can do: all bare bigrams and no other
        assert 2 * len(bare) / (len(bare) + len(grams)) < licenses.LEAST


def test_licences_of_repeated_keys_ties_and_clashing_columns(spark):
    """Rows of one key are one document; a null key is a key; columns named like outputs are not read."""
    notice = "Released under the MIT License."
    rows = [(1, notice, "x", 7), (1, notice, "y", 8), (1, "no\n" + notice, "z", 9), (None, notice, "n", 1), (2, None, "m", 2), (3, f"{notice}\n{notice}", "t", 3)]
    found = licenses.licences(spark.createDataFrame(rows, "doc_id int, text string, license string, line int")).collect()
    # key 1: the equal rows once, then line 1 and its whole text; key 3: two lines, and a whole text that is no longer like the notice
    assert {r.doc_id: (r.n_matches, r.license, r.line) for r in found} == {1: (3, "MIT", 0), None: (1, "MIT", 0), 2: (0, None, None), 3: (2, "MIT", 0)}
    assert len(found) == 4


def test_whole_licence_texts_of_a_folder(spark, tmp_path):
    """A long text given as a file is found as a whole text and as a paragraph among others, edited a little; half of it is not."""
    rng = np.random.default_rng(5)
    words = [f"clause{n}" for n in rng.integers(0, 900, 4000)]
    (tmp_path / "House-1.0").write_text("\n".join(textwrap.wrap(" ".join(words), 70)))
    templates = licenses.TEMPLATES + licenses.read_templates(spark, str(tmp_path))
    edited = " ".join(w for k, w in enumerate(words) if k % 23)
    texts = {0: "\n".join(textwrap.wrap(edited, 50)), 1: f"a preface of some words\n\n{'\n'.join(textwrap.wrap(edited, 90))}\n\nand an end", 2: " ".join(words[:2000]), 3: "Released under the MIT License."}
    rows = licenses.licences(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), templates=templates).collect()
    assert {r.doc_id: r.license for r in rows} == {0: "House-1.0", 1: "House-1.0", 2: None, 3: "MIT"}


# ---- resharding


def test_transfers_move_the_fewest_bytes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(0, 50, 7).tolist()
        shards = int(rng.integers(1, 9))
        total = sum(sizes)
        capacities = [total // shards + (j < total % shards) for j in range(shards)]
        plan = sharding.transfers(sizes, capacities)
        for i, n in enumerate(sizes):
            assert sum(x for a, _, x in plan if a == i) == n
        for j, n in enumerate(capacities):
            assert sum(x for _, b, x in plan if b == j) <= n
        assert sum(x for a, b, x in plan if a != b) == total - sum(map(min, sizes, capacities))
    with pytest.raises(ValueError):
        sharding.transfers([5], [4])


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    sizes, slots = Counter(), {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sizes[j] for j in range(shards)]


def test_resharding_query(spark, small):
    texts = texts_of(spark, small)
    sizes = check_shards(registry.op9_resharding(spark, small).collect(), texts, 40)
    mean, largest = sum(sizes) / 40, max(len((t or "").encode()) + 16 for t in texts.values())
    assert max(abs(x - mean) for x in sizes) <= largest


def test_resharding_of_odd_texts(odd):
    check_shards(sharding.reshard(odd, F.col("doc_id") % 3, shards=4).collect(), dict(enumerate(ODD)), 4)
    check_shards(sharding.reshard(odd.repartition(6, "doc_id"), F.lit(None).cast("int"), shards=3).collect(), dict(enumerate(ODD)), 3)
    assert sharding.reshard(odd.limit(0), F.lit(0), shards=3).count() == 0


def test_rewrite_touches_only_changed_shards(spark, tmp_path):
    rows = [(k, f"t{k}", 0 if k < 6 else 1 if k < 8 else 2) for k in range(10)]
    folder = str(tmp_path / "shards")
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(folder)
    untouched = sorted(p.name for p in (tmp_path / "shards/shard=2").iterdir())
    moves = spark.createDataFrame([(k, s, 1 if k == 5 else s) for k, _, s in rows], "doc_id long, old_shard int, shard int")
    assert sharding.rewrite(spark, folder, moves) == [0, 1]
    got = {r.doc_id: r.shard for r in spark.read.parquet(folder).collect()}
    assert got == {k: 1 if k == 5 else s for k, _, s in rows}
    assert sorted(p.name for p in (tmp_path / "shards/shard=2").iterdir()) == untouched


def test_rewrite_of_repeated_keys(spark, tmp_path):
    rows = [(1, "a", 0), (1, "b", 0), (1, "b", 0), (1, "c", 1), (None, "n", 0), (2, "z", 2)]
    folder = str(tmp_path / "shards")
    schema = "doc_id long, text string, shard int"
    spark.createDataFrame(rows, schema).write.partitionBy("shard").parquet(folder)
    targets = [1, 1, 0, 1, 2, 2]
    plan = [(k, s, to) for (k, _, s), to in zip(rows, targets, strict=True)]
    moves = lambda rows: spark.createDataFrame(rows, "doc_id long, old_shard int, shard int")
    for wrong in (plan[1:], [*plan, (9, 0, 1)]):
        with pytest.raises(ValueError, match="differ"):
            sharding.rewrite(spark, folder, moves(wrong))
    assert sharding.rewrite(spark, folder, moves(plan)) == [0, 1, 2]
    got = [tuple(r) for r in spark.read.parquet(folder).select("doc_id", "text", "shard").collect()]
    assert sorted(t for _, t, _ in got) == sorted(t for _, t, _ in rows)
    assert sorted((str(k), s) for k, _, s in got) == sorted((str(k), to) for (k, _, _), to in zip(rows, targets, strict=True))


def test_failed_rename_leaves_the_shards(spark, tmp_path, monkeypatch):
    rows = [(k, f"t{k}", k % 3) for k in range(9)]
    folder = str(tmp_path / "shards")
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(folder)
    moves = spark.createDataFrame([(k, s, (s + 1) % 3) for k, _, s in rows], "doc_id long, old_shard int, shard int")
    whole, count = sharding.renamed, [0]

    def failing(files, a, b):
        count[0] += 1
        if count[0] == 4:
            raise OSError("no")
        whole(files, a, b)

    monkeypatch.setattr(sharding, "renamed", failing)
    with pytest.raises(OSError):
        sharding.rewrite(spark, folder, moves)
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(folder).collect()} == {(k, s) for k, _, s in rows}
    assert sharding.rewrite(spark, folder, moves) == [0, 1, 2]
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(folder).collect()} == {(k, (s + 1) % 3) for k, _, s in rows}


# ---- neighbours


def test_neighbours_query_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hits = total = 0
    found = {}
    for r in registry.op2_inverted_multi_index(spark, small).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == {int(i) for i in ids if i % 100 == 0}
    for q, got in found.items():
        got.sort()
        distance = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        order = np.lexsort((ids, distance))
        exact = [int(ids[k]) for k in order if ids[k] != q][:10]
        assert [g[0] for g in got] == list(range(1, 11))
        assert got == sorted(got, key=lambda g: (g[2], g[1]))
        for _, other, score in got:
            assert score == pytest.approx(distance[ids == other][0], rel=1e-12)
        hits += len({g[1] for g in got} & set(exact))
        total += len(exact)
    assert hits >= 0.9 * total


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (100, [1.0, 0.5]), (200, [float("inf"), 0.0]), (300, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 7), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 7)]
    assert ann.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_walk_is_one_number():
    """A walk of most cells is told by where it ends, not by a list of them."""
    random = np.random.default_rng(5)
    books = [random.normal(size=(300, 4)), random.normal(size=(300, 4))]
    cells = np.sort(random.permutation(90_000)[:40_000])
    held = random.integers(1, 4, len(cells))
    for wanted in (1, 44, 39_000, int(held.sum()) - 1):
        scores = ann.cell_scores(random.normal(size=8), books, cells)
        order = np.argsort(scores, kind="stable")
        upto = np.cumsum(held[order])
        assert ann.reach(scores, held, wanted) == scores[order[np.searchsorted(upto, wanted)]]
    assert ann.reach(scores, held, int(held.sum())) == np.inf
    assert ann.reach(np.full(5, 2.0), np.ones(5), 3) == 2.0
    tracemalloc.start()
    ann.reach(scores, held, 60_000)
    assert tracemalloc.get_traced_memory()[1] < 100 * len(cells)
    tracemalloc.stop()


def test_neighbours_meet_in_lots_and_blocks(spark, monkeypatch):
    """Blocks of few vectors, one cell in several blocks, and more queries than a lot: the results are those of brute force."""
    monkeypatch.setattr(ann, "BLOCK", 24)
    monkeypatch.setattr(ann, "LOT", 5)
    random = np.random.default_rng(6)
    v = np.vstack([random.normal(size=(500, 6)), 9 + 1e-4 * random.normal(size=(300, 6))])
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 10 == 0, reached=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == set(range(0, 800, 10))
    hits = 0
    for q, got in found.items():
        distance = np.sqrt(((v - v[q]) ** 2).sum(1))
        exact = [int(i) for i in np.lexsort((np.arange(800), distance)) if i != q][:10]
        assert [s for _, s in got] == [distance[i] for i, _ in got]
        hits += len({i for i, _ in got} & set(exact))
    assert hits >= 0.95 * 800


# ---- pipeline


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, small)
        assert out.dtypes == docs.dtypes, name
        path = corpus_pipeline.shared_folder(spark) + f"/test-{name.replace(' ', '_')}"
        out.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        after = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before and len(after) > 0.4 * len(before)
        if name == "quality rules":
            assert set(after) == {k for k, r in ((r.doc_id, r) for r in quality.judge(quality.measure(docs)).collect()) if r.kept}
        if name == "simhash":
            prints = [brute_fingerprint(r.text) for r in out.collect()]
            values = np.array(prints, np.uint64)
            assert all((np.bitwise_count(values[i + 1 :] ^ x) > 4).all() for i, x in enumerate(values))
        docs = out
    last = {r.doc_id for r in corpus_pipeline.run(spark, small).select("doc_id").collect()}
    assert last == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_of_odd_texts(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() <= len(ODD) * 50
        assert stage(spark, docs.limit(0), "").count() == 0
