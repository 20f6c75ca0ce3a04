"""Spelling variants, the n-gram join and the prefix trie against brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import families, group_join, lsh_forest, prefix_trie, queries, screen, spelling, substring_dedup
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CLASH = ("key", "word", "n", "form", "node", "comp", "conv", "depth", "g", "size", "runs", "base", "h")


def got(df, *columns):
    return sorted(((*r,) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# Words that are near in every way: first and last place, doubled letters, shifts.
_rnd = random.Random(6)
WORDS = ["letters", "leters", "lettters", "etters", "letterse", "lettars", "Letters", "abcde", "abcdef", "bcdef", "été été", "étéétés", "étéétét",
         "aaaaa", "aaaaaa", "aaaaaaa", "x" * 4000, "x" * 4001, "y" + "x" * 4000, "word1word", "naïveté", "naïvete", "ÀÿÀÿÀÿ", "ÀÿÀÿÀ"]
DOCS = [(i, " ".join(_rnd.choices(WORDS, k=60))) for i in range(12)] + [
    (None, "letters letters leters naïveté"), (3, "abcde abcde abcde"), (3, "abcde abcde abcde"), (40, None), (41, ""), (42, "12 %% --")]


@pytest.mark.parametrize("crowd", [1024, 1])
def test_variants_of_odd_words(spark, crowd):
    df = clashing(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3))
    for damage in (97, 3):
        words = spelling.written(spelling.word_counts(df, damage=damage), "words")
        assert got(spelling.variants(words, crowd=crowd)) == want(brute.variants(DOCS, damage))


@pytest.mark.parametrize("crowd", [1024, 4])
def test_variants_of_crowded_chunks(spark, crowd):
    rnd = random.Random(9)
    made = {"station" + "".join(rnd.choices("abcd", k=rnd.randrange(3, 6))) for _ in range(400)} | {"".join(rnd.choices("ab", k=k)) for k in (5, 6, 7, 8) for _ in range(60)}
    docs = [(i, " ".join([w] * rnd.randrange(3, 9))) for i, w in enumerate(sorted(made))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(spelling.variants(spelling.written(spelling.word_counts(df), "words"), crowd=crowd)) == want(brute.variants(docs, 1 << 40))


def test_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.QUERIES["op11_spelling"](spark, SF)) == want(brute.variants(rows))


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 7)
    import re
    text = "one twothree, fourfivesix - é seven" * 3
    pattern = re.compile(spelling.LETTERS)
    assert [w for some in spelling._runs(text, pattern) for w in some] == pattern.findall(text)


def near_texts(n, seed=3):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3])):
            w[rnd.randrange(60)] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(70))
    for i in range(n // 4):
        before, behind = ([f"{c}{i}x{j}" for j in range(rnd.randrange(20))] for c in "uv")
        rows.append((10_000 + i, " ".join([*before, passage, *behind])))
    return rows


ODD_TEXTS = [(None, "w1 w2 w3 w4 w5"), (None, None), (20_000, None), (20_001, ""), (20_002, "one"), (20_003, "One"), (20_004, "one two three"),
             (6, "quite another text of a key that is there"), (20_005, "z " * 9000), (20_006, "z " * 9001)]


@pytest.mark.parametrize(("group", "walked", "chunk"), [(64, 16, 2048), (4, 2, 40)])
def test_group_join(spark, monkeypatch, group, walked, chunk):
    rows = near_texts(300)
    rows += ODD_TEXTS + rows[5:8]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(group_join, "GROUP", group), monkeypatch.setattr(group_join, "WALKED", walked), monkeypatch.setattr(families, "CHUNK_NODES", chunk)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got(group_join.near_sets(df)) == want(brute.near_sets(rows, 4, 85))


def test_group_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.QUERIES["op12_group_join"](spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and got(out) == want(brute.near_sets(rows, 4, 85))


def test_screen_lets_few_others_through(spark):
    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "key")
    held = screen.bitmap(keys.select(F.xxhash64("key").alias("hash"))).value
    hashes = [r["h"] for r in spark.range(40_000).select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()]
    maybe = screen.marked(held, np.array(hashes))
    assert maybe[:4000:2].all() and maybe[1:4000:2].mean() < 0.05 and maybe[4000:].mean() < 0.05
    asked = spark.range(40_000).select(F.when(F.col("id") != 8, F.col("id")).alias("id"))
    kept = {r["id"] for r in asked.where(screen.may_be_among(F.col("id"), keys)).collect()}
    assert None not in kept and kept == {i for i in np.flatnonzero(maybe).tolist() if i != 8}
    assert asked.where(screen.may_be_among(F.col("id"), keys.limit(0))).count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    # Joins get the texts that may go or lose words, and the rest passes them by.
    rnd = random.Random(4)
    rows = [(i, " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(60))) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(10)] + [(None, rows[20][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (lsh_forest.keep_one(df, percent=80), substring_dedup.remove(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "ArrowEvalPython" in plan
        assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == set(range(3000))


def test_walk_compares_neighbours_that_keep_meeting(spark):
    # Sets of 200 tokens link with 15 shared rows at least; a common word is one row.
    rows = [(t, g, 200, 200, 2) for t in range(15) for g in (1, 2)] + [(t, t, 200, 200, 20) for t in range(20, 40)]
    rows = [(40 if t >= 20 else t, g, low, high, n) for t, g, low, high, n in rows]
    matrix = spark.createDataFrame(rows, "token long, g long, low long, high long, groups long")
    assert got(group_join._walk(matrix, None, 0, 85)) == [(1, 2)]


@pytest.mark.parametrize("crowded", [False, True])
def test_least_rows_are_of_the_sizes_that_may_link(spark, crowded):
    # Group 1 has sets of 100 and 200 tokens; that of 100 links with group 2's of 110.
    rows = [(t, 1, 100, 200 if t else 100) for t in range(8)] + [(t, 2, 110, 110) for t in range(8)] + [(9, 1, 200, 200), (9, 3, 200, 200)]
    matrix = spark.createDataFrame(rows, "token long, g long, low long, high long")
    some = spark.createDataFrame([(t, 2) for t in range(4)], "token long, groups long") if crowded else None
    found = group_join._rest(matrix, some, None, 85)
    assert got(found) == [(1, 2)] and (crowded or "Join" not in found._jdf.queryExecution().optimizedPlan().toString())


def test_a_common_passage_brings_no_sets_together(spark, monkeypatch):
    # Five of the 57 shingles of a text are common, and one of those is the smallest of 300.
    rnd = random.Random(8)
    rows = [(i, " ".join([*(f"o{rnd.randrange(10 ** 9)}" for _ in range(52)), *(f"d{j}" for j in range(8))])) for i in range(600)]
    rows += [(1000 + i, text.replace("d7", "d8")) for i, text in rows[:4]]
    placed, real = [], families.chunked
    monkeypatch.setattr(families, "chunked", lambda df: placed.append(real(df).count()) or real(df))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(group_join.near_sets(df)) == want(brute.near_sets(rows, 4, 85)) and 8 <= placed[0] < 25


def test_counts_of_cells_are_handed_out_small():
    counts = np.random.default_rng(5).poisson(4, 1 << 16)
    counts[7] = (1 << 32) - 1
    held = group_join._packed(counts)
    assert (group_join._unpacked(held) == counts).all() and len(held) < counts.size


def test_smaller_group_asks_the_larger(spark):
    probe = bytearray(np.arange(10, dtype="<u4").tobytes())
    groups = spark.createDataFrame(
        [(1, [(10, probe, 1 << 32), (11, probe, 1 << 32)]), (2, [(10, probe, 1 << 32)]), (3, [(10, bytearray(np.arange(50, 60, dtype="<u4").tobytes()), 1 << 32)])],
        "g long, members array<struct<n long, probe binary, reach long>>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert got(group_join._qualified(pairs, groups, 85)) == [(2, 1)]


def test_joined_sets():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        sets = [np.unique(rnd.integers(0, 30, rnd.integers(1, 25))).astype(np.uint64) for _ in range(40)]
        start, percent = rnd.integers(0, 35, 40), int(rnd.integers(20, 101))
        head = families.joined(sets, start, percent)
        up = list(start)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up = [up[i] if x == up[j] else x for x in up]
        assert [[x == y for y in head] for x in head] == [[x == y for y in up] for x in up]


def test_group_pairs_stay_linear_in_a_group_of_copies(spark, monkeypatch):
    # Near copies of one text: what has come together is not paired again.
    pairs = []
    real = group_join._qualified
    monkeypatch.setattr(group_join, "_qualified", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    monkeypatch.setattr(group_join, "GROUP", 4)
    for n in (200, 400):
        rows = [(i, " ".join(f"w{j}" if j != i % 150 else f"e{i}" for j in range(150))) for i in range(n)]
        out = group_join.near_sets(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["component_id"] for r in out.collect()} == {0}
    assert sum(pairs[3:]) <= 3 * sum(pairs[:3])


def turns(seed=5):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "é", None, "ccc "]))
            for c in [*range(60), 100, 101, 205, -3, -150, None] for t in range(rnd.randrange(9))]
    rows += [(7, 1, "user", "a")] * 30
    return rows + [(c, i, "u", f"t{i % 3}") for c, n in ((900, 50), (901, 50), (902, 37)) for i in range(n)]


def lent(c):
    return c - int(math.fmod(c, 100)), zlib.crc32(str(c).encode()) % 6


def lending():
    return {"base": F.expr("conv - conv % 100"), "head": F.crc32(F.col("conv").cast("string").cast("binary")) % 6, "most_head": 5}


@pytest.mark.parametrize(("run", "parts"), [(4096, 1), (4, 3), (7, 5)])
def test_trie(spark, run, parts):
    rows = turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    df = df.withColumns({c: F.lit("x") for c in CLASH})
    assert got(prefix_trie.trie(df, **lending(), run=run)) == want(brute.trie(rows, lent))
    assert got(prefix_trie.trie(df, run=run)) == want(brute.trie(rows))


def test_trie_with_a_crowded_sketch(spark):
    # Eight cells a row prove nothing; everything is grouped, with the same result.
    rows = turns(8)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(prefix_trie.trie(df, most_bits=3, **lending())) == want(brute.trie(rows, lent))


def test_sketch_never_counts_too_little():
    rnd = np.random.default_rng(4)
    digests = rnd.integers(0, 1 << 62, (5000, 2)).astype(np.uint64)
    for row in prefix_trie._cells(digests, 16):
        assert row.min() >= 0 and row.max() < 1 << 16
    assert all((a == b).all() for a, b in zip(prefix_trie._cells(digests, 16), prefix_trie._cells(digests.copy(), 16), strict=True))


def test_trie_query(spark):
    rows = [(*r,) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op13_prefix_trie"](spark, SF)) == want(brute.trie(rows, lent))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs, damage=97).count() == 0 and group_join.near_sets(docs).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), **lending()).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert spelling.spelling_variants(nothing).count() == 0
    assert got(group_join.near_sets(nothing)) == want([(1, 0, 1), (None, 0, None)])
