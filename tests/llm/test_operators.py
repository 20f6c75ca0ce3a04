"""Every operator against brute force, on odd rows and on the smallest table."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from siftline.llm import (
    ann, families, huffman, lsh_forest, mixing, prefix_bpe, quality, queries, sharding, substring_dedup, token_counts, token_files,
    toxicity, vocabulary, words,
)
from tests.llm import brute

SF = "/root/testdata/sf0.001"
_rnd = random.Random(4)
LONG = " ".join(_rnd.choice("alpha beta gamma delta the of idiot réeux 12 % été".split()) + str(_rnd.randrange(400)) for _ in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
NEAR = [f"w{i}" for i in range(120)]
TEXTS = [
    None, "", " \n\t ", "one", "two words", LONG, LONG, PASSAGE, "Before it " + PASSAGE + " behind", PASSAGE.replace(" ", "\n"),
    " ".join(NEAR), " ".join([*NEAR[:60], "changed", *NEAR[61:]]), " ".join(NEAR).upper(), "a b c d e " * 40, "line x\nline x\n\n y <|endoftext|> z",
    "日本語 текст ünï ﬀ ́ <|startoftext|> don't  stop here\x1cnow \r\n", "%%% ### a|b <c> $5", "x" * 5000, "'s 'T we'LL I'd  9999 ½", PASSAGE + " " + PASSAGE,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null ids and sources, a repeated row, columns with clashing names."""
    rows = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(None, PASSAGE, None, "b"), (5, LONG, "en", None), (3, "one", None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    more = ("size", "key", "node", "comp", "kept", "words", "ids", "doc", "n", "_size", "shard", "start")
    return df.withColumns({c: F.lit("x") for c in more}).repartition(3), rows


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


@pytest.fixture(params=["odd", "small"])
def case(request):
    return request.getfixturevalue(request.param)


def got(df, *columns):
    return sorted(((*r,) for r in df.select(*columns).collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


def test_token_counts(case):
    df, rows = case
    t = vocabulary.tokenizer(vocabulary.path("byte_bpe_50k.json"))
    expected = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in rows]
    assert got(token_counts.count_tokens(df), "doc_id", "n_bytes", "n_tokens", "over_limit") == want(expected)
    # Nothing is common: everything takes the join. Long pre-tokens are as good as others.
    assert got(token_counts.count_tokens(df, hot=0), "doc_id", "n_bytes", "n_tokens", "over_limit") == want(expected)


def test_byte_bpe(case):
    df, rows = case
    own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, special_tokens={},
                            mergeable_ranks=vocabulary.ranks(vocabulary.path("byte_bpe_50k.tiktoken")))
    ids = [(i, x or "", own.encode_ordinary(x or "")) for i, x, *_ in rows]
    expected = [(i, len(n), hashlib.sha256(" ".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, x, n in ids]
    assert got(prefix_bpe.digests(df), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(expected)
    for docs in (df.drop("ids"), df.withColumns({"ids": F.lit("x"), "_text": F.lit("y"), "row": F.lit(1), "made": F.lit(2)})):
        kept = prefix_bpe.encode(docs)
        assert got(kept, "doc_id", "ids") == want((i, n) for i, _, n in ids)
        assert kept.columns == [*[c for c in docs.columns if c != "ids"], "ids"]


def test_prefix_table_follows_appends_and_edits():
    e, rnd = prefix_bpe.encoder(vocabulary.path("byte_bpe_50k.tiktoken")), random.Random(2)
    for _ in range(40):
        data = bytearray(rnd.choices(b"theinaouysrlg ", k=500))
        t = prefix_bpe.EditableText(e, bytes(data[:200]))
        t.append(bytes(data[200:]))
        assert t.ids() == e.ids(bytes(data)) and e.decode(t.ids()) == bytes(data)
        a, new = rnd.randrange(400), bytes(rnd.choices(b"xzing", k=rnd.randrange(6)))
        again = t.replace(a, a + 3, new)
        data[a:a + 3] = new
        assert t.ids() == e.ids(bytes(data)) and again <= len(data) - a


def test_token_files(case, spark, tmp_path):
    df, rows = case
    t = vocabulary.tokenizer(vocabulary.path("word_bpe_49k.json"))
    token_files.write(df, str(tmp_path / "f"))
    back = [(r["key"], r["start"], r["n_tokens"], r["ids"]) for r in token_files.read(spark, str(tmp_path / "f")).collect()]
    assert want((k, ids) for k, *_, ids in back) == want((i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, *_ in rows)
    at = 0
    for k, start, n, _ in sorted(back, key=lambda r: r[1]):
        assert start == at
        at += n
    keys = [k for k, *_ in sorted(back, key=lambda r: r[1]) if k is not None]
    assert keys == sorted(keys)
    digests = {(r["start"], r["ids_crc32"]) for r in token_files.read(spark, str(tmp_path / "f"), digest=True).collect()}
    assert digests == {(s, brute.crc(ids)) for _, s, _, ids in back}


def test_huffman_codes_are_short_enough_and_decode():
    rnd = np.random.default_rng(1)
    for counts in (np.array([0, 0, 7]), np.array([1, 1]), 2 ** np.arange(40), rnd.integers(0, 1000, 5000), np.ones(70_000, int)):
        lengths = huffman.code_lengths(counts)
        used = lengths[counts > 0].astype(float)
        assert (lengths[counts == 0] == 0).all() and used.max() <= 17 and (2.0 ** -used).sum() <= 1
        ids = rnd.choice(np.flatnonzero(counts), 1000)
        code = huffman.Code(lengths)
        bits, offsets = code.encode(ids)
        assert (code.decode(bits, offsets, len(ids)) == ids).all()


def test_shards(case):
    df, rows = case
    out = sharding.with_slots(sharding.assign_shards(df)).collect()
    assert want((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want(
        (i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, *_ in rows)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({r["doc_id"] for r in out})


def test_shards_follow_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = {r["s"]: r["count"] for r in df.groupBy(sharding.shard_of(F.col("doc_id"), (1, 2, 0, 5)).alias("s")).count().collect()}
    assert set(n) == {0, 1, 3} and all(abs(n[s] - 2500 * w) < 300 for s, w in ((0, 1), (1, 2), (3, 5)))


def test_mix(case):
    df, rows = case
    out = mixing.mix(df).collect()
    sizes = {}
    for _, x, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(x))
    expected = brute.targets(sizes)
    assert want((r["doc_id"], r["size"]) for r in out) == want((i, len(brute.words(x))) for i, x, *_ in rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in out)
    source = {(i, len(brute.words(x))): s for i, x, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], expected[s], abs_tol=1e-6)
    largest = max(len(brute.words(x)) for _, x, *_ in rows)
    assert all(abs(taken[s] - expected[s]) <= largest for s in sizes)
    assert got(mixing.mix(df.repartition(5)), "doc_id", "taken") == got(mixing.mix(df), "doc_id", "taken")
    whole = sum(r["taken"] // r["size"] for r in out if r["size"])
    assert mixing.take(df).count() == whole and mixing.take(df).columns == df.columns


def test_flow_repeats_only_where_needed():
    # A shared pattern serves the source that has little of its own.
    flow = mixing.route({("a",): 10, ("b",): 100, ("a", "b"): 50}, {"a": 60.0, "b": 100.0})
    assert flow == {("a",): 10, ("b",): 100, ("a", "b"): 50}
    flow = mixing.route({("a",): 10, ("b",): 10}, {"a": 25.0, "b": 5.0})
    assert flow == {("a",): 25, ("b",): 5}


def test_quality(case):
    df, rows = case
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality.verdicts(df)
    assert got(out, *names) == want((i, *brute.quality_base(x)) for i, x, *_ in rows)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and got(kept, "doc_id") == got(out.where("kept"), "doc_id")
    assert out.where("kept and base_failed").count() == 0


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.verdicts(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows) and {r["kept"] for r in rows} == {True, False}


def least_determinant(x, starts=40):
    """The covariance estimate of a group, from many random starts, with exact
    distances; (mean, covariance)."""
    rnd, best = np.random.default_rng(5), None
    for _ in range(starts):
        some = rnd.choice(len(x), 8, replace=False)
        mean, cov = x[some].mean(axis=0), np.cov(x[some].T, bias=True) + np.diag(np.square(quality.FLOORS))
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(quality.SUPPORT * len(x)))]]
            mean, cov = near.mean(axis=0), quality._CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(quality.FLOORS))
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), mean, cov
    return best[1:]


@pytest.mark.parametrize("far", [[0.8, 0, 0, 0], [-0.7, 0, 0, 0], [0.5, 0.3, 0.4, 0.3], [0, 0, 0.9, 0]])
def test_quality_finds_the_least_determinant(spark, far):
    rnd = np.random.default_rng(8)
    x = np.abs(rnd.normal(size=(600, 4)) * [0.05, 0.02, 0.05, 0.03] + [1.6, 0, 0, 0])
    # Nearly a quarter lies close together, far from the rest.
    x[:140] = [1.6, 0, 0, 0] + np.array(far) + rnd.normal(size=(140, 4)) * 0.01
    stats = spark.createDataFrame([(i, "g", "l", False, *map(float, r)) for i, r in enumerate(x)],
                                  "key int, g0 string, g1 string, base_failed boolean, x0 double, x1 double, x2 double, x3 double")
    out = {r["key"]: r for r in quality.judge(stats, quality.fit(stats)).collect()}
    mean, cov = least_determinant(x)
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    sure = np.abs(np.log(d / quality.CUTOFF)) > 0.15
    assert sure.mean() > 0.97 and not any(out[i]["kept"] for i in range(140))
    assert all(out[i]["kept"] == (d[i] <= quality.CUTOFF) for i in np.flatnonzero(sure).tolist())


def test_quality_rejects_outliers_of_each_statistic(spark):
    def own(i, n):
        return [f"word{i * 1000 + k:06d}" for k in range(n)]
    texts = {i: "\n".join(" ".join(own(10 * i + k, 8)) for k in range(10)) for i in range(100)}
    texts["long words"] = " ".join(w * 3 for w in own(2001, 80))
    texts["symbols"] = " ".join(w + "#$" for w in own(2002, 80))
    texts["lines"] = "\n".join("yes\nno\n" + " ".join(own(2003 + k, 3)) for k in range(30))
    texts["phrases"] = " ".join([*own(2040, 45), *own(2041, 55), *own(2040, 45), *own(2042, 55)])
    texts["one phrase"] = " ".join([*own(2050, 6), *own(2051, 54), *own(2050, 6), *own(2052, 54)])
    rows = [(str(i), t, "en", "a") for i, t in texts.items()]
    out = quality.verdicts(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == {"long words", "symbols", "lines", "phrases"}


def test_near_duplicates(case):
    df, rows = case
    own = {(r[0], r[1]) for r in rows}
    expected = brute.near(sorted(own, key=repr), 85)
    out = lsh_forest.near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    kept = lsh_forest.keep_one(df)
    assert kept.columns == df.columns
    # One row of each; the text of the row without a key is kept with one.
    assert got(kept, "doc_id") == want({(r["doc_id"],) for r in out if r["kept"] and r["doc_id"] is not None})


def test_near_duplicates_with_tiny_regions_and_chunks(spark, monkeypatch):
    rnd = random.Random(3)
    base, rows = [f"b{i}" for i in range(90)], []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(90)] = f"e{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    expected = brute.near(rows, 85)
    monkeypatch.setattr(lsh_forest, "DENSE", 8), monkeypatch.setattr(families, "CHUNK_NODES", 20)
    out = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected


def test_one_row_of_each_document_stays(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "A b c d e f", 3), (None, "a b c d e f", 4), (None, "q r s", 5),
            (None, "q r s", 5), (None, None, 6), (3, None, 7), (4, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept_key int").withColumns({c: F.lit("x") for c in ("id", "row", "digest", "n")})
    kept = lsh_forest.keep_one(df)
    assert kept.columns == df.columns
    assert got(kept, "doc_id", "text") == want([(1, "a b c d e f"), (None, "q r s"), (3, None), (4, "")])


def test_share_of_missed_pairs():
    # Sets that agree in each of the hashes by chance, as often as they are similar.
    rnd = np.random.default_rng(1)
    same = rnd.random((4000, lsh_forest.HASHES)) < 0.7
    for trees in (5, 20):
        met = same[:, lsh_forest._PATHS[:trees]].all(axis=2).any(axis=1)
        assert abs((~met).mean() - lsh_forest.missed(70, trees)) < 0.03
    assert all(lsh_forest.missed(p, lsh_forest.trees_for(p)) <= 1e-6 for p in (80, 85, 95))


@pytest.mark.parametrize("hot", [4096, 0])
def test_substrings(case, hot):
    df, rows = case
    expected = brute.windows_removed([r[:2] for r in rows], 50)
    out = substring_dedup.removals(df, hot_spans=hot)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(expected)
    left = substring_dedup.remove(df)
    assert left.columns == df.columns
    emptied = {(i, n) for i, n, gone, _ in expected if n and gone == n}
    assert left.count() == sum((i, n) not in emptied for i, n, *_ in expected)
    sums = {(i, s) for i, _, _, s in expected}
    assert all((r["doc_id"], hashlib.sha256(b" ".join(brute.words(r["text"]))).hexdigest()) in sums for r in left.collect())


class Bounded(substring_dedup.Automaton):
    def __init__(self, sequences, owners):
        assert len(sequences) <= 20
        super().__init__(sequences, owners)


@pytest.mark.parametrize("hot", [8, 30])
def test_substrings_of_a_passage_in_many_documents(spark, monkeypatch, hot):
    # No task may hold the spans of all documents, which run into their own words.
    def own(i, n):
        return [f"own{i}x{k}" for k in range(n)]
    rows = [(i, " ".join([*own(i, 60), *PASSAGE.split()[:70 - i % 3], *own(-i, 60)])) for i in range(80)]
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 64), monkeypatch.setattr(substring_dedup, "Automaton", Bounded)
    out = substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot_spans=hot)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.windows_removed(rows, 50))


def test_shards_come_row_by_row(spark, monkeypatch):
    # A shard that is one row would be whole in the JVM's memory and in a batch.
    given, real = {}, substring_dedup.arrow_map
    monkeypatch.setattr(substring_dedup, "arrow_map", lambda df, fn, schema, **more: given.update({str(schema): df.schema.simpleString()}) or real(df, fn, schema, **more))
    rows = [(i, " ".join([f"own{i}", PASSAGE, f"own{-i}"])) for i in range(4)]
    out = substring_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want(brute.windows_removed(rows, 50))
    assert "array" not in given["span binary, owners array<bigint>"]


def test_automaton_owners():
    rnd = random.Random(5)
    docs = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 40))] for _ in range(12)]
    a = substring_dedup.Automaton(docs, list(range(12)))
    for d in docs:
        expected = [next(o for o, e in enumerate(docs) if any(e[j:j + 4] == d[i:i + 4] for j in range(len(e) - 3))) for i in range(len(d) - 3)]
        assert a.first_owners(d, 4) == expected


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 8)) * rnd.uniform(0.5, 2, (300, 1))
    v[100:180] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [float("nan")]), (303, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "list": F.lit(2)})
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, search_ratio=9.0).collect()
    expected = brute.nearest(rows, 20)
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in expected.items()}
    assert all(math.isclose(a[1], b[1], abs_tol=1e-12) for q in found for a, b in zip(found[q], expected[q]))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_walk_finds_the_lists_among_thousands():
    rnd = np.random.default_rng(6)
    centers = rnd.normal(size=(60, 24))
    centroids = centers[rnd.integers(0, 60, 4000)] + 0.4 * rnd.normal(size=(4000, 24))
    graph = ann.CentroidGraph(centroids)
    hits = 0
    for v in centroids[:200] + 0.3 * rnd.normal(size=(200, 24)):
        d = np.sqrt(((centroids - v) ** 2).sum(axis=1))
        wanted = set(np.flatnonzero(d <= ann.SEARCH_RATIO * d.min()).tolist())
        hits += wanted <= set(graph.within(v, ann.SEARCH_RATIO)[0].tolist())
        found, _ = graph.within(v, ann.SEARCH_RATIO, 10)
        assert len(found) >= 10 and found[0] == d.argmin()
    assert hits >= 198


def test_walks_go_side_by_side(monkeypatch):
    rnd = np.random.default_rng(7)
    centroids = rnd.normal(size=(300, 12))
    graph, walks = ann.CentroidGraph(centroids), []
    monkeypatch.setattr(ann, "_WALKED", 300 * 150)
    real = ann.CentroidGraph._walk
    monkeypatch.setattr(ann.CentroidGraph, "_walk", lambda self, vs, *a: walks.append(len(vs)) or real(self, vs, *a))
    vs = np.concatenate([rnd.normal(size=(398, 12)), centroids[:2]])
    d = np.sqrt(((vs[:, None] - centroids[None]) ** 2).sum(axis=2))
    for ratio, least in ((1.2, 1), (1.0, 5), (1.1, 400)):
        rows, found, dist = graph.within_all(vs, ratio, least)
        assert np.allclose(dist, d[rows, found]) and (np.diff(rows) >= 0).all() and (np.diff(dist)[np.diff(rows) == 0] >= 0).all()
        bound = np.maximum(ratio * d.min(axis=1) + 1e-12, np.sort(d, axis=1)[:, min(least, 300) - 1])
        assert len(found) >= 0.99 * (d <= bound[:, None]).sum()
    # A task's rows in a few walks, not each in one of its own.
    assert walks == [150, 150, 100] * 3 and len(graph.within_all(vs[:0], 1.1)[0]) == 0


def test_floor_of_a_question_keeps_its_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "_CUT", 64)
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.integers(-2, 3, (400, 4)))]
    rows = [(i, v) for i, v in rows if any(v)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, search_ratio=99.0, per_list=16)
    found = {}
    for r in out.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, hits in found.items():
        own = dict(rows)[q]
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in rows if i != q)[:20]
        assert sorted(hits) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert len(found) >= 19


def test_nearest_recall_with_many_small_lists(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    expected = brute.nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, per_list=16).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert all(len(found[q]) == 20 for q in expected)
    assert sum(len(found[q] & {i for i, _ in x}) / 20 for q, x in expected.items()) / len(expected) >= 0.9


def test_nearest_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    expected = brute.nearest(rows, 20)
    found = {}
    for r in queries.QUERIES["op1_nearest"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(found[q] & {i for i, _ in x}) / 20 for q, x in expected.items()]
    assert sum(hits) / len(hits) >= 0.9


def test_toxicity(spark, odd):
    out = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.8 * len(toxic) and sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out.select("doc_id", "held_out").collect())
    df, rows = odd
    model = toxicity.Model(["you idiot"] * 9 + ["fine day"] * 9, [1] * 9 + [0] * 9)
    scores = toxicity.score(df, model).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.words("Such an i-d.i_o*t and s c u m!") == ["such", "an", "idiot", "and", "scum"]
    empty = toxicity.fit(df, df.where("false").withColumn("toxic", F.lit(1)))
    assert {r["score"] for r in toxicity.score(df, empty).collect()} == {0.0}


@pytest.mark.parametrize("long", [(0, 1), (1, 1), (1, 60)])
def test_toxicity_sample_survives_long_texts(spark, long):
    label, n = long
    ids = spark.range(120).select("id", F.xxhash64(F.lit("fit"), "id").alias("h")).orderBy("h").collect()
    of_class = [r["id"] for r in ids if r["id"] % 2 == label]
    texts = {i: f"you {['idiot', 'idiots'][i % 4 // 2]} number {i}. " if i % 2 else f"a fine day number {i}. " for i in range(120)}
    for i in of_class[:n]:
        texts[i] = texts[i] * 2000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), most_bytes=40_000)
    assert model.curve is not None
    new = spark.createDataFrame([(0, "such a fine day"), (1, "what an idiot you are")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert scores[1] > 0.5 > scores[0]


def test_toxicity_spread():
    text = "".join(f"Sentence number {i} is here. " for i in range(5000))
    some = toxicity.spread(text, 4000)
    assert 2500 < len(some.encode()) <= 4000 and toxicity.spread("short.", 100) == "short."
    numbers = [int(x) for x in some.split() if x.isdigit()]
    assert numbers == sorted(numbers) and numbers[0] < 500 and numbers[-1] > 4500
    assert 2500 < len(toxicity.spread("word " * 9000, 4000).encode()) <= 4000


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert token_counts.count_tokens(df).count() == 0 and sharding.with_slots(sharding.assign_shards(df)).count() == 0
    assert prefix_bpe.digests(df).count() == 0 and mixing.mix(df).count() == 0 and mixing.take(df).count() == 0
    assert quality.verdicts(df).count() == 0 and lsh_forest.near_duplicates(df).count() == 0 and substring_dedup.removals(df).count() == 0


def test_empty_token_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(df, str(tmp_path / "f"))
    assert token_files.read(spark, str(tmp_path / "f")).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    texts = [(t or "").encode() for t in TEXTS]
    seen = {}
    for _, some in words.runs(texts, 3000):
        w = words.words_of(some)
        for i, t in enumerate(some):
            for word, h in zip(brute.WORD.findall(t), w.hashes[w.first[i]:w.first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
