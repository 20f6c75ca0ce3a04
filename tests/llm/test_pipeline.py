"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import quality, vocabulary
from siftline.llm.common import table, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"
_rnd = random.Random(11)
BASE = [f"word{i:03d}" for i in range(150)]
CLEAN = [" ".join(f"own{i}n{k}" for k in range(120)) for i in range(12)]
ODD = [(i, t, "en", "a") for i, t in enumerate(CLEAN)]
ODD += [(20, " ".join(BASE), "en", "a"), (21, " ".join(BASE), "en", "a"), (22, " ".join([*BASE[:70], "changed", *BASE[71:]]), "en", "a"), (20, " ".join(BASE), "en", "a"),
        (23, CLEAN[0] + " " + " ".join(BASE[:60]) + " tail of its own " * 2, "en", "a"),
        (30, None, None, None), (31, "", "en", None), (32, " \n ", "en", "b"), (None, CLEAN[1], "en", "a"), (None, CLEAN[1], "en", "a"),
        (None, " ".join(f"lone{k}" for k in range(90)), "en", "a"), (33, "x" * 30_000, "en", "b"), (34, " ".join(_rnd.choices(BASE, k=9000)), "en", "b")]


@pytest.fixture(params=["small", "odd", "empty"])
def docs(request, spark):
    if request.param == "small":
        return table(spark, SF, "documents")
    df = spark.createDataFrame(ODD if request.param == "odd" else [], "doc_id long, text string, lang string, source string")
    more = ("_text", "_kept_key", "ids_", "row", "id", "g", "n", "size", "comp", "made", "digest", "key")
    return df.withColumns({c: F.lit("x") for c in more}).repartition(3)


def test_stages(spark, docs):
    columns, inputs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(written(stage(spark, inputs[-1], SF), name))
    raw, good, single, cut, mixed, tokens = [[r.asDict() for r in d.collect()] for d in inputs]
    assert all(d.columns == columns for d in inputs[:-1]) and inputs[-1].columns == [*columns, "ids"]

    # Quality: the rows of the verdict stay, repeated ones with them.
    kept = [r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()]
    assert sorted((r["doc_id"] for r in good), key=repr) == sorted(kept, key=repr)

    # Near duplicates: one row of each group; of rows without a key one of each text.
    known = {(r["doc_id"], r["text"]) for r in good if r["doc_id"] is not None}
    near = brute.near(sorted(known), 80)
    lone = {r["text"] for r in good if r["doc_id"] is None} - {t for _, t in known}
    expected = [i for i, (_, c) in near.items() if i == c] + [None] * len(lone)
    assert sorted((r["doc_id"] for r in single), key=repr) == sorted(expected, key=repr)

    removed = {(i, n): (gone, sha) for i, n, gone, sha in brute.windows_removed([(r["doc_id"], r["text"]) for r in single], 50)}
    left = {(i, sha) for (i, n), (gone, sha) in removed.items() if gone < n or n == 0}
    assert {(r["doc_id"], hashlib.sha256(b" ".join(brute.words(r["text"]))).hexdigest()) for r in cut} == left

    texts = {(r["doc_id"], r["text"]) for r in cut}
    assert all((r["doc_id"], r["text"]) in texts for r in mixed)
    own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, special_tokens={}, mergeable_ranks=vocabulary.ranks(vocabulary.path("byte_bpe_50k.tiktoken")))
    assert sorted(((r["doc_id"], r["text"], tuple(r["ids"])) for r in tokens), key=repr) == sorted(
        ((r["doc_id"], r["text"], tuple(own.encode_ordinary(r["text"] or ""))) for r in mixed), key=repr)
