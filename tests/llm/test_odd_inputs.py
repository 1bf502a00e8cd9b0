"""Very long texts, nulls in every column, repeated rows and clashing names, for every operator."""

import random

import pyarrow as pa
import pytest

from fathomry.llm import chat_format, ctw, decontaminate, jaccard_join, packing, quality_rules, sharding, substring_dedup, toxicity, weak_labels
from fathomry.llm.registry import tokenizer_path

LONG = " ".join(f"w{random.Random(i).randint(0, 9999)}" + ("." if i % 9 == 8 else "") + ("\n" if i % 97 == 96 else "") for i in range(25_000))
ROWS = [(1, LONG, "a", 1), (1, LONG, "a", 1), (2, LONG + " tail", None, None), (None, None, None, None), (3, "", "b", 2), (None, "x", None, 3), (4, "a" * 200_000, "c", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that clash with what the operators add."""
    return spark.createDataFrame([(d, t, s, n, n, s, n, s, n) for d, t, s, n in ROWS], "doc_id long, text string, item string, score int, shard int, component string, h int, repeats string, D int")


def test_row_operators_keep_every_row(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, " ".join(LONG.split()[100:130]))], "item_id long, text string")
    for out in (
        ctw.score(docs),
        jaccard_join.jaccard_join(docs),
        weak_labels.classify(docs),
        quality_rules.quality_rules(docs),
        toxicity.classify(docs, labels),
        sharding.shard(docs),
        decontaminate.digest(decontaminate.scan(docs, bench)),
        substring_dedup.report(docs),
    ):
        assert out.count() == len(ROWS)
    hit = {r["doc_id"] for r in decontaminate.digest(decontaminate.scan(docs, bench)).where("contaminated").collect()}
    assert hit == {1, 2}


def test_filters_keep_the_columns(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.reject(docs, none).collect() == docs.collect()
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None", "None"]
    cut = {(r["doc_id"], len(r["text"] or "")) for r in substring_dedup.deduplicate(docs).collect()}
    assert (1, len(LONG)) in cut and max(n for d, n in cut if d == 2) < 2000


def test_packing_of_long_texts(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, None} and all(0 < r["length"] <= 2048 for r in rows)


def test_chat_nulls_and_long_turns(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 0, "user", LONG), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.windows(df)).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2 * len(LONG) and out[None]["n_turns"] == 1


def test_a_repetitive_long_text_is_linear():
    t = "same words again " * 8000
    got = quality_rules.measure(pa.array([1], pa.int64()), pa.array([t]), quality_rules.Limits()).to_pylist()[0]
    assert got["n_words"] == 24_000 and got["n_repeat_words"] == 24_000 and got["longest_repeat"] == 24_000 - 3 and not got["kept"]
