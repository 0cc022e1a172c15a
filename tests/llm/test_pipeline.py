from collections import Counter

import pytest

import corpus_pipeline
from oddrows.llm import neardup, packing, suffixes
from tests.llm.conftest import SMALL
from tests.llm.test_neardup import brute_classes
from tests.llm.test_packing import check_layout
from tests.llm.test_suffixes import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.materialize(stage(spark, docs, SMALL))
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(stages, small):
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"]
    assert all(after.columns == small.columns for name, (_, after) in stages.items() if name != "packing")


def test_toxic_documents_go_and_clean_stay(spark):
    folder = SMALL.replace("0.001", "0.01")  # the smallest table has too few labels to learn from
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    clean, bad = [i for i, y in labels.items() if not y], [i for i, y in labels.items() if y]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and sum(i in kept for i in bad) <= 0.5 * len(bad)


def test_one_of_each_class_stays(stages):
    before, after = stages["near_dedup"]
    rows = [tuple(r) for r in before.select("doc_id", neardup.normal()).collect()]
    want = brute_classes(rows)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(want.values()))


def test_repeats_are_cut(stages):
    before, after = stages["suffix_dedup"]
    want = {r[0]: r[1] - r[2] for r in brute([tuple(r) for r in before.select("doc_id", "text").collect()])}
    for r in after.collect():
        assert want[r["doc_id"]] - 3 <= len((r["text"] or "").encode()) <= want[r["doc_id"]] and r["n_chars"] == len(r["text"])


def test_mixing_copies_whole_rows(stages):
    before, after = stages["mixing"]
    known = {tuple(r) for r in before.collect()}
    assert {tuple(r) for r in after.collect()} <= known


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    rows = after.collect()
    check_layout(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before.collect())


def test_odd_tables(spark, odd, none):
    """Every stage takes nulls, empty and long texts, ties, repeated rows, clashing columns and no rows at all."""
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SMALL))
            assert name == "packing" or docs.columns == columns
        docs.count()
