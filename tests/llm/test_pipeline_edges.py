"""Every pipeline stage on nulls, empty and repeated rows, clashing columns and empty tables."""
import pytest

import corpus_pipeline
from insightframe.llm import decontaminate, near_dedup, quality_gbt, secret_scan
from insightframe.llm.common import forget, materialise

from .helpers import EDGES, prose, table

SF = "/root/testdata/sf0.001"


def odd_rows():
    rows = [(i, prose(i, 80), "en", "s") for i in range(1, 9)]
    return rows + [(1, prose(1, 80), "en", "s"), (2, prose(77, 80), None, None), (None, None), (None, prose(5, 80))] + EDGES


def clashing(spark, rows):
    df = table(spark, rows)
    for c in ("llm_kept_id", "llm_place", "llm_body", "score", "predicted", "label", "item_id", "component_id", "kept"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.mark.parametrize("number", range(4))
def test_filtering_stages_take_any_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = clashing(spark, odd_rows())
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns, name
    rows = out.collect()
    assert len(rows) <= docs.count() and all(r.llm_place == "x" and r.label == "x" for r in rows)
    if name in ("near_dedup", "decontaminate", "secrets"):  # nothing to drop in what has no text
        assert sum(r.text is None for r in rows) == 2
    empty = docs.where("doc_id = -5")
    assert stage(spark, empty, SF).count() == 0
    assert stage(spark, empty, SF).columns == docs.columns


def test_packing_takes_any_rows(spark):
    docs = clashing(spark, odd_rows())
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sum(r.length for r in rows) > 0 and {r.doc_id for r in rows} >= {1, 2, 9001, None}
    assert corpus_pipeline.STAGES[4][1](spark, docs.where("doc_id = -5"), SF).count() == 0


def test_unlike_texts_of_one_id_stay(spark):
    docs = [(1, prose(1, 60), "en", "s"), (1, prose(2, 60), "en", "s"), (2, prose(3, 60), "en", "s"), (1, prose(1, 60).upper(), "en", "s"),
            (3, prose(3, 60), "en", "s"), (4, None), (4, None), (5, " ")]
    out = near_dedup.keep_one(clashing(spark, docs), words=5).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in out) == sorted(
        [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(3, 60)), (4, ""), (5, " ")])


def test_copies_are_deleted_and_inputs_are_not(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "mine"))
    mine = spark.read.parquet(str(tmp_path / "mine"))
    copy = materialise(mine, "copy")
    files = copy.inputFiles()
    forget(copy, mine)
    assert mine.count() == 10
    assert not any(spark._jvm.java.io.File(f.removeprefix("file://").removeprefix("file:")).exists() for f in files)


def test_filters_say_what_they_do_with_odd_rows():
    for f in (decontaminate.keep_clean, quality_gbt.keep_quality, secret_scan.redact, *(s for _, s in corpus_pipeline.STAGES), corpus_pipeline.run):
        said = f.__doc__.lower()
        for word in ("null", "empty", "repeated", "columns"):
            assert word in said, (f.__name__, word)
