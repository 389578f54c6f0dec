"""The corpus pipeline against its stages' plain versions."""

from __future__ import annotations

from collections import Counter

import pytest
from cases import docs, labels, texts
from test_llm_structure import check_pieces, ids_of, plain_components, plain_simhash
from test_llm_text_rules import line_rows

import corpus_pipeline
from pollwright.llm import mixing, quality_lines
from pollwright.llm.common import table

SF = "/root/testdata/sf0.001"


def staged(spark, rows, label_rows):
    """The rows that the first three stages leave, by plain loops."""
    d = docs(spark, rows)
    model = quality_lines.fit_line_model(d, label_rows)
    rows = [(i, t) for i, t in rows if quality_lines.judge(t or "", model, 0.5)[6]]
    rows = [(i, k) for i, _, _, k in line_rows(rows, 10)]
    tops = plain_components([plain_simhash(t) for _, t in rows])
    best = {}
    for (i, t), c in zip(rows, tops):
        if c not in best or i < best[c][0]:
            best[c] = (i, t)
    return sorted(best.values())


def test_stages_on_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = staged(spark, rows, table(spark, SF, "labels"))
    now = table(spark, SF, "documents")
    names = now.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == names
    now = now.cache()
    assert sorted((r.doc_id, r.text) for r in now.collect()) == want
    mixed = corpus_pipeline.mixing_to_targets(spark, now, SF)
    assert mixed.columns == names
    kept = [(r.doc_id, r.text) for r in mixed.collect()]
    assert set(kept) <= set(want) and len(set(kept)) == len(kept)
    clean = {r.doc_id for r in mixing.quality_domains(table(spark, SF, "labels")).where("domain = 'clean'").collect()}
    lost = clean & ({i for i, _ in want} - {i for i, _ in kept})
    assert len(lost) <= 0.02 * len(clean)
    check_pieces(corpus_pipeline.run(spark, SF).collect(), ids_of(kept), 4096)


@pytest.mark.parametrize("rows", [[], texts()])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    sf = str(tmp_path)
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    labels(spark, [(9, 1, 0), (12, 0, 0)]).write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = now.columns
        after = stage(spark, now, sf)
        after.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert now.columns == before
    assert corpus_pipeline.run(spark, sf).columns == now.columns
    assert Counter(r.doc_id for r in now.collect() if r.start == 0).keys() <= {i for i, _ in rows}
