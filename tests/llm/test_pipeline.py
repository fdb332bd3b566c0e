"""The stages against plain code on a small table."""

import re

import corpus_pipeline as P
from tests.llm.test_operators import components_by_hand, lines_by_hand, texts, toxic_table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], COLUMNS)


def test_every_stage(spark, tmp_path):
    rows, labels = toxic_table(300)
    rows += [(1000 + k, t) for k, t in enumerate(texts())] + [(2000, None), (2001, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(P.STAGES)
    clean = steps["toxicity"](spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in clean.collect()}
    bad = {i for i, _, t in labels if t}
    assert clean.columns == P.COLUMNS and len(bad & set(kept)) <= 3 and len(set(dict(rows)) - bad - set(kept)) == 0

    lines = steps["line_dedup"](spark, table(spark, list(kept.items())), str(tmp_path))
    got = {r.doc_id: r for r in lines.collect()}
    dropped = {i: n for i, _, n, _ in lines_by_hand(list(kept.items()))}
    assert set(got) == set(kept) and any(dropped.values())
    for i, r in got.items():
        assert (r.text == (kept[i] or "")) == (dropped[i] == 0) and r.n_chars == len(r.text)

    before = [(i, r.text) for i, r in got.items()]
    found = {r.doc_id for r in steps["jaccard_join"](spark, table(spark, before), str(tmp_path)).collect()}
    assert found == {i for i, n, c in components_by_hand(before, 5, 80) if c == i or n == 0} and len(found) < len(before)

    placed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == found
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t)) + 1 for i, t in before if i in found}
    total = {}
    for r in placed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == size


def test_empty_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = table(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    same = table(spark, [(1, "one and the same text of eight words here"), (1, "one and the same text of eight words here"), (2, "one and the same text of eight words here"), (3, ""), (4, None), (None, "a text that has no id at all")])
    assert sorted(r.doc_id or 0 for r in P.drop_copies(spark, same, str(tmp_path)).collect()) == [0, 1, 3, 4]
