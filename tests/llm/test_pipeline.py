from collections import Counter

import compare
import corpus_pipeline
import public_tokenizers
import pytest
from rows import ENGLISH, FOLDER, ODD, base_counts, by_sequence, documents, near_components, odd_table

import __spark_entry__
from lanewise.llm import tables


def test_stages_keep_what_they_should(spark):
    docs = documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.collect()}
        gone = set(before) - after
        assert after <= set(before)
        if name == "quality_rules":
            for key, text in before.items():
                n, _, _, _, repeated = base_counts(text)
                assert not (n < 10 or 100 * repeated > 20 * n) or key in gone
        if name == "exact_dedup":
            groups = {}
            for key, text in sorted(before.items()):
                groups.setdefault("".join(text.split()), []).append((-len(text), key))
            assert after == {min(g)[1] for g in groups.values()}
        if name == "near_dedup":
            assert after == {k for k, (_, c) in near_components(before, 5, 80).items() if k == c}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(sum(n for _, n in inside) <= 2048 for inside in by_sequence(rows).values())


def test_clean_documents_stay(spark):
    """Of the given table, all rows labelled good that pass the base rules, but for copies."""
    docs = documents(spark)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    language, quality = (f for _, f in corpus_pipeline.STAGES[:2])
    kept = {r.doc_id for r in quality(spark, language(spark, docs, FOLDER), FOLDER).collect()}
    for r in docs.collect():
        n, _, _, _, repeated = base_counts(r.text)
        if labels.get(r.doc_id) == 1 and n >= 10 and 100 * repeated <= 20 * n:
            assert r.doc_id in kept


def test_stages_of_odd_rows(spark):
    rows = [*ODD, (40, ENGLISH + " and more words here", "en"), (41, ENGLISH + " and more words  here", "en")]
    table = odd_table(spark, rows)
    for docs in (table, table.limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def test_repeated_rows_and_null_keys_in_the_duplicate_stages(spark):
    exact, near = (f for _, f in corpus_pipeline.STAGES[2:4])
    rows = exact(spark, odd_table(spark), FOLDER).select("doc_id", "text").collect()
    want = {}
    for key, text, _ in ODD:
        same = "".join((text or "").split())
        rank = (-len(text or ""), key is None, key or 0)
        want[same] = min(want.get(same, (rank, key, text)), (rank, key, text), key=lambda r: r[0])
    assert Counter(tuple(r) for r in rows) == Counter((k, t) for _, k, t in want.values())
    assert None in {r.doc_id for r in near(spark, odd_table(spark), FOLDER).select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(tables.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    report = tables.queries()[name](spark, FOLDER)
    assert compare.differences(report, compare.connect(FOLDER), tables.oracle_sql()[name], some=True) == []


def test_registration():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)
