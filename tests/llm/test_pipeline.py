import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from kinlink.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(materialise(f(spark, out[-1], SF), f"t{k}"))
    return out


def test_stages_only_filter_and_mask(stages):
    before, *filters, clean, tokens = stages
    ids = {r.doc_id for r in before.collect()}
    for s in filters:
        assert s.columns == before.columns
        own = {r.doc_id for r in s.collect()}
        assert own <= ids
        ids = own
    assert {r.doc_id for r in clean.collect()} == ids == {r.doc_id for r in tokens.collect()}
    assert all(r.lossless for r in tokens.collect())


def test_every_component_keeps_its_first(stages):
    from kinlink.llm import simhash_trie

    kept = {r.doc_id for r in stages[2].collect()}
    by = {}
    for r in stages[1].collect():
        by.setdefault(r.text, set()).add(r.doc_id)
    for group in by.values():
        assert len(group & kept) <= 1


def test_nothing_in_nothing_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


def odd_documents(spark):
    """Nulls in every column, ties, repeated rows, an empty and a very long text, more columns whose names are used inside."""
    long = "A quiet sentence about rivers and hills. " * 6000
    rows = [(i, f"{t} {i}", "en", "src0", 1, "k", 2) for i, t in enumerate(["The river runs past the old mill and the town.", "Mail ann@x.org about the mill."] * 4)]
    rows += [rows[0], rows[0], (3, None, None, None, None, None, None), (None, "No id, but a text of some words.", "en", "s", 1, "k", 1), (None, None, None, None, None, None, None), (50, "", "en", "s", 0, "", 0), (51, long, "en", "s", len(long), "k", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score int"), rows, long


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_documents(spark, k):
    docs, rows, long = odd_documents(spark)
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF).collect()
    ids = [r.doc_id for r in got]
    if k < 4:
        assert set(corpus_pipeline.COLUMNS) == set(got[0].asDict()) if got else True
    if k in (2, 3, 4):  # nothing here is contaminated, and these two keep every row
        assert len(got) == len(rows) and ids.count(None) == 2 and ids.count(0) == 3
    if k == 1:  # rows without an id stay; of equal texts one id stays, with all its rows
        assert ids.count(None) == 2 and ids.count(0) == 3 and 51 in ids
    if k == 3:
        by = {r.doc_id: r.text for r in got}
        assert by[1] == "Mail [EMAIL] about the mill. 1" or "ann@x.org" not in by[1]
        assert by[51] == long and by[50] == ""
    if k == 4:
        assert all(r.lossless for r in got) and {r.n_pieces for r in got if r.doc_id == 50} == {0}
