"""The stages of the corpus pipeline, one after the other."""

import corpus_pipeline as pipeline
from topictide.llm.secret_scan import base_spans
from topictide.llm.store import saved, table


def test_stages_take_effect(spark, folder):
    docs = table(spark, folder, "documents")
    original = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, folder))
        assert docs.columns == pipeline.COLUMNS, name
        if stage is pipeline.keep_one_of_alike:
            texts = [r.text for r in docs.collect()]
            assert len({*texts}) == len(texts) <= before.count()
        if stage is pipeline.mask_secrets:
            assert docs.count() == before.count()
            assert all(base_spans(r.text) == [] for r in docs.collect())
    pieces = pipeline.STAGES[-1][1](spark, docs, folder)
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} <= {*original}
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert all(labels.get(r.doc_id, 1) == 1 for r in rows)


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double"
    some = [(None, None, None, None, None, 1.0), (1, "", "en", "s", 0, 1.0), (1, "a b c d", "en", "s", 7, 1.0), (1, "a b c d", "en", "s", 7, 1.0), (2, "password=abcdefgh12", "en", "t", 19, 1.0)]
    for rows in (some, []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in pipeline.STAGES:
            docs = saved(stage(spark, docs, ""))
        assert docs.count() >= 0


def test_near_copies_by_five_words(docs):
    base = [f"w{i}" for i in range(110)]
    grams = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    changed = lambda new, *at: [f"{new}{i}" if i in at else w for i, w in enumerate(base)]
    longer, shorter, few, many = base + [f"more{i}" for i in range(16)], base[:-16], changed("new", 30, 70), changed("other", 20, 50, 80)
    assert [round(alike(base, x), 2) for x in (longer, shorter, few, many)] == [0.87, 0.85, 0.83, 0.75]
    slight = [f"v{i}" for i in range(105)]
    slighter = [f"new{i}" if i in (30, 70) else w for i, w in enumerate(slight)]
    assert round(alike(slight, slighter), 2) == 0.82
    rows = docs([(i, " ".join(words)) for i, words in enumerate([base, longer, shorter, few, many, slight, slighter])])
    kept = pipeline.keep_one_of_alike(None, rows, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 4, 5]
