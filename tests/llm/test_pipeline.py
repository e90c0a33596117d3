"""The pipeline's stages against plain versions of them."""

import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F
from test_llm import components_of, linked, shingles, spans

import corpus_pipeline
from evalspark.llm import minhash, pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and not toxic & set(left) and len(left) > 0.7 * docs.count()

    alone = stage["near_duplicates"](spark, clean, SF).cache()
    sets = {i: shingles(t, 5) for i, t in left.items()}
    want = components_of(sets, linked(sets))
    assert alone.columns == columns and {r.doc_id for r in alone.collect()} == {i for i, c in want.items() if i == c}

    masked = stage["secrets"](spark, alone, SF).cache()
    assert masked.columns == columns
    for r in masked.collect():
        found = spans(left[r.doc_id])
        assert (r.text == left[r.doc_id]) == (not found)
        assert not found or (r.n_chars == len(r.text) and r.text.count("[secret]") >= 1 and not any(re.search("[0-9a-f]{24}", r.text) or () for _ in (0,)))

    mixed = stage["mixing"](spark, masked, SF).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(times.values()) == 2

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text_of = {r.doc_id: r.text for r in mixed.collect()}
    out = stage["sentencepiece"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == times
    assert all(r.ids == model.encode(text_of[r.doc_id]) and r.n_pieces == len(r.ids) for r in out)


def test_near_copies_of_an_id_with_several_texts(spark):
    """Id 5 carries a copy of id 3's text and two that nothing else has; id 7 copies one of these."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(3, one), (5, one + " end"), (5, two), (5, two), (5, three), (7, three + " end"), (None, one), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect())
    assert got == Counter(r for r in rows if r not in ((5, one + " end"), (7, three + " end")))
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert found == {(3, 57, 3, True), (5, 58, 3, False), (5, 57, 5, True), (7, 58, 5, False), (8, 0, 8, True)}


ODD = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \t ", "de", "a", 3), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (None, "no id here at all but words", "en", "b", 1),
    (6, " ".join(f"w{i * i % 977}" for i in range(60_000)), None, "", 9), (7, "see password=abcdefgh and more words to keep it apart", "en", "b", 5), (8, "ünï 日本 🎉 token: abcdef1", "fr", "c", 3),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, blanks, a long text, repeated rows and clashing columns go through all stages; clean rows stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("x") for c in ("spans", "blob", "kept", "ids", "toxic", "copies", "component_id", "text_hash")}
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.withColumns(clash), docs.where("false")):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns, name
            got = Counter((r.doc_id, r.text) for r in out.collect())
            want = Counter((r.doc_id, r.text) for r in table.collect())
            if name in ("toxicity", "near_duplicates"):
                assert got == want, name
            elif name == "secrets":
                assert sum(got.values()) == sum(want.values()) and {i for (i, t), _ in (got - want).items()} <= {7, 8}
            else:
                assert all(n <= 2 * want[k] for k, n in got.items())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text_of = {r[0]: r[1] for r in ODD}
    out = dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs.withColumns(clash), str(tmp_path)).collect()
    assert len(out) == len(ODD) and all(r.ids == (None if text_of[r.doc_id] is None else model.encode(text_of[r.doc_id])) for r in out)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
