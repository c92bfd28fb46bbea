"""Queries that read their texts several times tokenise them once: later reads meet a stored table."""

import pytest

from gleaner.catalog import ingest, models, texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    words = {"en": "house houses water tree", "de": "haus wasser baum wald"}
    rows = [(i, f"{words[lang]} word{chr(97 + i % 7)} {words[lang]}", lang, "s", 60) for i in range(30) for lang in [("en", "de")[i % 2]]]
    rows = [*rows, (30, None, "en", "s", 0), (3, "same key again water tree house", "en", "s", 31)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("query", [texts.agg_bow, texts.fn_lemmatize_lexicon, models.tm_relevance, models.tm_coherence_cv])
def test_texts_are_tokenised_once(spark, folder, query):
    out = query(spark, folder)
    assert "documents.parquet" not in " ".join(out.inputFiles())
    assert out.count() > 0


def test_drops_land_compressed_and_whole(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, "kept " * 50) for i in range(40)], "a long, b string")
    path = str(tmp_path / "landing")
    for _ in ingest._land_in_two(df, df["a"] < 9, path, "json"):
        pass
    names = [p.name for p in (tmp_path / "landing").iterdir() if p.name.startswith("part")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert rows(spark.read.schema(df.schema).json(path)) == rows(df)
