"""strip_diacritics keeps every row of documents, whatever its characters."""

import unicodedata

from tallyloom.plans import catalog


def test_all_rows_and_characters_stay(spark, tmp_path):
    texts = ["plain", "café", "“quoted” – dash", "š ő ł", "😀 日本語", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.bare for r in catalog.QUERIES["strip_diacritics"](spark, str(tmp_path)).collect()}
    want = {i: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for i, t in enumerate(texts)}
    assert got == want
