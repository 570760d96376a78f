"""The closest choice counts bytes, as its SQL does; no text, no choice."""

import oracle
from tessera import catalog


def test_closest_choice_of_short_and_missing_texts(spark, tmp_path):
    texts = ["éu", None, "", "日u", "ü", "öl", "ñe", "és", "que", "une é", "éue"]
    spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    oracle.check(spark, oracle.connect(str(tmp_path)), str(tmp_path), "f42_closest_choice", catalog.QUERIES["f42_closest_choice"], catalog.ORACLES["f42_closest_choice"])
