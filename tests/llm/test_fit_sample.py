"""The texts that the language classifier is fitted on: distinct ones, of each language on its own."""

from collections import defaultdict

from pyspark.sql import functions as F

from corvane.llm import language_id


def test_copies_and_rare_languages(spark):
    made = [("one text that stands everywhere", "aa")] * 4000
    made += [(f"text number {i}", "aa") for i in range(300)] + [(f"texte numéro {i}", "bb") for i in range(12)] + [("text number 7", "cc")]
    rows = spark.createDataFrame(made, "text string, lang string").repartition(5)
    languages, chosen = language_id.fit_sample(rows, 20)
    found = defaultdict(list)
    for r in chosen.collect():
        found[r.lang].append(r.text)
    assert languages == ["aa", "bb", "cc"]
    assert {x: (len(t), len(set(t))) for x, t in found.items()} == {"aa": (20, 20), "bb": (12, 12), "cc": (1, 1)}


def test_rare_language_is_learned(spark):
    """Copies of a text with a small hash, of which a share for each language takes all, leave room for other languages."""
    hot = spark.range(2000).select(F.concat(F.lit("abab baba abba "), F.col("id").cast("string")).alias("t")).orderBy(F.abs(F.xxhash64("t", F.lit(1))) % 1_000_000).first().t
    made = [(i, hot, "aa") for i in range(3000)]
    made += [(5000 + i, f"cdcd dccd {'cd' * (i % 9 + 1)} {i}", "bb") for i in range(40)] + [(6000 + i, f"éèçà çàéè {'éè' * (i % 9 + 1)} {i}", "cc") for i in range(40)]
    frame = spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(4)
    model = language_id.fit(frame, fit_documents=40)
    assert language_id.predict(frame, model).where("lang_pred <> lang").count() == 0
