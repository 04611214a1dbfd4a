"""What the driver holds while the language classifier is fitted."""

import random
import tracemalloc

import pyarrow as pa

from corvane.llm import language_id


def test_one_copy_of_the_examples(spark):
    """The driver makes no second copy of the examples' features, be it as values, and keeps none of them."""
    rng = random.Random(11)
    letters = {"aa": [chr(97 + i) for i in range(26)] + [" "], "bb": [chr(0x430 + i) for i in range(32)] + [" "]}
    made = [(lang, "".join(rng.choices(letters[lang], k=5000))) for lang in letters for _ in range(300)]
    features = sum(len(language_id.features(text)[0]) for _, text in made)
    frame = spark.createDataFrame(made, "lang string, text string").repartition(4).cache()
    frame.count()
    language_id.fit(frame.limit(8))  # what is imported and set up once
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        model = language_id.fit(frame)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        frame.unpersist()
    weights = model.weights.nbytes
    assert features > 1_500_000
    assert most < 8 * features + 8 * weights  # six bytes a feature came
    assert pa.total_allocated_bytes() - before < features
