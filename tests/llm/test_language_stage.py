"""The language stage of the pipeline on planted texts, with four learned languages and with two."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

_rng = random.Random(3)
FOREIGN = {
    "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita.",
    "fi": "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu jarki ja omatunto.",
    "pl": "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw. Sa oni obdarzeni rozumem.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "noise": "".join(_rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(150)),
    "consonants": "".join(_rng.choice("qxzjkvwbpfgyhm ") for _ in range(120)),
    "encoded": "".join(_rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200)),
}
CLEAN = {"en": "That it of the and.", "de": "Der und erheit.", "fr": "Et le mentéaux.", "es": "De la ciónosa que."}


@pytest.mark.parametrize("languages", [("de", "en", "es", "fr"), ("de", "en")])
def test_planted(spark, small, languages):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.col("lang").isin(*languages))
    texts = [*FOREIGN.values(), *(CLEAN[x] for x in languages), "12 34 !", None]
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = corpus_pipeline.language_stage(spark, docs.unionByName(planted, allowMissingColumns=True), small)
    found = {r.doc_id: r.text for r in kept.collect()}
    assert {t for i, t in found.items() if i < 0} == {CLEAN[x] for x in languages}
    assert {i for i in found if i >= 0} == {r.doc_id for r in docs.where(r"text rlike '\\p{L}'").collect()}
