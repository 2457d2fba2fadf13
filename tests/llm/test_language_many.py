"""Mixtures with more than eight learnt languages, and tables for more than 128."""

from __future__ import annotations

import numpy as np

from tidemill.llm import language


def test_a_second_language_in_other_letters_is_found_among_many():
    """Ten languages that share most words with the main one, two in other letters; 30 % of the words are of the last."""
    rng = np.random.default_rng(5)
    words = {
        "latin": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(200)],
        "greek": ["".join(rng.choice(list("αβγδεζηθικλμ"), 5)) for _ in range(200)],
        "cyrillic": ["".join(rng.choice(list("бвгджзийклмн"), 5)) for _ in range(200)],
    }
    vocabularies = [list(rng.permutation(words["latin"])[:150]) for _ in range(10)] + [words["greek"], words["cyrillic"]]
    counts = np.zeros((1 << language.TABLE_BITS, len(vocabularies)))
    for i, own in enumerate(vocabularies):
        slots = language.trigram_slots([" ".join(own)], language.TABLE_BITS)[0]
        counts[:, i] = np.bincount(slots, minlength=len(counts))
    log_p = np.log((counts + language.SMOOTHING) / (counts.sum(0) + language.SMOOTHING * len(counts))).astype(np.float32)
    model = language.Model([f"l{i:02}" for i in range(12)], language.TABLE_BITS, log_p)
    text = " ".join([*rng.choice(vocabularies[0], 140), *rng.choice(vocabularies[11], 60)])
    shares, best, score = language.infer([text], model)
    assert abs(shares[0, 11] - 0.3) < 0.05 and shares[0, 10] == 0
    assert best[0] < 10 and score[0] > 0.3


def test_blocks_do_not_change_results(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(docs)
    texts = [r[0] or "" for r in docs.select("text").limit(30).collect()]
    want = language.infer(texts, model)
    monkeypatch.setattr(language, "BLOCK_VALUES", 64)
    got = language.infer(texts, model)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_table_size_does_not_depend_on_the_number_of_languages(spark):
    rows = [(i, f"word{chr(97 + i % 26)} only{chr(97 + i // 26)} here", f"l{i:03}") for i in range(200)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 128 and model.log_probability.shape == (1 << language.TABLE_BITS, len(model.languages))
