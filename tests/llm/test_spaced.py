"""Letters set apart by blanks, with punctuation around them."""

import pytest

from strata.llm import toxicity


@pytest.mark.parametrize(("text", "word"), [("you are s c u m.", b"scum"), ("(i d i o t)", b"idiot"), ('"s c u m" he said', b"scum"), ("s c u m?! yes", b"scum"), ("such m o r o n", b"moron")])
def test_spaced_words_with_punctuation(spark, text, word):
    model = toxicity.char_model(spark.createDataFrame([("you are scum idiot moron such " * 20,)], "text string"))
    assert word in toxicity.text_words(text.encode(), model, toxicity._symbol_table())
