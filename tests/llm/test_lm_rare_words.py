"""op2's model knows the counts of all words, however few are broadcast."""

import numpy as np
import pytest
from strata.llm import lm_score

from test_lm_score import corpus


@pytest.mark.parametrize("how", [{"model_words": 20}, {"model_words": 0, "hot_words": 50}, {"model_words": 30, "max_filter_bytes": 4000}])
def test_scores_do_not_depend_on_what_is_broadcast(spark, how):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    whole = lm_score.lm_scores(docs).orderBy("doc_id", "n_tokens").toPandas()
    some = lm_score.lm_scores(docs, **how).orderBy("doc_id", "n_tokens").toPandas()
    assert (whole.n_known == some.n_known).all() and np.allclose(whole.base_score, some.base_score)
    assert np.allclose(whole.score, some.score, rtol=1e-6)
