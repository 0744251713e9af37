"""op13: language-model scores of all documents."""

from .common import table
from .lm_score import score_texts
from .registry import query


@query("op13_lm_score")
def op13_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
