"""op10: quality score of every document."""

from .common import table
from .pu_quality import quality_scores
from .registry import query


@query("op10_pu_quality")
def op10_pu_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
