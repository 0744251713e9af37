"""op8: near-duplicate classes and link counts of all documents."""

from .common import table
from .jaccard_forest import near_duplicate_classes
from .registry import query


@query("op8_jaccard_forest")
def op8_jaccard_forest(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
