"""op9: licence paragraphs of all documents."""

from .common import table
from .license_scan import scan_corpus
from .registry import query


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    return scan_corpus(table(spark, sf_dir, "documents"))
