"""Every training-data query on empty tables, and on tables with NULLs in every column, repeated rows and extra columns."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from polyglean.llm import queries as llm

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
CLASHES = ("kind", "found", "term", "plain_text", "key", "k", "row", "f", "h", "begin")
FOUND = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["id", "term"], "p3_found": ["id", "seg", "seg_lang"], "p4_found": ["id_kept", "id_copy"],
    "p5_found": ["term", "mark"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "kind", "found"],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    empty, odd = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("odd")
    for t in ("corpus", "documents", "benchmark", "mix_target"):
        d = spark.read.parquet(f"{DATA}/{t}.parquet")
        d.limit(0).write.parquet(f"{empty}/{t}.parquet")
        null = lambda c: F.lit(None).cast(d.schema[c].dataType)  # noqa: E731, B023
        x = d.union(d.limit(5))
        for c in d.columns:
            x = x.union(d.limit(3).withColumn(c, null(c)))
        x = x.union(d.limit(2).select(*[null(c).alias(c) for c in d.columns]))
        for c in CLASHES:
            x = x.withColumn(c, F.lit("clash"))
        x.write.parquet(f"{odd}/{t}.parquet")
    return {"empty": str(empty), "odd": str(odd)}


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_odd(spark, folders, name):
    nothing = llm.QUERIES[name](spark, folders["empty"])
    assert nothing.count() == 0
    some = llm.QUERIES[name](spark, folders["odd"])
    assert some.count() > 0 and some.columns == nothing.columns
    if name in FOUND:
        assert some.columns == FOUND[name] and some.distinct().count() == some.count()
