import pytest

from platewise.llm import chunk_recipes, near_jaccard, simhash_golay
from platewise.session import scratch_path
from tests.llm.helpers import prose


@pytest.mark.parametrize("filtered", [chunk_recipes.deduplicated, simhash_golay.one_of_each, near_jaccard.one_of_each])
def test_filters_hold_when_files_are_cut_anew(spark, filtered):
    """The plan that filters the documents may cut the files otherwise than the one that wrote chunks or fingerprints."""
    path = scratch_path(spark, "docs")
    rows = [(i, prose(40, i // 2 + 1) + f" only{i // 2}" * 9) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id").write.option("parquet.block.size", "4096").parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "1g")
        out = filtered(spark.read.parquet(path))
        for n, v in zip(names, ("2k", "1")):
            spark.conf.set(n, v)
        got = [r["doc_id"] for r in out.collect()]
    finally:
        for n in names:
            spark.conf.set(n, was[n])
    assert sorted(got) == list(range(0, 400, 2))
