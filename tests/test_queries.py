import random

import pytest

from roomscope.plans import photos, problems, records, star
from tests.conftest import DATA
from tests.oracle import assert_same

QUERIES = problems.QUERIES | photos.QUERIES | records.QUERIES | star.QUERIES
SQL = problems.SQL | photos.SQL | records.SQL | star.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, DATA, QUERIES[name], SQL[name])


def test_every_query_without_sql_gives_rows(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, str(DATA)).count() > 0


def test_zero_shot_label_with_more_than_a_thousand_labels(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, i, [r.gauss(0, 1) for _ in range(64)]) for i in range(1100)]
    rows = [(i, k, [e / sum(x * x for x in v) ** 0.5 for e in v]) for i, k, v in rows]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert all(x.vec_id == x.label for x in photos.zero_shot_label(spark, str(tmp_path)).collect())
