import pytest
from compare import same_rows

from marlstone.plans import planes


@pytest.mark.parametrize("name", sorted(planes.QUERIES))
def test_agrees_with_sql(spark, sf, duck, name):
    same_rows(planes.QUERIES[name](spark, sf), duck, planes.ORACLES[name])
