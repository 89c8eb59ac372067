import pytest
from helpers import same_rows

from lawmill import registry


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_query_matches_sql(name, spark, sf_dir, duck):
    ours, theirs = same_rows(registry.all_queries()[name](spark, sf_dir), duck, registry.all_sql()[name])
    assert ours == theirs


def test_every_query_has_sql():
    assert set(registry.all_queries()) == set(registry.all_sql())
