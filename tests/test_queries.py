"""Every query of the library against its SQL; those without SQL have to run and give a stable schema."""

from __future__ import annotations

import pytest
from oracle import differences

from procura import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLE:
        assert differences(df, plans.ORACLE[name], sf_dir) == []
    else:
        assert len(df.collect()) > 0
