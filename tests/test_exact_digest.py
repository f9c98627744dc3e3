"""Exact digests in parts, against one array; MD5s that are handed on."""

import hashlib

import pytest

from ledgerline.functions.md5_state import Md5
from ledgerline.operators import digests


@pytest.mark.parametrize("native", [True, False])
def test_md5_goes_on_from_its_state(native):
    state, text = Md5(native=native).state, b""
    for n in (0, 1, 54, 55, 56, 63, 64, 65, 1000):
        md5 = Md5(state, native)
        md5.update(bytes(range(256)) * 4 if n == 1000 else b"x" * n)
        text += bytes(range(256)) * 4 if n == 1000 else b"x" * n
        state = md5.state
        assert md5.hexdigest() == hashlib.md5(text).hexdigest()


def test_digest_in_parts_is_that_of_one_array(spark):
    rows = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 7 ELSE id END AS id", "'a' AS v").repartition(5)
    whole = digests.table_digest(rows, exact=True).first()
    assert [digests.table_digest(rows, exact=True, part_rows=n).first() for n in (10**6, 300)] == [whole] * 2
    one = rows.limit(1)
    assert digests.chained_digest(digests.hashed(one), 1).first() == digests.table_digest(one, exact=True).first()
