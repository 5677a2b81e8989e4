"""The hash in the SQL of the SimHash query against the library's, at every length of text that takes another path."""

from __future__ import annotations

import random

import duckdb
import pytest
import xxhash

from quirework.llm import simhash_sql


@pytest.mark.parametrize("seed", [0, 42])
def test_hash_in_sql(seed):
    rng = random.Random(seed)
    texts = [rng.randbytes(n) for n in [*range(140), 1000, 4099]]
    con = duckdb.connect()
    con.execute("create table t as select unnest(?) as x", [[t.hex() for t in texts]])
    got = dict(con.execute(simhash_sql.xxh64("t", seed)).fetchall())
    assert got == {t.hex(): xxhash.xxh64_intdigest(t, seed) for t in texts}
