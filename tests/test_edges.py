"""Queries against their SQL on events made for the edges that the given tables hardly reach."""

import duckdb
import pytest

from meshlark.plans import catalog

from oracle import same

catalog.load()


def written(path, select):
    """A connection that sees the events of a SELECT, which are also written for Spark."""
    c = duckdb.connect()
    c.sql(f"COPY ({select}) TO '{path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return c


@pytest.mark.parametrize("name", ["j5_aligned_edge", "j6_plane"])
def test_steps_onto_the_bounds_of_a_plane(spark, tmp_path, name):
    """Every two hours of a week, steps of every kind: many are exactly on a bound at half way."""
    duck = written(tmp_path, """
        SELECT row_number() OVER () * 35 + i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INT)) + to_hours(CAST(2 * h AS INT)) AS ts,
          7 AS user_id, 'view' AS event_type, v / 100::DOUBLE AS value, '{}' AS props
        FROM range(2, 9) a(d), range(12) b(h), range(35) c(i), (VALUES (1), (877), (2681), (3000)) v(v)""")
    same(catalog.QUERIES[name](spark, str(tmp_path)), catalog.SQL[name], duck)
