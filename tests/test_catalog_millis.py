"""Milliseconds of arrivals and watermarks are those of the SQL's epoch_ms, which rounds."""

import duckdb

from spanweave import catalog as C

STAMPS = ["2024-01-25 14:18:05.494689", "2024-01-25 14:18:05.494499", "2024-01-25 14:18:05.4945", "2024-01-25 14:18:05.4955", "2024-01-01 23:59:59.999999", "1969-12-31 23:59:59.9985", "1969-12-31 23:59:59.998501", "2024-01-02 00:00:00"]


def test_arrivals_and_ticks(spark, tmp_path):
    con, path = duckdb.connect(), f"{tmp_path}/events.parquet"
    rows = ", ".join(f"({50 * n}::BIGINT, TIMESTAMP '{t}', 1::BIGINT, 'view', 1.5::DOUBLE, '{{}}')" for n, t in enumerate(STAMPS))
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{path}'")
    assert [tuple(r) for r in C._events(spark, str(tmp_path)).select("id", "arrival_pos").orderBy("id").collect()] == con.execute(f"WITH {C._E} SELECT id, arrival FROM e ORDER BY id").fetchall()
    ticks = con.execute(f"WITH {C._members_sql('tumbling')} SELECT pos, tick FROM c ORDER BY pos").fetchall()
    assert [tuple(r) for r in C._control(spark, str(tmp_path)).select("pos", "timestamp").orderBy("pos").collect()] == ticks
