"""Values at which another order of the same arithmetic gives another row than the SQL."""

import duckdb

from tamis.registry import QUERIES, SQL


def compared(spark, path, name, rows):
    """A query's rows and its SQL's on events (user, value, k), in time order."""
    given = [(i, user, float(value), f'{{"k": {k}}}') for i, (user, value, k) in enumerate(rows)]
    events = spark.createDataFrame(given, "event_id long, user_id long, value double, props string")
    events.selectExpr("*", "timestamp_micros(1700000000000000 + event_id * 1000000)::timestamp_ntz ts", "'a' event_type").coalesce(1).write.parquet(f"{path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    found = QUERIES[name](spark, str(path))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    return sorted(map(tuple, found.collect())), sorted(db.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall())


def test_box_sides_multiply_one_after_the_other(spark, tmp_path):
    """143.75 / 500 * 320 * 5 * 0.3 is 138, 143.75 / 500 * 1600 * 0.3 a little less."""
    values = [143.75, 256.25, 287.5, 318.75]
    got, want = compared(spark, tmp_path, "box_scaling", [(user, v if i == 4 else 50, 20) for user, v in enumerate(values) for i in range(5)])
    assert got == want
    assert [r[2] for r in got if r[1] == 4] == [552, 984, 1104, 1224]


def test_spreads_of_three_quarters(spark, tmp_path):
    """Of two groups with a spread of 0.75 the sums' last bits say which is stuck."""
    first = [5, 6, 6, 7, 8, 9, 11, 12, 14, 14, 14, 15, 16, 16, 16, 18, 19, 19, 20, 21, 21, 22, 25, 26, 28, 28, 28, 29, 32, 32, 33, 33, 34, 34, 37, 40, 41, 44]
    first += [47, 48, 51, 52, 55, 55, 63, 64, 64, 66, 67, 68, 68, 72, 76, 76, 76, 77, 78, 79, 82, 85, 89, 94, 97, 98, 98, 99, 99]
    second = [2, 3, 4, 4, 5, 6, 7, 9, 11, 11, 12, 15, 21, 22, 23, 25, 27, 28, 32, 33, 36, 37, 37, 39, 39, 39, 43, 46, 48, 49, 54, 56, 57, 61, 62, 64, 64, 68, 68, 68]
    second += [69, 71, 71, 71, 75, 76, 77, 78, 78, 78, 80, 84, 86, 87, 87, 92, 93]
    got, want = compared(spark, tmp_path, "stuck_scores", [(u, 1, k) for u, ks in ((1, first), (2, second)) for k in ks])
    assert got == want == [(1, 0.75, False), (2, 0.75, True)]
