"""The stream of panes against a loop over batches, on odd clicks, and its SQL on the small table."""

import math
import zlib
from datetime import datetime, timedelta

import duckdb


from gazetta.llm import panes as P
from gazetta.llm.queries import ORACLE_SQL, QUERIES

EPOCH = datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def plain_records(clicks):
    """The contract read line by line. clicks: (click_id, ts, arrived_at, kind, value)."""
    once = {}
    for at, (click_id, ts, arrived, kind, value) in enumerate(clicks):
        if ts is None:
            continue
        arrived = arrived or ts
        order = (arrived, ts, kind is not None, kind or "", value is not None, value or 0)
        key = click_id if click_id is not None else ("own", at)
        if key not in once or order < once[key][0]:
            once[key] = (order, click_id, ts, arrived, kind, value)
    batches = [[] for _ in range(10)]
    for _, click_id, ts, arrived, kind, value in once.values():
        day = (arrived - EPOCH).days
        q = day % 10
        more = zlib.crc32(str(click_id).encode()) % 30 - 23 if click_id is not None else 0
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        batches[min(9, q + max(0, more))].append((click_id, kind or "none", us(ts) - (day - q) * P.DAY, cents))
    panes, out, mark = {}, [], -math.inf
    for b, rows in enumerate(batches):
        old = {k: (v["n"], v["c"]) for k, v in panes.items() if v["emitted"]}
        changed = set()
        for click_id, kind, at, cents in rows:
            hour = at // P.HOUR
            if mark >= (hour + 1) * P.HOUR + 2 * P.DAY:
                out.append((b, hour, click_id, 1, cents, "late", kind))
                continue
            pane = panes.setdefault((kind, hour), {"n": 0, "c": 0, "emitted": False})
            pane["n"] += 1
            pane["c"] += cents
            changed.add((kind, hour))
        for (kind, hour), v in list(panes.items()):
            if not v["emitted"] and mark >= (hour + 1) * P.HOUR + 12 * P.HOUR:
                out.append((b, hour, -1, v["n"], v["c"], "emit", kind))
                v["emitted"] = True
            elif v["emitted"] and (kind, hour) in changed:
                out.append((b, hour, -1, *old[kind, hour], "retract", kind))
                out.append((b, hour, -1, v["n"], v["c"], "replace", kind))
            elif b == 9 and not v["emitted"]:
                out.append((b, hour, -1, v["n"], v["c"], "final", kind))
            if mark >= (hour + 1) * P.HOUR + 2 * P.DAY:
                del panes[kind, hour]
        mark = max([mark, *(r[2] for r in rows)])
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")) for r in df.collect()), key=str)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def made(spark, rows):
    return spark.createDataFrame([(i, ts, arrived, 1, kind, value, "{}") for i, ts, arrived, kind, value in rows], SCHEMA)


def day(d, hour=0.0):
    return datetime(2024, 1, 1) + timedelta(days=d, hours=hour)


def test_odd_clicks(spark):
    rows = [(i, day(i % 17 - 3 * (i % 13 == 0), i % 24 + i / 999), day(i % 17, 23.5), ["a", "b", None][i % 3], [1.005, None, float("nan"), -2.5, float("inf")][i % 5]) for i in range(260)]
    rows += rows[:20]  # repeated
    rows += [(1000, None, day(1), "a", 1.0), (1001, day(2), None, "a", 1.0), (None, day(2), day(2), "a", 1.0), (None, day(2), day(2), "a", 1.0)]
    rows += [(1002, datetime(1969, 12, 31, 23, 59), day(3), "a", 1.0), (1003, datetime(1, 1, 3), day(3), "a", 2.0), (1004, datetime(2024, 1, 9, 3, 0, 0, 1), day(8), "b", 0.005)]
    rows += [(1005, day(5), day(5), "b", 9.0), (1005, day(4), day(5, 1), "a", 8.0)]
    want = plain_records(rows)
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"}
    assert found(P.revised_panes(made(spark, rows).repartition(3))) == want


def test_empty_batches_emit_too(spark):
    # all rows in batches 0, 3 and 9: due panes appear in batches without rows
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 30 <= 23][:90]
    first = 19_720  # a day that is divisible by ten
    start = EPOCH + timedelta(days=first)
    rows = [(i, start + timedelta(days=d, hours=k % 20), start + timedelta(days=d, hours=21), "a", 1.0) for k, i in enumerate(ids) for d in [(0, 3, 9)[k % 3]]]
    want = plain_records(rows)
    assert {r[0] for r in want} >= {1, 4, 9}
    assert found(P.revised_panes(made(spark, rows))) == want


def test_no_clicks(spark):
    assert P.revised_panes(made(spark, [])).count() == 0
    assert P.revised_panes(made(spark, [(1, None, day(1), "a", 1.0)])).count() == 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """A restart after the batch's tables were written, but before the query noted it."""
    rows = P.batched(made(spark, [(i, day(i % 6, i % 24), day(i % 6, 23), "a", 1.0) for i in range(60)]))
    root = f"file://{tmp_path}/panes"
    mark = None
    for number in range(4):
        rows.where(f"batch = {number}").drop("batch").write.mode("append").parquet(f"{root}/feed")
        if number == 3:
            before = mark
        mark = P.advance(spark, root, number, mark)
    want = found(P.records(spark, root))
    (tmp_path / "panes/checkpoint/commits/3").unlink()
    crc = tmp_path / "panes/checkpoint/commits/.3.crc"
    if crc.exists():
        crc.unlink()
    assert P.advance(spark, root, 3, before) == mark and found(P.records(spark, root)) == want


def test_sql_agrees_on_small_table(spark, small):
    db = duckdb.connect()
    db.sql(f"create view clicks as select * from '{small}/clicks.parquet'")
    got = found(QUERIES["op13_pane_revisions"](spark, small))
    relation = db.sql(ORACLE_SQL["op13_pane_revisions"])
    at = [relation.columns.index(c) for c in ("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")]
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=str) and len(got) > 100
    rows = db.sql("select click_id, ts, arrived_at, kind, value from clicks").fetchall()
    assert got == plain_records(rows)
