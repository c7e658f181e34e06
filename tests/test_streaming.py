import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.agreement import compare, duck
from vouchline.operators import shape as sh
from vouchline.operators.enrich import heuristic
from vouchline.plans import catalog, quality
from vouchline.session import shuffles_freed, work_dir
from vouchline.sources import templates as tp
from vouchline.streaming import jobs

EVENT = "event_id long, ts timestamp, statement_id long, bank_code string, status string"
T0 = datetime.datetime(2024, 1, 1)


def test_parse_stream_replays_without_duplicates(spark):
    base = work_dir(spark, "stream-test")
    header = ["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"]

    def drop(sid):
        rows = [(sid, "axis", i, c) for i, c in enumerate([header, ["01-01-2024", f"UPI SWIGGY {sid}", "", "5.00", "", "95.00"]])]
        spark.createDataFrame(rows, "statement_id long, bank_code string, row_idx long, cells array<string>").coalesce(1).write.mode("append").parquet(f"{base}/in")

    for sids in ([1], [2, 1], []):
        for sid in sids:
            drop(sid)
        rows = spark.readStream.schema("statement_id long, bank_code string, row_idx long, cells array<string>").parquet(f"{base}/in")
        jobs.stream_statements(rows, tp.catalogue(spark), f"{base}/out", f"{base}/check").awaitTermination()
    got = jobs.read_statements(spark, f"{base}/out").select("statement_id", "payment_mode", "suggested_ledger").orderBy("statement_id").collect()
    assert [tuple(r) for r in got] == [(1, "UPI", "Food Expenses"), (2, "UPI", "Food Expenses")]


def _events(spark):
    rows = [(i, T0 + datetime.timedelta(seconds=37 * i), i // 5, f"b{i % 3}", "FAILED" if i % 3 == 0 and i % 2 == 0 else "REVIEWED") for i in range(400)]
    return spark.createDataFrame(rows, EVENT)


def test_alert_stream_equals_batch(spark):
    base = work_dir(spark, "alert-test")
    rates = jobs.failure_rates(_events(spark))
    want = sorted((r.bank_code, r.window_start, r.held_for) for r in jobs.held_alerts(rates).collect())
    ordered = rates.select("bank_code", "window_start", "failure_rate")
    cut = T0 + datetime.timedelta(hours=1)
    for part in (F.col("window_start") < F.lit(cut), F.col("window_start") >= F.lit(cut)):
        ordered.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("bank_code string, window_start timestamp, failure_rate double").parquet(f"{base}/in")
        jobs.stream_alerts(stream, f"{base}/out", f"{base}/check").awaitTermination()
    got = sorted((r.bank_code, r.window_start, r.held_for) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == want and got


def test_latest_status_ignores_repeats(spark):
    base = work_dir(spark, "status-test")
    events = _events(spark)
    events.unionByName(events.filter("event_id % 4 = 0")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/in")
    jobs.stream_latest_status(stream, f"{base}/out", f"{base}/check").awaitTermination()
    want = sorted(map(tuple, jobs.latest_status(events).select("statement_id", "status", "changes").collect()))
    assert sorted(map(tuple, jobs.read_latest(spark, f"{base}/out").select("statement_id", "status", "changes").collect())) == want


def test_statement_over_several_batches(spark):
    base = work_dir(spark, "stream-test")
    schema = "statement_id long, bank_code string, row_idx long, cells array<string>"
    cells = [["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"]] + [["0%d-01-2024" % i, "UPI SWIGGY", "", f"{i}.00", "", "95.00"] for i in (1, 2, 3)]
    for i in (2, 0, 3, 1, 2):
        spark.createDataFrame([(1, "axis", i, cells[i])], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        rows = spark.readStream.schema(schema).parquet(f"{base}/in")
        jobs.stream_statements(rows, tp.catalogue, f"{base}/out", f"{base}/check").awaitTermination()
    got = jobs.read_statements(spark, f"{base}/out").select("row_number", F.col("debit").cast("int")).orderBy("row_number").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 2), (3, 3)]


def test_batch_reads_only_the_statements_it_touches(spark):
    """Six batches of six new statements each; a batch also brings a row of the batch before, the last one a row of the first batch."""
    base = work_dir(spark, "stream-test")
    schema = "statement_id long, bank_code string, row_idx long, cells array<string>"
    header = ["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"]
    row = lambda sid, i: (sid, "axis", i, header if i == 0 else [f"0{i}-01-2024", "UPI SWIGGY", "", f"{i}.00", "", "95.00"])
    batches = 6
    for n in range(batches):
        rows = [row(10 * n + k, i) for k in range(6) for i in (0, 1)]
        rows += [row(10 * (n - 1), 2)] if n else []
        rows += [row(3, 2), row(3, 1)] if n == batches - 1 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.01)  # files are taken in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.stream_statements(stream, tp.catalogue, f"{base}/out", f"{base}/check", enrich=None, compact_every=3).awaitTermination()
    assert jobs._snapshots(spark, f"{base}/out-held") == [2, 5]
    read = []
    for n in range(batches):
        rows = jobs.touched_rows(spark, f"{base}/out", spark.read.parquet(f"{base}/in").schema, n)
        read.append((sorted({int(f.split("batch=")[1].split("/")[0]) for f in rows.inputFiles()}), spark.read.schema(schema).parquet(*rows.inputFiles()).count(), rows.count()))
    assert [r[0] for r in read] == [[0], *([n - 1, n] for n in range(1, batches - 1)), [0, batches - 2, batches - 1]]
    assert all(15 <= wanted <= seen <= 27 for _, seen, wanted in read[1:-1]) and read[-1][1] < 45  # of 80 rows
    got = jobs.read_statements(spark, f"{base}/out").groupBy("statement_id").agg(F.sum("debit").cast("int").alias("d")).collect()
    assert {r.statement_id: r.d for r in got} == {10 * n + k: 3 if (k == 0 and n < batches - 1) or (n, k) == (0, 3) else 1 for n in range(batches) for k in range(6)}


def test_late_status_counts(spark):
    base = work_dir(spark, "status-test")
    for i, (sid, hours, status) in enumerate([(1, 5, "REVIEWED"), (2, 0, "UPLOADED"), (1, 1, "FAILED"), (1, 5, "REVIEWED")]):
        spark.createDataFrame([(min(i, 2) if i != 3 else 0, T0 + datetime.timedelta(hours=hours), sid, "b", status)], EVENT).write.mode("append").parquet(f"{base}/in")
        jobs.stream_latest_status(spark.readStream.schema(EVENT).parquet(f"{base}/in"), f"{base}/out", f"{base}/check").awaitTermination()
    got = jobs.read_latest(spark, f"{base}/out").orderBy("statement_id").collect()
    assert [(r.statement_id, r.status, r.changes) for r in got] == [(1, "REVIEWED", 2), (2, "UPLOADED", 1)]


def test_status_snapshots(spark):
    """Late and repeated events over many batches, with snapshots in between; only the last snapshot and what came after it is read."""
    base = work_dir(spark, "status-test")
    rng = random.Random(2)
    seen = {}
    for _ in range(7):
        batch = [(i, T0 + datetime.timedelta(minutes=(i * 37) % 101), i % 6, "b", f"S{i % 4}") for i in rng.choices(range(60), k=15)]
        seen |= {r[0]: r for r in batch}
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")
        jobs.stream_latest_status(spark.readStream.schema(EVENT).parquet(f"{base}/in"), f"{base}/out", f"{base}/check", compact_every=3).awaitTermination()
    want = {}
    for i, at, sid, _, status in seen.values():
        n, best = want.get(sid, (0, None))
        want[sid] = (n + 1, max(best, (at, i, status)) if best else (at, i, status))
    latest = jobs.read_latest(spark, f"{base}/out")
    assert {r.statement_id: (r.changes, r.status, r.changed_at) for r in latest.collect()} == {k: (n, b[2], b[0]) for k, (n, b) in want.items()}
    assert jobs._snapshots(spark, f"{base}/out") == [2, 5]
    read = {f.split("/out")[1].rsplit("/", 1)[0] for f in latest.inputFiles()}
    assert read == {"-snapshots/upto=5", "/batch=6"}
    # a batch that is run again, with its snapshot, changes nothing
    jobs.compact_status(spark, f"{base}/out", 5)
    assert jobs.read_latest(spark, f"{base}/out").agg(F.sum("changes")).first()[0] == len(seen)


def test_template_changes(spark):
    base = work_dir(spark, "template-test")
    cats = {1: {"hdfc": "a", "axis": "a", "sbi": "a"}, 2: {"hdfc": "b", "axis": "a", "kotak": "a"}, 3: {"hdfc": "b", "sbi": "c", "kotak": "a"}, 5: {"hdfc": "b"}}
    schema = "version long, code string, fingerprint string"
    for versions in ([1], [2, 3], [2], [5]):  # two at once; an old one again
        rows = [(v, c, f) for v in versions for c, f in cats[v].items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        jobs.stream_template_changes(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/check").awaitTermination()
    changes = jobs.read_template_changes(spark, f"{base}/out")
    want = [(2, "hdfc", "modified"), (2, "kotak", "added"), (2, "sbi", "deleted"), (3, "axis", "deleted"), (3, "sbi", "added"), (5, "kotak", "deleted"), (5, "sbi", "deleted")]
    assert sorted(tuple(r) for r in changes.select("version", "code", "change").collect()) == want
    running = spark.createDataFrame([(1, "HDFC"), (2, "axis"), (3, "sbi"), (4, None)], "statement_id long, bank_code string")
    assert sorted(tuple(r) for r in jobs.statements_to_parse_again(changes, running).collect()) == [(1, 2), (3, 3)]


def test_second_run_adds_nothing(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "statement_id long, row_idx long")
    assert [r.statement_id for r in sh.unparsed_only(rows, spark.createDataFrame([(2,), (2,)], "statement_id long")).collect()] == [1]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_enriched_stream_is_compared_with_all_rows(spark):
    con = duck(SF)
    orders, more = con.execute("SELECT count(*), count(*) FILTER (o_orderkey % 4 = 0) FROM orders JOIN customer ON o_custkey = c_custkey").fetchone()
    assert 0 < more < orders
    for name in ("t4_enrich_stream", "t4_enrich_stream_whole"):
        note, _, good = compare(spark, con, SF, name, catalog.QUERIES[name], catalog.SQL[name])
        assert good and note == f"ok {orders} rows", note


def _orders(spark, folder, n=60):
    """Tables of a bank with six statements, one file each."""
    rows = [(i + 1, i % 6 + 1, "O" if i % 3 else "F", 100.0 + i, T0 + datetime.timedelta(days=i), "1-URGENT" if i % 4 == 0 else "5-LOW") for i in range(n)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_parts_arrive_as_many_files_and_each_batch_has_rows(spark, monkeypatch):
    base = work_dir(spark, "parts-test")
    monkeypatch.setattr(quality, "work_dir", lambda s, name: f"{base}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        quality._parsed_stream(spark, _orders(spark, f"{base}/tables"), None).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    arrived = spark.read.parquet(f"{base}/statements/in")
    files = arrived.groupBy((F.col("row_idx") % 3).alias("part"), F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    for part in range(3):
        sizes = [r.n for r in files if r.part == part]
        assert len(sizes) > 1 and max(sizes) < sum(sizes), part
    held = [spark.read.parquet(f"{base}/statements/table-held/batch={n}").count() for n in range(3)]
    assert held == [6, 6, 6] and not os.path.exists(f"{base}/statements/table-held/batch=3")


def test_a_bucket_is_written_by_several_tasks(spark):
    base = work_dir(spark, "bucket-test")
    batch = spark.range(200).select((F.col("id") % 50).alias("statement_id"), F.floor(F.col("id") / 50).alias("row_idx"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        jobs.keep_rows(batch, f"{base}/out", 0, buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(f"{base}/out-rows")
    assert kept.count() == 200 and len(kept.inputFiles()) > 1
    assert spark.read.parquet(f"{base}/out-held/batch=0").count() == 50


def test_a_batch_is_parsed_once(spark):
    """Enrichment uses its rows in many places: it gets those that the batch has stored."""
    base = work_dir(spark, "once-test")
    schema = "statement_id long, bank_code string, row_idx long, cells array<string>"
    cells = [["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"], ["01-01-2024", "UPI SWIGGY", "", "5.00", "", "95.00"]]
    spark.createDataFrame([(1, "axis", i, c) for i, c in enumerate(cells)], schema).coalesce(1).write.parquet(f"{base}/in")
    seen = []

    def enrich(parsed):
        seen.append([f.split("/out")[1].rsplit("/", 1)[0] for f in parsed.inputFiles()])
        return heuristic(parsed)

    jobs.stream_statements(spark.readStream.schema(schema).parquet(f"{base}/in"), tp.catalogue, f"{base}/out", f"{base}/check", enrich).awaitTermination()
    assert seen and all(set(files) == {"-parsed/batch=0"} for files in seen)
    assert [r.payment_mode for r in jobs.read_statements(spark, f"{base}/out").collect()] == ["UPI"]


def test_a_large_batch_is_enriched_in_slices_of_whole_statements(spark):
    """Every slice has its own statements, what it parsed is gone after it, and the result is that of one slice."""
    base = work_dir(spark, "slices-test")
    schema = "statement_id long, bank_code string, row_idx long, cells array<string>"
    header = ["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"]
    row = lambda sid, i: (sid, "axis", i, header if i == 0 else [f"0{i}-01-2024", "UPI SWIGGY", "", f"{i}.00", "", "95.00"])
    for part in ((0, 1), (2, 3)):
        spark.createDataFrame([row(sid, i) for sid in range(40) for i in part], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.01)
    got = {}
    for limit in (30, 1 << 22):
        seen = []

        def enrich(parsed):
            seen.append({r.statement_id for r in parsed.select("statement_id").distinct().collect()})
            return heuristic(parsed)

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        out = f"{base}/out{limit}"
        jobs.stream_statements(stream, tp.catalogue, out, f"{out}-check", enrich, slice_rows=limit).awaitTermination()
        got[limit] = sorted((r.statement_id, r.row_number, int(r.debit), r.payment_mode) for r in jobs.read_statements(spark, out).collect())
        assert os.listdir(f"{out}-parsed") == []
        assert sorted(sid for some in seen for sid in some) == sorted(2 * list(range(40)))
        assert len(seen) > 2 if limit == 30 else len(seen) == 2
    assert got[30] == got[1 << 22] == [(sid, n, n, "UPI") for sid in range(40) for n in (1, 2, 3)]


def test_writes_leave_no_shuffle_files(spark):
    base = work_dir(spark, "freed-test")
    ids = lambda: {int(name.split("_")[1]) for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(folder.toString()) for name in names if name.startswith("shuffle_")}
    spark.range(1000).repartition(3, "id").write.parquet(f"{base}/a")
    before = ids()
    with shuffles_freed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{base}/b")
    for _ in range(100):
        if ids() <= before:
            break
        time.sleep(0.1)
    assert ids() <= before and spark.read.parquet(f"{base}/b").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_answers_of_a_slice_come_in_whole_batches(spark):
    """An answer counts or not by all answers of its batch, also those to rows of another slice."""
    answers = spark.createDataFrame([(1, 7, 0, 1), (2, 7, 0, 1), (2, 7, 0, 3), (3, 7, 1, 1), (4, 8, 0, 1), (1, 9, 5, 2), (None, 7, 1, 1)], "id long, statement_id long, batch_no long, tier int")
    rows = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert sorted(tuple(r) for r in quality._answers_to(rows, answers).select(*answers.columns).collect()) == [(1, 7, 0, 1), (1, 9, 5, 2), (2, 7, 0, 1), (2, 7, 0, 3)]
