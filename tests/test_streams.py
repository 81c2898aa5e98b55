"""Tables that many writers change, and streams over them."""

import glob
import os
import threading
import time

from pyspark.sql import functions as F

from kalkula.functions import text as T
from kalkula.operators.pdf import document_rows
from kalkula.operators.weights import nearest_then_adjust
from kalkula.sources import catalogs
from kalkula.sources.shared import cut_lineage
from kalkula.sources.upserts import Upserts
from kalkula.streaming import feeds

SHEETS = "file_id long, row_idx int, cells array<string>"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_last_row_of_a_key_stays(spark, tmp_path):
    t = Upserts(spark, str(tmp_path), "k", "at", buckets=4)
    assert t.read() is None
    make = lambda rows: spark.createDataFrame(rows, "k string, at long, v string")
    t.write(make([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None), (None, 1, "n")]))
    t.write(make([("a", 2, "late"), ("b", 2, "tie"), ("c", 1, "z")]))
    want = rows_of(make([("a", 3, "y"), ("b", 2, "tie"), ("c", 1, "z"), (None, 1, "n")]))
    assert rows_of(t.read()) == want
    assert rows_of(t.read(make([("c", 0, ""), ("none", 0, "")]))) == [("c", 1, "z")]
    t.write(make([]))
    assert rows_of(t.read()) == want
    assert t.compact(most=1) > 0 and t.compact(most=1) == 0
    assert rows_of(t.read()) == want
    assert all(len(f) == 1 for f in t.manifest().files.values())


def test_a_batch_is_written_once(spark, tmp_path):
    t = Upserts(spark, str(tmp_path), "k")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    for batch in (0, 0, 1, 1, 0):
        t.write(df.withColumn("v", F.lit(batch)), "w", batch)
    assert t.manifest().version == 2 and rows_of(t.read()) == [("a", 1)]


def test_many_writers_at_once(spark, tmp_path):
    """Each name once, no write lost, and compaction in between changes nothing."""
    path, errors = str(tmp_path / "log"), []

    def write(i):
        try:
            catalogs.append_unmatched(spark.createDataFrame([(f"name {n}",) for n in range(i, i + 12)] + [(" ",), (None,)], "name string"), path)
            Upserts(spark, path, "name").compact(most=1)
        except Exception as e:  # noqa: BLE001 (shown below)
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert [r[0] for r in rows_of(catalogs.read_unmatched(spark, path))] == sorted(f"name {n}" for n in range(15))
    versions = sorted(os.path.basename(p) for p in glob.glob(f"{path}/manifests/*.json"))
    assert [int(v[:12]) for v in versions] == list(range(1, len(versions) + 1))


def test_overrides_are_compacted_while_they_come(spark, tmp_path):
    batches = [[(f"k{j % 7}", i * 10 + j, f"v{i}") for j in range(9)] for i in range(12)]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "row_key string, ts long, name string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01)
    stream = spark.readStream.schema("row_key string, ts long, name string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feeds.stream_overrides(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    last = {}
    for k, ts, v in sorted((r for b in batches for r in b), key=lambda r: r[1]):
        last[k] = (k, ts, v)
    assert rows_of(feeds.current_overrides(spark, f"{tmp_path}/out")) == sorted(last.values())
    one = spark.createDataFrame([("k3",)], "row_key string")
    got = feeds.current_overrides(spark, f"{tmp_path}/out", keys=one)
    assert rows_of(got) == [last["k3"]]
    files = Upserts(spark, f"{tmp_path}/out", "row_key").manifest().files
    assert max(map(len, files.values())) <= 9
    assert len({f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()}) == 1


HEAD = ["No", "Uraian Pekerjaan", "Volume", "Satuan", "Harga Satuan", "Jumlah Harga"]


def sheet(file_id):
    rows = [["Judul", None, None, None, None, None], HEAD, ["A", "PEKERJAAN TANAH", None, None, None, None]]
    rows += [[str(i), f"Galian {i}", "2,5", "m3", "1.000", None] for i in range(1, 5)] + [["I", "BETON", None, None, None, None], ["1", "Cor", "1", "m3", "5", None]]
    return [(file_id, i, r) for i, r in enumerate(rows)]


def test_sheets_over_three_batches(spark, tmp_path):
    rows = [r for f in (1, 2, 3) for r in sheet(f)]
    n = len(sheet(1))
    schema = f"{SHEETS}, n_rows long"
    for part in range(3):  # each sheet's rows go to all three files, the later rows first; one sheet says its size only once
        own = [(*r, n if r[0] != 2 or r[1] == 4 else None) for r in rows if (n - r[1]) % 3 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = feeds.stream_ingest_boq(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    got = spark.read.parquet(f"{tmp_path}/out")
    want = feeds.ingested(spark.createDataFrame(rows, SHEETS))
    assert rows_of(got.select(want.columns)) == rows_of(want) and want.count() > 0


def test_a_sheet_that_stays_incomplete_goes_on_after_a_while(spark, tmp_path):
    rows = [(*r, 100) for r in sheet(1)]
    spark.createDataFrame(rows, f"{SHEETS}, n_rows long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{SHEETS}, n_rows long").parquet(f"{tmp_path}/in")
    query = feeds.stream_ingest_boq(stream, f"{tmp_path}/out", f"{tmp_path}/state", patience_ms=300, every="200 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and not [p for p in glob.glob(f"{tmp_path}/out/*/*.parquet") if spark.read.parquet(os.path.dirname(p)).count()]:
            assert query.exception() is None
            time.sleep(0.5)
    finally:
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == feeds.ingested(spark.createDataFrame(sheet(1), SHEETS)).count()


def test_recalculation_reads_the_touched_buckets_only(spark, tmp_path):
    items = spark.createDataFrame([(j, 100 * j + i, 7 * i + j) for j in range(40) for i in range(5)], "job_id long, item_id long, cost_cents long")
    catalogs.write_jobs_and_items(items.select("job_id").distinct(), items, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/items")
    changes = spark.createDataFrame([(3,), (3,), (None,), (17,)], "job_id long")
    got = feeds.recalculated(changes, stored)
    assert rows_of(got) == rows_of(nearest_then_adjust(items.filter("job_id in (3, 17)")).select("job_id", "item_id", "weight_steps"))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan


WORKS = [(1, "AT.1", "galian tanah biasa"), (2, "AT.2", "pasang keramik lantai merah"), (3, "AT.3", "beton k225"), (4, "AT.4", "pasang keramik lantai putih"), (5, "AT.5", "pekerjaan pipa air bersih")]


def works(spark):
    return spark.createDataFrame(WORKS, "id long, code string, name string").withColumn("plain", T.normalize_text("name"))


def test_sheets_are_matched_by_the_cascade(spark, tmp_path):
    """From a sheet's cells to a priced job with the matcher that users have: exact, names that hold all words (score 1, the first by id), none, a code."""
    head = [*HEAD, "Kode Analisa"]
    body = [["A", "PEKERJAAN TANAH", None, None, None, None, None], ["1", "Galian tanah biasa", "2", "m3", "1000", None, None], ["2", "pasang keramik lantai", "3", "m2", "100", None, None], ["3", "zzz qqq", "1", "ls", "700", None, None], ["4", "Galian tanah biasa", "1", "m3", "0", None, None], ["5", "lain sekali", "x", "m", "50", None, "AT.9"]]
    rows = [(f, i, r) for f in (1, 2) for i, r in enumerate([head, *body])]
    spark.createDataFrame(rows, SHEETS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SHEETS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feeds.stream_ingest_boq(stream, f"{tmp_path}/out", f"{tmp_path}/state", feeds.catalog_match(works(spark))).awaitTermination()
    got = sorted((r["file_id"], r["row_idx"], r["status"], r["match_id"], float(r["cost"]), r["weight_steps"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    own = [(2, "found", 1, 2000.0, 6557), (3, "found", 2, 300.0, 984), (4, "not found", None, 700.0, 2295), (5, "found", 1, 0.0, 0), (6, "found", None, 50.0, 164)]
    assert got == [(f, *o) for f in (1, 2) for o in own]


def fragments_of(doc):
    """Two pages: headers on the first only, a broken row, a section, a row with a link."""
    lines = [(1, 50, "No", "Uraian Pekerjaan", "Volume", "Satuan", "Harga Satuan"), (1, 80, "I", "PEKERJAAN TANAH", "", "", ""), (1, 100, "1", "Galian tanah", "2,5", "m3", "1000"), (1, 120, "", "biasa", "", "", ""), (1, 140, "2", "lihat www.toko.com", "1", "m2", "5"), (2, 30, "3", "beton k225", "4", "m3", "500"), (2, 60, "4", "zzz qqq", "1", "ls", "100")]
    return [(doc, page, float(x), float(y), t) for page, y, *cells in lines for x, t in zip((10, 120, 260, 360, 460), cells, strict=True) if t]


def test_pages_become_jobs(spark):
    """From fragments to priced jobs, matched by equal names."""
    frags = spark.createDataFrame([f for d in (1, 2) for f in fragments_of(d)], "doc_id long, page int, x double, y double, text string")
    typed = cut_lineage(document_rows(frags))
    assert [(r["description"], r["is_section"]) for r in typed.filter("file_id = 1").orderBy("row_idx").collect()] == [("PEKERJAAN TANAH", True), ("Galian tanah biasa", False), ("beton k225", False), ("zzz qqq", False)]
    jobs = feeds.priced_jobs(typed, lambda q: q.join(works(spark).selectExpr("name as query_id", "id", "1.0D as score"), "query_id"), "found")
    got = [(r["file_id"], r["description"], r["status"], r["match_id"], float(r["cost"]), r["weight_steps"]) for r in jobs.orderBy("file_id", "row_idx").collect()]
    own = [("Galian tanah biasa", "found", 1, 2500.0, 5435), ("beton k225", "found", 3, 2000.0, 4348), ("zzz qqq", "not found", None, 100.0, 217)]
    assert got == [(d, *o) for d in (1, 2) for o in own]
