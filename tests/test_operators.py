import datetime as dt
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fakturnik.config import Config
from fakturnik.operators import history, images, layout, profile, recognition, tables
from fakturnik.sources import files, sinks
from fakturnik.streaming import invoices as stream

SCHEMA = (
    "row_id bigint, load_id int, header struct<invoice_number:string,issue_date:date,due_date:date,invoice_type:string>, issuer struct<nip:string,bank_account:string,address:struct<street:string,postal_code:string,city:string>>,"
    "receiver struct<nip:string>, summary struct<total_net:decimal(20,2),total_vat:decimal(20,2),total_gross:decimal(20,2)>, field string, key string, value string"
)
DAY = dt.date(2024, 1, 1)


def invoice(row, load=1, number="FV/1", issued=DAY, due=DAY, kind="standard", nip="5261040828", account="PL1", street="ul. A 1", receiver=None, net=10, vat=2, gross=12):
    from decimal import Decimal as M

    m = lambda x: None if x is None else M(x)
    return (row, load, (number, issued, due, kind), (nip, account, (street, "00-001", "X")), (receiver,), (m(net), m(vat), m(gross)), "clash", "clash", "clash")


def test_broken_values(spark):
    bad = [
        invoice(1, nip="123"), invoice(2, number="FV 1"), invoice(3, number=""), invoice(4, gross=-12, net=-10, vat=-2), invoice(5, gross=-12, net=-10, vat=-2, kind="correction"), invoice(6, gross=13),
        invoice(7, due=dt.date(2023, 12, 31)), invoice(8, due=dt.date(2034, 1, 2)), invoice(9, due=dt.date(2034, 1, 1)), invoice(10, issued=None, due=dt.date(2050, 1, 1)), invoice(11, nip=None, number=None, gross=None, due=None),
        invoice(12, receiver="5261040829"), invoice(12, receiver="5261040829"),
    ]
    bad.append((13, None, None, None, None, None, None, None, None))
    got = {(r["field"], r["ref_id"]) for r in profile.quality_cases(spark.createDataFrame(bad, SCHEMA)).collect() if r["kind"] == "value"}
    assert got == {("issuer.nip", 1), ("header.invoice_number", 2), ("header.invoice_number", 3), ("summary.total_gross", 4), ("summary.total_gross", 6), ("header.due_date", 7), ("header.due_date", 8), ("receiver.nip", 12)}


def test_signed_deltas(spark):
    fields = profile.invoice_fields()
    one = profile.counts(spark.createDataFrame([invoice(1), invoice(2, number="FV/2")], SCHEMA), fields)
    two = profile.counts(spark.createDataFrame([invoice(3, load=2), invoice(4, load=2, number=None)], SCHEMA), fields)
    store = profile.CountStore(spark)
    store.commit(one)
    before = sorted(map(str, store.read().select("field", "load", "key", "n").collect()))
    store.commit(two)
    assert store.read().filter("load = 2").count() > 0
    store.commit(two, sign=-1)
    assert sorted(map(str, store.read().select("field", "load", "key", "n").collect())) == before


def test_store_is_opened_again(spark, tmp_path):
    """Counts outlive the object that wrote them; a load is withdrawn later; a commit without manifest does not count; parts are folded."""
    fields, folder = profile.invoice_fields(), str(tmp_path / "counts")
    load = lambda n: profile.counts(spark.createDataFrame([invoice(10 * n + i, load=n, number=f"FV/{i}") for i in range(3)], SCHEMA), fields)
    state = lambda s: sorted(map(str, s.read().select("field", "load", "key", "n").collect()))
    first = profile.CountStore(spark, folder)
    first.commit(load(1))
    one = state(first)
    again = profile.CountStore(spark, folder)
    again.commit(load(2))
    assert again.version == 2 and state(first) == state(again) != one
    load(3).write.parquet(f"{folder}/delta-3-broken")
    (tmp_path / "counts" / "manifest" / "v3").mkdir()
    assert profile.CountStore(spark, folder).version == 2
    profile.CountStore(spark, folder).commit(load(2), sign=-1)
    assert state(profile.CountStore(spark, folder)) == one
    assert sorted(map(str, again.read(1).select("field", "load", "key", "n").collect())) == one
    again.COMPACT = 3
    again.commit(load(4))
    assert len(again.parts()) == 1 and again.read().filter("load = 4").count() > 0 and again.read().filter("load = 2").count() == 0
    with pytest.raises(ValueError, match="no version"):
        profile.CountStore(spark, str(tmp_path / "none")).read()


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from fakturnik import runtime

    conf = SimpleNamespace(get=lambda *a: None)
    for master, fails in (("yarn", True), ("spark://h:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        if fails:
            with pytest.raises(RuntimeError):
                runtime.shared_folder(fake)
        else:
            assert runtime.shared_folder(fake).startswith("file:")


def test_departing_loads(spark):
    rows = [invoice(100 * load + i, load=load, number=f"FV/{100 * load + i}", gross=i + 10, net=None) for load in range(1, 7) for i in range(100)]
    rows += [invoice(900 + i, load=7, number="FV/7" if i < 60 else None, gross=(i + 10) * 1000, net=None, due=DAY + dt.timedelta(90)) for i in range(100)]
    got = {(r["field"], r["load"]) for r in profile.load_departures(profile.counts(spark.createDataFrame(rows, SCHEMA), profile.invoice_fields()), profile.invoice_fields()).collect()}
    assert got == {("header.invoice_number", 7), ("summary.total_gross", 7), ("header.due_date", 7)}


def test_profile_range_and_broken_values(spark, tmp_path):
    from fakturnik.plans import quality

    rows = [invoice(1, gross=-9, net=-9, vat=0), invoice(2, gross=-100, net=-100, vat=0), invoice(10, load=2, gross=9, net=9, vat=0), invoice(3, load=2, gross=1000, net=1000, vat=0, nip="123")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "invoices.parquet"))
    got = {r["field"]: r for r in quality.p4_profile_whole(spark, str(tmp_path)).collect()}
    assert [(got[f]["min_value"], got[f]["max_value"]) for f in ("summary.total_gross", "row_id")] == [("-100.00", "1000.00"), ("1", "10")]
    assert [got[f]["broken"] for f in ("summary.total_gross", "issuer.nip", "row_id")] == [2, 1, None] and got["issuer.nip"]["min_length"] == 3
    loads = quality.p4_load_measures(spark, str(tmp_path)).filter("field = 'summary.total_gross'").orderBy("load").collect()
    assert [r["middle"] for r in loads] == [1.5, 2.0] and all(r["apart"] is not None for r in loads)


def test_rare_notations_count_in_full(spark):
    rows = [invoice(100 * load + i, load=load, number=f"FV/{i}") for load in (1, 2, 3) for i in range(100)]
    rows += [invoice(400 + i, load=4, number=f"FV/{i}" if i < 60 else "-" * (i - 59)) for i in range(100)]
    got = {r["load"]: r["apart"] for r in profile.notation_distance(profile.counts(spark.createDataFrame(rows, SCHEMA), profile.invoice_fields())).filter("field = 'header.invoice_number'").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: pytest.approx(0.4)}


def test_loads_are_compared_by_small_plans(spark, monkeypatch):
    # the driver plans and runs them: one plan that repeats the counts' lineage for every use has 80 exchanges here
    plans, rows = [], [invoice(10 * load + i, load=load, number=f"FV/{i}") for load in (1, 2) for i in range(3)]
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or df
    monkeypatch.setattr(profile, "cut", lambda df, label="cut", cut=getattr(profile, "cut", None): cut(seen(df), label), raising=False)
    state = profile.CountStore(spark).commit(profile.counts(spark.createDataFrame(rows, SCHEMA), profile.invoice_fields()))
    seen(profile.notation_distance(state)), seen(profile.load_departures(state, profile.invoice_fields()))
    seen(profile.quality_cases(spark.createDataFrame(rows, SCHEMA)))
    assert max(plans) <= 15, plans


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert profile.quality_cases(none).count() == 0
    assert history.issuer_history(none).count() == 0


def test_history(spark):
    d = lambda n: DAY + dt.timedelta(n)
    rows = [
        invoice(1, issued=d(0), account="PL12"), invoice(2, issued=d(1), account="1 2", street="UL. A 1"), invoice(3, issued=d(2), account=None, street=None), invoice(4, issued=d(3), account="34"),
        invoice(5, issued=d(4), account="pl 12"), invoice(5, issued=d(4), account="pl 12"), invoice(6, issued=None), invoice(7, nip="123", issued=d(9)), invoice(8, nip=None),
    ]
    got = [(r["valid_from"], r["valid_to"], r["bank_account"]) for r in history.issuer_history(spark.createDataFrame(rows, SCHEMA)).orderBy("version").collect()]
    assert got == [(d(0), d(3), "12"), (d(3), d(4), "34"), (d(4), None, "12")]


def test_history_of_values_that_become_known(spark):
    d = lambda n: DAY + dt.timedelta(n)
    rows = [invoice(1, issued=d(0), account=None, street=None), invoice(2, issued=d(1), account="12", street=None), invoice(3, issued=d(2), account=None, street="B 2"), invoice(4, issued=d(3), account="34", street=None)]
    got = [(r["valid_from"], r["bank_account"], r["street"]) for r in history.issuer_history(spark.createDataFrame(rows, SCHEMA)).orderBy("version").collect()]
    assert got == [(d(0), "12", "b2"), (d(3), "34", "b2")]


def test_layout(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 0.0, 1.0), (1, 2, "b", 5.0, 10.0), (1, 3, "c", 0.0, 20.0), (1, 4, "d", 0.0, 30.0), (1, 5, None, 1.0, 31.0)], "doc int, box_id int, text string, x1 double, y1 double")
    assert layout.line_texts(boxes, ["doc"]).first()["text"] == "a | b\nc | d | "
    regions = spark.createDataFrame([(1, 1, "text", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "text", 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, "table", 0.7, 0.0, 0.0, 10.0, 9.0)], "p int, region_id bigint, region_type string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert {r["region_id"] for r in layout.suppress(regions, ["p"]).collect()} == {2, 3}  # the less sure of a pair stays


def token_model(tokens):
    cells, row, col, most, opened, rs, cs = [], 0, 0, 0, False, 1, 1
    for t in tokens:
        if t == 2:
            break
        if t == 5:
            col = 0
        elif t == 6:
            most, row = max(most, col), row + 1
        elif t == 3:
            opened, rs, cs = True, 1, 1
        elif t == 4 and opened:
            cells.append((row, col, rs, cs))
            col, opened = col + cs, False
        elif 7 <= t < 20:
            cs = min(max(t - 7, 1), 10)
        elif 20 <= t < 33:
            rs = min(max(t - 20, 1), 10)
    return cells, max(row, 1), max(most, 1)


def test_tokens(spark):
    r = np.random.default_rng(3)
    cases = [r.integers(0, 34, size=40).tolist() for _ in range(30)] + [[], [5, 3, 9, 4, 3, 4, 6, 2, 5, 3, 4, 6]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<int>").select("i", tables.decode_tokens(F.col("t")).alias("d"))
    for row in df.collect():
        cells, n, m = token_model(cases[row["i"]])
        assert ([tuple(c) for c in row["d"]["cells"]], row["d"]["rows"], row["d"]["cols"]) == (cells, n, m)


def test_ctc(spark):
    steps = [[0.0, 9.0, 0.0], [0.0, 9.0, 0.0], [9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]
    r = spark.createDataFrame([(steps,), ([],)], "s array<array<double>>").select(recognition.ctc(F.col("s"), ["", "a", "b"]).alias("r")).collect()
    assert r[0]["r"]["text"] == "aab" and r[0]["r"]["confidence"] > 0.99
    assert (r[1]["r"]["text"], r[1]["r"]["confidence"]) == ("", 0.0)


def test_components_and_threshold(spark):
    r = np.random.default_rng(1)
    grid = r.integers(0, 2, size=(9, 11))
    points = spark.createDataFrame([(1, int(x), int(y)) for y, x in zip(*np.nonzero(grid), strict=True)], "img_id int, x int, y int")
    got = {(p["x"], p["y"]): p["component"] for p in images.components(points).collect()}
    seen = {}
    for start in sorted(got, key=lambda p: (p[1], p[0])):
        todo = [start] if start not in seen else []
        while todo:
            x, y = todo.pop()
            if (x, y) in got and (x, y) not in seen:
                seen[x, y] = start
                todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    assert len(set(got.values())) == len(set(seen.values()))
    assert all((got[a] == got[b]) == (seen[a] == seen[b]) for a in got for b in got)
    v = r.integers(0, 255, size=(20, 17))
    px = spark.createDataFrame([(1, x, y, int(v[y, x])) for y in range(20) for x in range(17)], "img_id int, x int, y int, v int")
    for p in images.adaptive_threshold(px).collect():
        block = v[max(0, p["y"] - 7) : p["y"] + 8, max(0, p["x"] - 7) : p["x"] + 8]
        assert p["v"] == (255 if v[p["y"], p["x"]] > block.sum() // block.size - 5 else 0)


def test_resize_and_tensors(spark):
    df = spark.createDataFrame([(500, 300), (1920, 1080)], "w int, h int").select(images.resized(F.col("w"), F.col("h"), 960).alias("r")).collect()
    assert [(r["r"]["w"], r["r"]["h"]) for r in df] == [(500, 300), (960, 540)]
    image = np.zeros((100, 300, 3), dtype=np.uint8)
    assert images.detection_tensor(image)[0].shape == (1, 3, 128, 320)
    assert images.recognition_tensor(image).shape == (1, 3, 48, 320)
    assert images.padded_tensor(image).shape == (1, 3, 488, 488)
    assert images.crop(image, [5, 5, 50, 5, 50, 20, 5, 20]).shape == (15, 45, 3)


def make_pdf(text, image=True):
    content = zlib.compress(b"BT (" + text.encode("cp1250") + b") Tj ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(content) + content + b"\nendstream"]
    if image:
        objects.append(b"<< /Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 >>\nstream\nabcdef\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


def test_pdf_files(spark, tmp_path):
    text = "Faktura nr FV/1/2024, zażółć gęślą jaźń i jeszcze trochę słów"
    (tmp_path / "a.PDF").write_bytes(make_pdf(text))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.txt").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.pdf_contents(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.PDF", "b.pdf"}
    assert got["a.PDF"]["text"] == text and got["a.PDF"]["pdf_type"] == "Hybrid" and got["a.PDF"]["images"][0]["width"] == 2
    assert got["b.pdf"]["error"] == "no pages"


def test_summary_and_sinks(spark, tmp_path):
    from fakturnik.functions.invoice import parse

    rows = parse(spark.createDataFrame([("in/a.pdf", "Faktura nr F/1/2024\nRazem: 12,00"), ("in/b.pdf", None)], "path string, text string"))
    rows = rows.withColumn("error", F.when(F.col("text").isNull(), F.lit("no text"))).withColumn("processing_time_ms", F.lit(3))
    got = {r["filename"]: r for r in sinks.summary(rows).collect()}
    assert got["a.pdf"]["status"] == "success" and got["a.pdf"]["total_gross"] == "12.00" and got["b.pdf"]["invoice_number"] == ""
    assert sinks.counters(rows).first().asDict() == {"processed": 2, "successful": 1, "failed": 1}
    assert sinks.failures(rows).collect() == [("b.pdf", "no text")]
    for kind, ending, begin in (("json", "json", '{"header":'), ("csv", "csv", "invoice_number,"), ("text", "txt", "Invoice: F/1/2024")):
        assert sinks.write_each(rows, str(tmp_path / kind), kind) == 1
        assert [p.name for p in (tmp_path / kind).iterdir()] == [f"a.{ending}"] and (tmp_path / kind / f"a.{ending}").read_text().startswith(begin)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "Faktura nr F/1/2024\nRazem: 12,00", dt.datetime(2024, 1, 1)), (2, None, None)], "doc_id bigint, text string, received_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream.drain(stream.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "invoice.header.invoice_number").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "F/1/2024"), (2, "UNKNOWN")]


def test_config(tmp_path):
    c = Config()
    c.set("pdf.min_text_length", "80")
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")).get("pdf.min_text_length") == 80
    with pytest.raises(KeyError):
        c.set("pdf.nothing", "1")


def test_leaf_fields():
    schema = T._parse_datatype_string("a int, b struct<c:string,d:array<int>>")
    assert [f.name for f in profile.leaf_fields(schema)] == ["a", "b.c", "b.d"]
