"""Recognition, files to invoices, command line, registry; models are stand-ins, since no weights exist here."""

import hashlib
import struct
import sys
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fakturnik import __main__ as cli
from fakturnik import models, pipeline
from fakturnik.config import Config, Ocr
from fakturnik.functions import amounts as A
from fakturnik.functions import dates as D
from fakturnik.functions.invoice import text_only, with_metadata
from fakturnik.operators import images, layout, ocr, recognition, tables
from fakturnik.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
SIGNS = (" ", "a", "b", "[UNK]")


def bright(tensor):
    """Detection: the darker a pixel of the picture, the likelier it is text."""
    return [np.where(tensor[:, :1] < -1.5, 0.9, 0.1)]


def reader(tensor):
    """Recognition: one step per sixteenth of the width; class 1 where it is dark, 0 elsewhere, 3 in the last."""
    shade = tensor[0, 0].mean(axis=0).reshape(16, -1).mean(axis=1)
    steps = np.zeros((1, 16, 4))
    steps[0, np.arange(16), np.where(shade < -0.2, 1, 0)] = 9.0
    steps[0, 15] = [0, 0, 0, 9.0]
    return [steps]


def upside(tensor):
    return [np.array([[0.1, 0.9]])]


def one_table(tensor):
    return [np.array([[3, 0.9, 0, 0, 608, 800], [3, 0.8, 0, 0, 608, 790], [4, 0.4, 0, 0, 9, 9]])]


def page(*boxes, h=96, w=160):
    image = np.full((h, w, 3), 255, dtype=np.uint8)
    for x1, y1, x2, y2 in boxes:
        image[y1:y2, x1:x2] = 0
    return image


def test_read_image():
    engine = ocr.Engine(bright, reader, signs=SIGNS)
    got = ocr.read_image(page((100, 8, 140, 18), (10, 10, 50, 20), (20, 60, 90, 80)), engine)
    assert [round(b[0][0]) for b in got] == [0, 90, 3] and all(b[2] == pytest.approx(0.9) for b in got)
    assert {b[1] for b in got} == {"a "} and all(b[4] == 0 for b in got)
    kept = ocr.read_image(page((10, 10, 50, 20)), ocr.Engine(bright, reader, upside, signs=SIGNS, options=Ocr(keep_unk=True)))
    assert kept[0][1] == "a[UNK]" and kept[0][4] == 180
    assert ocr.read_image(page(), engine) == []
    whole = ocr.read_image(page(), ocr.Engine(bright, signs=SIGNS, options=Ocr(enable_detection=False, enable_recognition=False)))
    assert whole[0][0] == [0, 0, 160, 0, 160, 96, 0, 96] and whole[0][1] == ""
    with pytest.raises(ValueError, match="no detection model"):
        ocr.read_image(page(), ocr.Engine())


def test_map_boxes_as_in_a_table(spark):
    r = np.random.default_rng(5)
    prob = np.where(r.random((30, 40)) < 0.55, 0.9, 0.2)
    boxes, scores = ocr.map_boxes(prob)
    df = spark.createDataFrame([(1, x, y, float(prob[y, x])) for y in range(30) for x in range(40)], "img_id int, x int, y int, p double")
    want = sorted((round(b["x1"], 6), round(b["y1"], 6), round(b["x2"], 6), round(b["y2"], 6)) for b in images.detection_boxes(df).collect())
    assert sorted((round(b[0], 6), round(b[1], 6), round(b[4], 6), round(b[5], 6)) for b in boxes) == want
    small = images.detection_boxes(df, scale=(2.0, 2.0), size=(15.0, 10.0)).agg(F.max("x2"), F.max("y2"), F.min("x1")).first()
    assert small[0] <= 15 and small[1] <= 10 and small[2] >= 0


def test_large_images_by_rounds(spark, monkeypatch):
    r = np.random.default_rng(6)
    grid = r.integers(0, 2, size=(12, 14))
    points = spark.createDataFrame([(k, int(x), int(y)) for k in (1, 2) for y, x in zip(*np.nonzero(grid), strict=True)], "img_id int, x int, y int")
    labels = lambda: {(p["img_id"], p["x"], p["y"]): p["component"] for p in images.components(points).collect()}
    inside = labels()
    monkeypatch.setattr(images, "IMAGE_RUNS", 5)
    assert labels() == inside


def test_recognize_rows(spark):
    good = page((10, 10, 50, 20))
    df = spark.createDataFrame([("a", 96, 160, 3, bytearray(good.tobytes())), ("b", 96, 160, 3, bytearray(b"short")), ("c", 96, 160, 3, None)], "origin string, height int, width int, nChannels int, data binary")
    got = {r["origin"]: r for r in ocr.recognize(df, ocr.Engine(bright, reader, layout=one_table, signs=SIGNS)).collect()}
    assert got["a"]["text"] == "a " and got["a"]["error"] is None and [r["region_type"] for r in got["a"]["regions"]] == ["table"]
    assert got["b"]["error"] and got["c"]["error"] and got["b"]["boxes"] == []
    texts = spark.createDataFrame([("x", None), ("", None)], "t string, n string").select(ocr.recognized_text(F.col("t"), F.array(F.struct(F.lit("p").alias("text")), F.struct(F.lit("q").alias("text")))).alias("v"))
    assert sorted(r["v"] for r in texts.collect()) == ["p\nq", "x"]


def rc4_pdf(text, revision):
    """A file encrypted with the empty password."""
    size, owner, ident, flags = (5 if revision == 2 else 16), bytes(range(32)), b"0123456789abcdef", -44
    key = hashlib.md5(files.PAD + owner + struct.pack("<i", flags) + ident).digest()[:size]
    if revision == 2:
        user = files.rc4(key, files.PAD)
    else:
        for _ in range(50):
            key = hashlib.md5(key).digest()[:size]
        user = files.rc4(key, hashlib.md5(files.PAD + ident).digest())
        for i in range(1, 20):
            user = files.rc4(bytes(c ^ i for c in key), user)
        user += bytes(16)
    own = hashlib.md5(key + b"\x04\0\0\0\0").digest()[: min(16, size + 5)]
    stream = files.rc4(own, zlib.compress(b"BT (" + text.encode("cp1250") + b") Tj ET"))
    lock = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (1 if revision == 2 else 2, revision, size * 8, flags, owner.hex().encode(), user.hex().encode())
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream", lock]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Encrypt 5 0 R /ID [<" + ident.hex().encode() + b"> <00>] >>\n%%EOF"


def test_known_rc4():
    assert files.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and files.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


@pytest.mark.parametrize("revision", [2, 3])
def test_empty_password(revision):
    got = files.read_pdf(rc4_pdf("Faktura zażółć", revision))
    assert got["error"] is None and got["pages"] == ["Faktura zażółć"]
    locked = rc4_pdf("x", revision).replace(b"/P -44", b"/P -60")
    assert files.read_pdf(locked)["error"] == "encrypted"


def image_pdf(pixels=b"abcdef", size=(2, 1), space=b"DeviceRGB"):
    picture = lambda data: b"<< /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent 8 >>\nstream\n%s\nendstream" % (*size, space, data)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] /Count 3 /Resources << /XObject << /Im0 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R >>",
        b"<< /Type /Page /Parent 2 0 R /Resources 7 0 R >>", picture(pixels), picture(pixels[::-1]), b"<< /XObject 8 0 R /Font << >> >>", b"<< /A 5 0 R /B 6 0 R >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << >> >> >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


def test_images_of_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(image_pdf())
    contents = files.pdf_contents(files.scan(spark, str(tmp_path)))
    got = sorted((r["number"], bytes(r["image"]["data"])) for r in files.images_of_pages(contents).collect())
    assert got == [(1, b"abcdef"), (2, b"abcdef"), (2, b"fedcba"), (3, b"abcdef"), (3, b"fedcba")]
    assert [bytes(r["data"]) for r in pipeline.pdf_page_images(contents).orderBy("number").collect()] == [b"cbafed", b"defabc", b"cbafed"]


def text_pdf(text):
    content = b"BT " + b" T* ".join(b"(" + t.encode("cp1250").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for t in text.split("\n")) + b" ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"%%EOF"


TEXT = "Faktura nr F/7/2024\nData wystawienia: 05.02.2024\nSprzedawca: Stolarnia Jesion\nNIP 123-456-32-18\nRazem: 1 230,00 PLN"


def test_files_to_invoices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(text_pdf(TEXT))
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF broken")
    dark = page((10, 10, 50, 20))
    (tmp_path / "in" / "c.pdf").write_bytes(image_pdf(dark.tobytes(), (160, 96)))
    engine = ocr.Engine(bright, reader, layout=one_table, signs=SIGNS)
    got = {r["path"].rsplit("/", 1)[1]: r for r in pipeline.process(spark, str(tmp_path / "in"), engine=engine).collect()}
    assert got["a.pdf"]["invoice"]["header"]["invoice_number"] == "F/7/2024" and got["a.pdf"]["invoice"]["metadata"]["source_type"] == "text_pdf" and got["a.pdf"]["invoice"]["metadata"]["ocr_engine"] is None
    assert got["b.pdf"]["invoice"] is None and got["b.pdf"]["error"] == "no pages"
    assert got["c.pdf"]["text"].startswith("a ") and got["c.pdf"]["invoice"]["metadata"]["source_type"] == "scanned_with_layout"
    bare = {r["path"].rsplit("/", 1)[1]: r["error"] for r in pipeline.process(spark, str(tmp_path / "in")).collect()}
    assert bare == {"a.pdf": None, "b.pdf": "no pages", "c.pdf": "no text"}


def test_items_of_table_regions(spark):
    from fakturnik.functions.invoice import parse_with_layout

    rows = [(1, TEXT, "Lp. | Nazwa | Netto\n1 | deska bukowa | 10,00 | 2,30 | 12,30", True), (2, TEXT, None, False), (3, TEXT, "bez tabeli", True)]
    df = spark.createDataFrame(rows, "doc_id int, text string, table_text string, has_layout boolean")
    got = {r["doc_id"]: r["invoice"] for r in parse_with_layout(df).collect()}
    assert [i["description"] for i in got[1]["line_items"]] == ["deska bukowa"] and got[1]["metadata"]["source_type"] == "scanned_with_layout"
    assert got[2]["metadata"]["source_type"] == "unknown" and got[3]["line_items"] == got[2]["line_items"] and got[2]["metadata"]["ocr_engine"] == "onnx"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(text_pdf(TEXT))
    run = lambda *a: cli.main(list(a), spark)
    assert run("process", str(tmp_path / "in" / "a.pdf"), "-f", "csv", "--validate", "--show-confidence") == 0
    out = capsys.readouterr()
    assert out.out.split("\n")[1].startswith("F/7/2024,2024-02-05,,,") and "confidence: 1.00" in out.err
    assert run("process", str(tmp_path / "in" / "a.pdf"), "-o", str(tmp_path / "a.json")) == 0 and '"invoice_number":"F/7/2024"' in (tmp_path / "a.json").read_text()
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF broken")
    assert run("batch", str(tmp_path / "in"), "-o", str(tmp_path / "out")) == 1
    capsys.readouterr()
    assert run("batch", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--continue-on-error", "--summary") == 0
    out = capsys.readouterr()
    assert '"failed": 1' in out.out and "b.pdf: no pages" in out.err and (tmp_path / "out" / "a.json").exists()
    assert spark.read.csv(str(tmp_path / "out" / "summary"), header=True).count() == 2
    conf = str(tmp_path / "c.json")
    assert run("-c", conf, "config", "init") == 0 and run("-c", conf, "config", "set", "pdf.min_text_length", "7") == 0
    assert Config.load(conf).pdf.min_text_length == 7
    capsys.readouterr()
    run("-c", conf, "config", "get", "pdf.min_text_length")
    assert capsys.readouterr().out.strip() == "7"


def test_registry(spark, tmp_path):
    (tmp_path / "mobile").mkdir()
    (tmp_path / "mobile" / "latin_dict.txt").write_bytes(b"a" * 1999)
    (tmp_path / "mobile" / "det.onnx").write_bytes(b"x")
    got = {(r["variant"], r["filename"]): r["status"] for r in models.registry(spark, str(tmp_path)).collect()}
    assert got["mobile", "latin_dict.txt"] == "ok" and got["mobile", "det.onnx"] == "incomplete" and got["server", "det.onnx"] == "missing"
    assert models.active(str(tmp_path)) == "mobile"
    models.use(str(tmp_path), "server")
    assert models.active(str(tmp_path)) == "server" and len(models.clean(str(tmp_path), "mobile")) == 2
    with pytest.raises(ValueError):
        models.use(str(tmp_path), "none")


def test_single_values(spark, value):
    assert value(A.first_amount, "a 1 234,56 b 7,00") == Decimal("1234.56") and value(A.first_amount, "x") is None
    assert [(m["value"], m["currency"]) for m in value(A.priced, "12,00 zł, 1 000,50 EUR i 3,00")] == [(Decimal("12.00"), "zł"), (Decimal("1000.50"), "EUR")]
    assert value(D.iso_date, "dnia 5 maja 2024") == "2024-05-05" and value(D.iso_date, "brak") is None
    df = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    assert text_only(df).columns == ["doc_id", "text", "invoice"] and with_metadata(df).first()["result"]["raw_text"] == TEXT


def test_table_access(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 2, "h"), (1, 1, 1, 1, 2, 1, "b"), (1, 2, 1, 0, 1, 1, "a"), (2, 3, 0, 0, 1, 1, "x")], "table_id int, ord int, row int, col int, row_span int, col_span int, content string")
    assert {r["content"] for r in tables.header(cells).collect()} == {"h", "x"} and tables.column_of(cells, 1).first()["content"] == "b"
    rows = tables.data_rows(cells).collect()
    assert [(r["table_id"], r["row"], [c["content"] for c in r["cells"]]) for r in rows] == [(1, 1, ["a", "b"])]
    spans = {r["content"]: (r["r"], r["c"]) for r in cells.select("content", tables.spans_rows(F.col("row_span")).alias("r"), tables.spans_columns(F.col("col_span")).alias("c")).collect()}
    assert spans == {"h": (False, True), "b": (True, False), "a": (False, False), "x": (False, False)}
    one_hot = lambda t: [1.0 if k == t else 0.0 for k in range(34)]
    steps = [one_hot(t) for t in (5, 3, 4, 3, 4, 6, 2)]
    df = spark.createDataFrame([([("loc", [[1.0]]), ("structure_probs", steps)],), ([("a", steps)],), ([],)], "o array<struct<name:string,steps:array<array<double>>>>")
    assert [(r["s"]["rows"], r["s"]["cols"], len(r["s"]["cells"])) for r in df.select(tables.structure(F.col("o")).alias("s")).collect()] == [(1, 2, 2), (1, 2, 2), (1, 1, 1)]


def test_regions_and_quads(spark):
    df = spark.createDataFrame([(1, "table", 0.0, 0.0, 10.0, 5.0), (2, "title", 0.0, 0.0, 1.0, 1.0), (3, "figure", 0.0, 0.0, 1.0, 1.0)], "region_id int, region_type string, x1 double, y1 double, x2 double, y2 double")
    r = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    got = df.filter("region_id = 1").select(*[v.alias(k) for k, v in layout.region_size(r).items()], layout.holds(r, F.lit(10.0), F.lit(5.0)).alias("edge"), layout.holds(r, F.lit(10.1), F.lit(5.0)).alias("out")).first()
    assert tuple(got) == (10.0, 5.0, 50.0, True, False)
    assert [r["region_id"] for r in layout.tables_of(df).collect()] == [1] and [r["region_id"] for r in layout.text_regions(df).collect()] == [2]
    q = spark.createDataFrame([([-1.0, 2.0, 50.0, 2.0, 50.0, 70.0, -1.0, 70.0],)], "b array<float>").select(layout.clip_quad(F.col("b"), F.lit(40), F.lit(60)).alias("q")).first()["q"]
    assert q == [0, 2, 40, 2, 40, 60, 0, 60]


def test_enhanced_pixels(spark):
    df = spark.createDataFrame([(1, x, 0, 255 if x != 4 else 0, 255 if x != 4 else 0, 255 if x != 4 else 10) for x in range(9)], "img_id int, x int, y int, r int, g int, b int")
    assert {r["x"] for r in images.enhance(df).filter("v = 0").collect()} == {4}


def onnx_identity():
    """A model of one Identity node with a free first side, written by hand in the format's encoding."""

    def field(n, data):
        size, head = len(data), b""
        while size > 127:
            head, size = head + bytes([size & 127 | 128]), size >> 7
        return bytes([n << 3 | 2]) + head + bytes([size]) + data

    number = lambda n, v: bytes([n << 3, v])
    side = field(1, field(2, b"N")) + field(1, number(1, 3))
    info = lambda name: field(1, name) + field(2, field(1, number(1, 1) + field(2, side)))
    graph = field(1, field(1, b"x") + field(2, b"y") + field(4, b"Identity")) + field(2, b"g") + field(11, info(b"x")) + field(12, info(b"y"))
    return number(1, 8) + field(7, graph) + field(8, field(1, b"") + number(2, 13))


def test_scoring_with_a_model_file(spark, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(onnx_identity())
    df = spark.createDataFrame([(i, ([1, 3], [float(i), 2.0, 3.0])) for i in range(40)], "k int, t struct<shape:array<int>,data:array<float>>").coalesce(1)
    got = {r["k"]: (r["shape"], r["data"]) for r in recognition.score(df, "k", "t", str(path)).collect()}
    assert got == {i: ([1, 3], [float(i), 2.0, 3.0]) for i in range(40)}


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\nbc\n\nż\n")
    assert [tuple(r) for r in recognition.dictionary(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()] == [(0, " "), (1, "a"), (2, "b"), (3, "ż")]
