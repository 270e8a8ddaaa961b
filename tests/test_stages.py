"""Generation with restarts, PDF files, and the state of streams."""

import json
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.operators import generation as G
from quillon.sources import pdf
from quillon.streaming import progress as P


def test_a_run_that_stops_goes_on_and_generates_nothing_twice(spark, tmp_path):
    path, asked = f"{tmp_path}/log", []
    items = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(3, "p3"), (None, "x")], "id long, prompt string")

    def model(stop_after):
        def run(batch):
            rows = batch.collect()
            if len(asked) + len(rows) > stop_after:
                raise RuntimeError("killed")
            asked.extend(r.id for r in rows)
            return spark.createDataFrame([(r.id, "" if int(r.id) % 10 == 0 else f"o{r.prompt}", int(r.id) % 15 == 1) for r in rows], "id string, output string, truncated boolean")

        return run

    saved = []

    def rescue(batch):
        rows = batch.collect()
        saved.extend((r.id, r.draft) for r in rows)
        return spark.createDataFrame([(r.id, "saved" if int(r.id) < 20 else " ", False) for r in rows], "id string, output string, truncated boolean")

    with pytest.raises(RuntimeError):
        G.generate(items, model(25), path, "f1", batch_rows=10, rescue=rescue)
    some = len(asked)
    assert 0 < some <= 25 and G.read_log(spark, path).count() == some
    assert G.generate(items, model(99), path, "f1", batch_rows=10, rescue=rescue) >= 1
    assert sorted(map(int, asked)) == list(range(40)) and sorted(int(i) for i, _ in saved) == [0, 1, 10, 16, 20, 30, 31]
    got = {int(r.id): (r.output, r.rescued) for r in G.outputs(spark, path, "f1").collect()}
    assert len(got) == 40 and got[5] == ("op5", False) and got[0] == got[16] == ("saved", True) and got[30] == ("", False) and got[31] == ("op31", False)
    assert G.generate(items, model(0), path, "f1", batch_rows=10, rescue=rescue) == 0  # failures are not tried again
    asked.clear()
    assert G.generate(items, model(99), path, "f2", batch_rows=100) == 1 and len(asked) == 40 and G.outputs(spark, path, "f2").count() == 40


def write_pdf(pages, compress=True, packed=False, extra=b"", font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=()):
    """Objects: 1 catalog, 2 page tree, 3 font, then page and contents of each."""
    kids = b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(pages)), 3: font}
    streams = {}
    for i, content in enumerate(pages):
        objects[4 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i)
        data = zlib.compress(content) if compress else content
        streams[5 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data)
    streams |= dict(more)
    if packed:  # dictionaries in a compressed object stream
        bodies, index, at = b"", [], 0
        for n, body in objects.items():
            index.append(b"%d %d" % (n, at))
            bodies += body + b" "
            at = len(bodies)
        head = b" ".join(index) + b" "
        data = zlib.compress(head + bodies)
        streams[900] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(objects), len(head), len(data), data)
        objects = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted((objects | streams).items())) + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


PAGES = [b"BT /F1 12 Tf 72 700 Td (First \\(page\\)) Tj 0 -14 Td [(spl) -20 (it) -300 (words)] TJ ET", b"BT /F1 12 Tf (second\\040caf\\351) Tj T* <74686972642E> Tj ET", b"BT (last) ' ET"]
TEXT = "First (page)\nsplit words\nsecond café\nthird.\nlast"


def test_pdf_files_give_their_pages_and_broken_ones_errors(spark, tmp_path):
    cmap = b"2 beginbfchar <0001> <9AD8> <0002> <8840> endbfchar 1 beginbfrange <0003> <0005> <0041> endbfrange"
    chinese = write_pdf([b"BT /F1 9 Tf <000100020003 0005> Tj ET"], font=b"<< /Type /Font /Subtype /Type0 /ToUnicode 50 0 R >>", more=[(50, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap))])
    files = {
        "a.pdf": write_pdf(PAGES), "sub/plain.PDF": write_pdf(PAGES, compress=False), "packed.pdf": write_pdf(PAGES, packed=True), "zh.pdf": chinese,
        "locked.pdf": write_pdf(PAGES, extra=b"/Encrypt 9 0 R "), "broken.pdf": write_pdf(PAGES).replace(b"stream\nx", b"stream\n\x00\x01y"), "no.pdf": b"hello", "empty.pdf": write_pdf([b"q Q"]), "cut.pdf": write_pdf(PAGES)[:120], "x.txt": b"%PDF-",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.path.split(f"{tmp_path.name}/")[1]: r for r in pdf.read_pdfs(spark, str(tmp_path)).collect()}
    assert set(rows) == set(files) - {"x.txt"}
    assert rows["a.pdf"].text == rows["sub/plain.PDF"].text == rows["packed.pdf"].text == TEXT and rows["a.pdf"].error is None and rows["zh.pdf"].text == "高血AC"
    assert {n: rows[n].error for n in ("locked.pdf", "no.pdf", "empty.pdf", "cut.pdf")} == {"locked.pdf": "PdfError: encrypted", "no.pdf": "PdfError: no PDF header", "empty.pdf": "no text", "cut.pdf": "PdfError: no pages"}
    assert rows["broken.pdf"].error.startswith("PdfError: damaged stream") and rows["broken.pdf"].text is None


def test_the_state_of_a_stream_survives_late_updates(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    state = P.RunState(spark, f"{tmp_path}/state.json")

    def run(name, fail):
        listener = P.StateListener(state, name, total=30)
        spark.streams.addListener(listener)
        try:
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            rows = stream.withColumn("x", F.when(F.lit(fail), F.raise_error(F.lit("bad"))).otherwise(F.col("id")))
            query = rows.writeStream.format("noop").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001
                assert fail
            until = time.monotonic() + 20
            while time.monotonic() < until and state.read().get("status") not in P.TERMINAL:
                time.sleep(0.2)
        finally:
            spark.streams.removeListener(listener)

    run("good", False)
    told = state.read()
    assert told["status"] == "done" and told["done"] == 30 and told["batch"] == 2
    assert state.update(status="running", done=99)["status"] == "done" and json.loads((tmp_path / "state.json").read_text())["done"] == 99
    state.path = f"{tmp_path}/other.json"
    run("bad", True)
    assert state.read()["status"] == "failed" and state.read()["error"]


def test_stages_that_are_done_are_not_run_again(spark, tmp_path):
    from quillon.operators.harness import run_stages

    ran, broken = [], [True]

    def items(before):
        ran.append("items")
        return spark.range(5)

    def scores(before):
        ran.append("scores")
        if broken[0]:
            raise RuntimeError("no model")
        return before["items"].withColumn("score", F.col("id") * 2)

    stages, state = [("items", items), ("scores", scores)], P.RunState(spark, f"{tmp_path}/state")
    with pytest.raises(RuntimeError):
        run_stages(spark, f"{tmp_path}/run", stages, state)
    assert state.read()["status"] == "failed" and state.read()["stage"] == "scores" and "no model" in state.read()["error"]
    broken[0], again = False, P.RunState(spark, f"{tmp_path}/again")
    done = run_stages(spark, f"{tmp_path}/run", stages, again)
    assert ran == ["items", "scores", "scores"] and sorted(r.score for r in done["scores"].collect()) == [0, 2, 4, 6, 8]
    assert again.read()["status"] == "done" and again.read()["stages_done"] == 2
    with pytest.raises(ValueError):
        run_stages(spark, f"{tmp_path}/run", [stages[0], stages[0]])


def test_reports_are_written_in_three_forms(spark, tmp_path, monkeypatch):
    from quillon.sources import report

    table = spark.createDataFrame([("中文|x", 0.5, None), ("<b>", 2.0, 3)], "name string, rate double, n int").orderBy("rate")
    text = report.write_report(spark, f"{tmp_path}/r", "Run <1>", {"By name": table}, ["A note & more"])
    assert text.split("\n") == ["Run <1>", "", "A note & more", "", "By name", "name    rate    n", "中文|x  0.5000  —", "<b>     2.0000  3"]
    assert (tmp_path / "r.md").read_text() == "# Run <1>\n\nA note & more\n\n## By name\n\n| name | rate | n |\n| --- | --- | --- |\n| 中文\\|x | 0.5000 | — |\n| <b> | 2.0000 | 3 |\n"
    page = (tmp_path / "r.html").read_text()
    assert "<title>Run &lt;1&gt;</title>" in page and "<td>&lt;b&gt;</td><td>2.0000</td>" in page and "<p>A note &amp; more</p>" in page
    monkeypatch.setattr(report, "MOST_ROWS", 1)
    with pytest.raises(ValueError):
        report.write_report(spark, f"{tmp_path}/big", "x", {"t": table})
    assert not (tmp_path / "big.md").exists()
