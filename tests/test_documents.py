"""Binary documents and evidence with positions."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence as ev
from lodestone.sources import documents as sd


def docx(members: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return held.getvalue()


def part(*paragraphs: str, kind: str = "document") -> str:
    return f'<w:{kind} xmlns:w="{sd.WORD[1:-1]}">' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + f"</w:{kind}>"


def test_files_of_a_folder(spark, tmp_path):
    """Each file is a row: text, or what it needs, or an error; no bad file ends the job."""
    text = "Trahvisumma on 4000 eurot. Dokument saadi 10. augustil."
    files = {
        "teade.txt": text.encode(), "bom.TXT": "﻿Märge".encode(), "balti.txt": "Žiguli ja šokk!".encode("cp1257"), "wide.txt": "žžž".encode("utf-16"), "zero.txt": b"a\x00b", "late.txt": b"a" * 5000 + b"\x00b",
        "otsus.pdf": b"not a pdf", "real.pdf": b"%PDF-1.7 ...", "scan.png": sd.SIGNATURES["png"] + b"..", "foto.jpg": b"\xff\xd8\xff..", "fake.jpeg": b"GIF8", "run.exe": b"MZ", "none": b"x", "blank.txt": b" \n\t ",
        "sub/otsus.docx": docx({"word/document.xml": part("Menetleja otsus", " ja kaebetähtaeg. ", ""), "word/footer1.xml": part("jalus", kind="ftr"), "word/header2.xml": part("päis", kind="hdr"), "word/vbaProject.bin": "x", "../evil": "y", "word/headerX.xml": part("no", kind="hdr")}),
        "nobody.docx": docx({"word/other.xml": part("x")}), "broken.docx": b"PK\x03\x04 nothing", "notxml.docx": docx({"word/document.xml": "<w:p>"}), "entities.docx": docx({"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}),
        "bomb.docx": docx({"word/document.xml": " " * (sd.MOST_XML + 1)}), "two.docx": docx({"word/document.xml": part("a" * (sd.MOST_XML // 2)), "word/header1.xml": part("b" * (sd.MOST_XML // 2))}),
        "long.txt": b"x" * 130_000, "large.txt": b"y" * (sd.MOST_BYTES + 1),
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.file_name: r for r in sd.read_documents(spark, f"file://{tmp_path}").collect()}
    assert len(rows) == len(files)
    assert (rows["teade.txt"].text, rows["teade.txt"].method, rows["teade.txt"].byte_size) == (text, "text", len(text)) and re.fullmatch("DOC-[0-9A-F]{16}", rows["teade.txt"].document_id)
    assert rows["bom.TXT"].text == "Märge" and rows["balti.txt"].text == "Žiguli ja šokk!" and rows["wide.txt"].text == "žžž" and rows["late.txt"].text == "a" * 5000 + " b"
    assert rows["otsus.docx"].text == "Menetleja otsus\nja kaebetähtaeg.\njalus\npäis" and rows["otsus.docx"].method == "docx"
    assert len(rows["long.txt"].text) == sd.MOST_CHARS and rows["long.txt"].warnings == ["text was cut"]
    assert {n: r.needs for n, r in rows.items() if r.needs} == {"real.pdf": "layout", "scan.png": "recognition", "foto.jpg": "recognition"}
    assert {n: r.error for n, r in rows.items() if r.error} == {
        "zero.txt": "binary content in a text file", "otsus.pdf": "not a valid pdf", "fake.jpeg": "not a valid jpeg", "run.exe": "unsupported kind of file", "none": "unsupported kind of file",
        "blank.txt": "no readable text", "nobody.docx": "no body", "broken.docx": "not a readable DOCX", "notxml.docx": "not a readable DOCX", "entities.docx": "a text part has a document type",
        "bomb.docx": "text parts are too large", "two.docx": "text parts are too large", "large.txt": "file is too large",
    }
    assert rows["large.txt"].sha256 is None and rows["large.txt"].document_id is None


def test_a_member_that_understates_its_size(monkeypatch):
    """The real size of a member counts, whatever the archive says."""
    content = docx({"word/document.xml": part("x" * 500)})
    monkeypatch.setattr(sd, "MOST_XML", 300)
    plain = zipfile.ZipFile.getinfo

    def small(self, name):
        info = plain(self, name)
        info.file_size = 10
        return info

    with pytest.raises(sd.Unreadable, match="too large"):
        sd.docx_text(content)
    monkeypatch.setattr(zipfile.ZipFile, "getinfo", small)
    with pytest.raises(sd.Unreadable):
        sd.docx_text(content)


LAW = "Sõiduki juht peab peatuma, kui märguanne on antud."
CASE = "Kohus leidis, et märguanne oli antud nähtavalt ja õigeaegselt."


def accepted(spark, claims, sources, spans=((("DOC-1-P1-S1", "Trahvisumma on  4000 eurot.", 1, 100, "text")),), cases=(("CASE_A", CASE, True),)):
    c = spark.createDataFrame([(1, *x) for x in claims], "answer_id long, claim_id long, kind string, text string, status string")
    s = spark.createDataFrame([(1, *x) for x in sources], "answer_id long, claim_id long, seq int, kind string, id string, evidence string, page int, start int, end int")
    laws = spark.createDataFrame([("LS_1", LAW), ("LS_2", "muu")], "id string, text string")
    sp = spark.createDataFrame(list(spans), "span_id string, text string, page int, start int, method string")
    out, checked = ev.verify(c, s, laws, sp, spark.createDataFrame(list(cases), "id string, text string, verified boolean"))
    rows = out.collect()
    return (rows[0].accepted, rows[0].reason, rows[0].claim_id) if rows else None, checked.orderBy("claim_id", "seq").collect()


def law(claim=1, evidence="juht PEAB  peatuma", source="ls_1", kind="law", seq=1):
    return (claim, seq, kind, source, evidence, None, None, None)


def doc(claim=1, evidence="Trahvisumma", page=None, start=None, end=None, seq=1):
    return (claim, seq, "document", "doc-1-p1-s1", evidence, page, start, end)


def test_kinds_statuses_and_sources(spark):
    ok = lambda *a, **k: accepted(spark, *a, **k)[0]
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law()]) == (True, None, None)
    assert ok([(1, " LAW ", "x", "citation_verified")], [law()])[0]
    assert ok([(1, "law", "x", "INPUTS_VERIFIED")], [law()]) == (False, "kind and sources disagree", 1)
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law(), doc(seq=2)])[1] == "kind and sources disagree"
    assert ok([(1, "inference", "x", "INPUTS_VERIFIED")], [law(), doc(seq=2)])[0] and not ok([(1, "inference", "x", "INPUTS_VERIFIED")], [law()])[0]
    assert ok([(1, "document_excerpt", "x", "DOCUMENT_TEXT_VERIFIED")], [doc()])[0]
    ocr = [("DOC-1-P1-S1", "Trahvisumma on 4000 eurot.", 1, 0, "ocr")]
    assert not ok([(1, "document_excerpt", "x", "DOCUMENT_TEXT_VERIFIED")], [doc()], spans=ocr)[0] and ok([(1, "document_excerpt", "x", "OCR_REVIEW_REQUIRED")], [doc()], spans=ocr)[0]
    case = (1, 1, "case_law", "case_a", CASE[:30], None, None, None)
    assert ok([(1, "case_law", "x", "CASE_LAW_EVIDENCE_VERIFIED")], [case])[0]
    assert not ok([(1, "case_law", "See on siduv kohtupretsedent", "CASE_LAW_EVIDENCE_VERIFIED")], [case])[0]
    assert ok([(1, "case_law", "x", "CASE_LAW_EVIDENCE_VERIFIED")], [(*case[:4], CASE[:23], *case[5:])])[1] == "short quote"
    assert ok([(1, "case_law", "x", "CASE_LAW_EVIDENCE_VERIFIED")], [(*case[:4], CASE[:30].upper(), *case[5:])])[1] == "not quoted"
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law()], cases=[("CASE_A", CASE, False)]) == (False, "case law is not verified", None)
    # One bad claim rejects the whole answer.
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED"), (2, "law", "y", "EVIDENCE_VERIFIED")], [law(), law(2, "seda ei ole")]) == (False, "not quoted", 2)
    assert ok([(1, "law", " ", "EVIDENCE_VERIFIED")], [law()])[1] == "no text" and ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [])[1] == "no sources"
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law(source="ls_9")])[1] == "unknown source" and ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law(kind="poem")])[1] == "unknown kind"
    assert ok([(1, "law", "x", "EVIDENCE_VERIFIED")], [law(evidence=None)])[1] == "no evidence" and ok([], []) is None


def test_positions_of_documents(spark):
    claim = [(1, "document_excerpt", "x", "DOCUMENT_TEXT_VERIFIED")]
    ok = lambda *a: accepted(spark, claim, [doc(*a)])
    state, checked = ok(1, " 4000 eurot ", 1, 116, 126)
    assert state[0] and (checked[0].page, checked[0].start, checked[0].end, checked[0].method) == (1, 116, 126, "text")
    assert ok(1, "4000 eurot", 2)[0][1] == "wrong page" and ok(1, "4000 eurot", None, 15)[0][1] == "wrong start" and ok(1, "4000 eurot", None, None, 125)[0][1] == "wrong end"
    # A quote of a document has to stand there literally, unlike one of a statute.
    assert ok(1, "on 4000")[0][1] == "not literal" and ok(1, "ei ole")[0][1] == "not quoted"


def test_quotes_are_located_in_raw_text(spark):
    cases = [("a  B\tc", "b C", (3, 6)), ("x (y) \\E z", "(Y) \\e Z", (2, 10)), ("x.y", "x+y", None), ("", "a", None), ("abc", "", None), ("abc", " ", None), (None, "a", None), ("Tere ÕHTU", "õhtu", (5, 9)), ("aXa xa", "xa", (4, 6)), ("aXa", "xa", (1, 3))]
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string").select("k", ev.located(F.col("a"), F.col("b")).alias("at")).orderBy("k").collect()
    assert [tuple(r["at"]) if r["at"] else None for r in got] == [want for *_, want in cases]
