"""Generated PDF files against the text they were made of."""

from __future__ import annotations

import base64
import zlib

import pytest

from attestor.sources import pdf, pdf_objects


def literal(raw):
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def shown(lines, codes):
    """A content stream that shows lines below one another; codes gives a text's bytes."""
    return b"BT /F1 12 Tf 14 TL 72 700 Td " + b" T* ".join(b"<" + codes(x).hex().encode() + b"> Tj" if i % 2 else literal(codes(x)) + b" Tj" for i, x in enumerate(lines)) + b" ET"


def stream(body, extra=b"", packed=True):
    body = zlib.compress(body) if packed else body
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", extra, body)


def two_bytes(text):
    return b"".join((ord(c) * 3 % 65536).to_bytes(2, "big") for c in text)


def unicode_map(text):
    pairs = b"\n".join(b"<%04x> <%s>" % (ord(c) * 3 % 65536, c.encode("utf-16-be").hex().encode()) for c in sorted(set(text)))
    return b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n%d beginbfchar\n%s\nendbfchar endcmap" % (len(set(text)), pairs)


def written(objects, kind="table"):
    """A file of {number: body}; 1 is the catalogue. Its cross-references are a table, a stream with object streams, or missing."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\n"), {}
    inner = [n for n, b in objects.items() if kind == "stream" and b"stream" not in b]
    if inner:
        bodies = [objects[n] for n in inner]
        heads = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for b in bodies[:k])) for k, n in enumerate(inner)) + b" "
        objects = {n: b for n, b in objects.items() if n not in inner} | {90: stream(heads + b"\n".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(inner), len(heads)))}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    if kind == "table":
        top = max(places) + 1
        out += b"xref\n0 %d\n" % top + b"".join(b"%010d %05d %s \n" % (places.get(n, 0), 0, b"n" if n in places else b"f") for n in range(top))
        out += b"trailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF" % (top, at)
    elif kind == "stream":
        places[91] = at
        rows = b"".join(bytes([2]) + (90).to_bytes(4, "big") + bytes([inner.index(n)]) if n in inner else bytes([1 if n in places else 0]) + places.get(n, 0).to_bytes(4, "big") + b"\0" for n in range(92))
        up = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(rows[i : i + 6], rows[i - 6 : i] if i else b"\0" * 6, strict=True)) for i in range(0, len(rows), 6))
        out += b"91 0 obj\n" + stream(up, b"/Type /XRef /Root 1 0 R /Size 92 /W [1 4 1] /DecodeParms << /Predictor 12 /Columns 6 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    else:
        out += b"trailer << /Root 1 0 R >>"
    return bytes(out)


PAGES = [["The first page has a line (in brackets).", "Its second line ends \\ here."], ["Näive café, 12 % – “quoted”.", "Ελληνικά и русский 中文 text."], ["Third."]]


def book(kind, order=(0, 1, 2)):
    """Three pages in two branches of the tree, in another order than in the file, with fonts of three sorts."""
    text = "".join("".join(p) for p in PAGES)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count 3 /Kids [3 0 R 4 0 R] /Resources << /Font << /F1 10 0 R >> >> >>",
        9: stream(shown(PAGES[2], str.encode), packed=False),
        3: b"<< /Type /Pages /Count 2 /Kids [6 0 R 7 0 R] /Parent 2 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>",
        7: b"<< /Type /Page /Parent 3 0 R /Contents [8 0 R] /Resources << /Font << /F1 11 0 R >> >> >>",
        6: b"<< /Type /Page /Parent 3 0 R /Contents 5 0 R >>",
        5: stream(shown(PAGES[0], str.encode)),
        8: stream(shown(PAGES[1], two_bytes)),
        10: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
        11: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 12 0 R >>",
        12: stream(unicode_map(text)),
    }
    return written(objects, kind)


@pytest.mark.parametrize("kind", ["table", "stream", "none"])
def test_pages_in_the_order_of_the_tree(kind):
    assert pdf_objects.page_texts(book(kind)) == ["\n".join(p) for p in PAGES]


def one_page(content, fonts=b"", extra=None, packed=True, more=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << %s >> %s >> >>" % (fonts, more), 4: stream(content, packed=packed)}
    return pdf_objects.page_texts(written(objects | (extra or {})))


def test_operators_and_fonts():
    assert one_page(b"BT (a) Tj 0 -12 Td (b) Tj 5 0 Td (c) Tj 1 0 0 1 9 50 Tm [(W) 80 (ord) -300 (two)] TJ (x) ' 3 2 (y) \" ET") == ["a\nbc\nWord two\nx\ny"]
    assert one_page(b"BT /F1 9 Tf (\\001\\2A\\3) Tj ET", b"/F1 << /Encoding << /Differences [1 /fi /eacute 3 /uni4E2D] >> >>") == ["fiéA中"]
    ranged = {7: stream(b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <41> <43> <0061> <44> <45> [<00660066> <D83DDE00>] endbfrange")}
    assert one_page(b"BT /F1 9 Tf <4142434445> Tj ET", b"/F1 << /ToUnicode 7 0 R >>", ranged) == ["abcff\U0001f600"]
    form = {8: stream(b"BT (inside) Tj ET", b"/Subtype /Form /Type /XObject")}
    assert one_page(b"BT (before ) Tj ET /X Do BI /W 1 ID \x00(no)Tj EI BT ( after) Tj ET", extra=form, more=b"/XObject << /X 8 0 R >>") == ["before inside after"]
    assert one_page(b"BT (nested (brackets) \\\n here) Tj % (comment) Tj\n Tj ET q 1 0 0") == ["nested (brackets)  here"]
    assert one_page(b"") == [""]


def test_filters_and_later_versions_of_an_object():
    body = b"BT (eighty-five) Tj ET"
    coded = {4: b"<< /Filter [/ASCII85Decode /FlateDecode] /Length 5 >> stream\n" + base64.a85encode(zlib.compress(body)) + b"~>\nendstream"}
    assert one_page(b"", extra=coded) == ["eighty-five"]
    coded = {4: b"<< /Filter /ASCIIHexDecode >> stream\n" + body.hex().encode() + b">\nendstream"}
    assert one_page(b"", extra=coded) == ["eighty-five"]
    new = book("none") + b"\n9 0 obj\n" + stream(shown(["Changed."], str.encode)) + b"\nendobj"
    assert pdf_objects.page_texts(new)[2] == "Changed."
    cut = book("table")
    assert pdf_objects.page_texts(cut[: cut.rindex(b"xref\n0")] + b"startxref\n7\n%%EOF")[0] == "\n".join(PAGES[0])


@pytest.mark.parametrize("raw", [b"", b"not a pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", b"%PDF-1.4\ntrailer << /Root 1 0 R /Encrypt 3 0 R >>", b"%PDF-1.4 1 0 obj " + b"[" * 5000])
def test_what_has_no_pages_is_an_error(raw):
    with pytest.raises(ValueError):
        pdf_objects.page_texts(raw)


def test_trees_that_go_round_end():
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(b"BT (once) Tj ET")}
    assert pdf_objects.page_texts(written(objects)) == ["once"]


def test_files_become_documents(spark, tmp_path):
    for name, kind in (("a", "table"), ("b", "stream")):
        (tmp_path / f"{name}.pdf").write_bytes(book(kind))
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    want = " ".join(line for page in PAGES for line in page)
    assert [r.text for r in pdf.read_pdfs(spark, str(tmp_path)).orderBy("doc_id").collect()] == [want, want]
    assert [(r.doc_id[-7:], r.error) for r in pdf.unreadable(spark, str(tmp_path)).collect()] == [("bad.pdf", "ValueError: not a PDF")]
    rows = pdf.pages(pdf.pdf_files(spark, str(tmp_path)).where("doc_id like '%b.pdf'")).orderBy("page").collect()
    assert [(r.page, r.text, r.error) for r in rows] == [(i, "\n".join(p), None) for i, p in enumerate(PAGES)]
