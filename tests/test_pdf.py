import zlib

from lithoflow.sources import pdf as P


def stream(entries, raw, end=b"\nendstream"):
    return b"1 0 obj\n<< " + entries + b" >>\nstream\n" + raw + end + b" endobj\n"


def content(body):
    return stream(b"/Filter /FlateDecode", zlib.compress(body))


def test_tokens():
    got = [t for t, _ in P.lex(b"/A#20b 12 -1.5 (a(b)\\051\\n) <48 6> [true] % no\n<</K(v)>>Tj", 0, 62)]
    assert got[0] == P.Name("A b") and got[1:3] == [12, -1.5] and got[3] == P.Text(b"a(b))\n", False) and got[4] == P.Text(b"H`", True)
    assert [t.text for t in got[5:9] if isinstance(t, P.Operator)] == [b"[", b"true", b"]", b"<<"] and got[-1] == P.Operator(b"Tj")


def test_dictionaries_with_inner_ones_and_references():
    data = b"<< /A << /B [1 2 (x)] >> /Length 5 0 R /C null /Filter [/FlateDecode /DCTDecode] >>"
    d = P.dictionary(data, 0, len(data))
    assert d["A"]["B"][:2] == [1, 2] and d["Length"] is None and d["C"] is None and [f.text for f in d["Filter"]] == ["FlateDecode", "DCTDecode"]
    assert P.opening(b"xx<< /A << >> >>", 16) == 2 and P.opening(b" >>", 3) == -1


def test_text_by_the_rules_and_as_usual():
    data = content(b"BT (no) (a\\(b\\) \\101 (n)) Tj [(c) -3 <64>] TJ ET (outside) Tj BT <3042> ' ET")
    assert P.page_text(data) == "noa(b) \\101 (n)cdあ"
    assert P.page_text(data, P.STRICT) == "noa(b) A (n)cd0B"
    assert P.page_text(content(b"BT (x) Td (y) Tj ET"), P.STRICT) == "y"
    assert P.page_text(stream(b"", b"BT (plain) Tj ET") + content(b"BT ( ) Tj ET") + content(b"no text")) == "" == P.page_text(b"")


def test_pictures_with_stated_lengths_inner_filters_and_no_end():
    jpg = b"\xff\xd8\xff endstream " + b"x" * 20
    entries = b"/Width 10 /Height 20 /Filter /DCTDecode /Length %d" % len(jpg)
    data = stream(entries, jpg) + stream(b"/Width 3 /Filter [/FlateDecode /DCTDecode]", zlib.compress(jpg)) + stream(b"/Filter /DCTDecode", b"no picture") + stream(b"/Filter /DCTDecode", jpg[:9], b"")
    got = list(P.pictures(data))
    assert [(p[1], p[3], p[4], p[5]) for p in got] == [("DCTDecode", 10, 20, jpg), ("DCTDecode", 3, None, jpg)]
    assert list(P.pictures(b"stream\n\xff\xd8\xff\nendstream")) == []


def test_pages():
    assert len(P.PAGE.findall(b"/Type /Page /Type/Page>> /Type /Pages /Type /PageX")) == 2


def test_null_contents(spark):
    files = spark.createDataFrame([("a.pdf", None), ("b.pdf", b"")], "source_pdf string, content binary")
    assert P.extract_pictures(files).count() == 0
    assert sorted(tuple(r) for r in P.extract_texts(files).collect()) == [("a.pdf", 1, "", 0, 0), ("b.pdf", 1, "", 0, 0)]
