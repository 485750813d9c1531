"""Files built in Python, with the verdict each must get."""

import io
import random
import struct
import zipfile
import zlib

PDF = (
    b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R @@ >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\n"
    b"endobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\nxref\n0 4\ntrailer\n<< /Size 4 /Root 1 0 R >>\n%%EOF\n"
)


def pdf(fragment: bytes = b"") -> bytes:
    return PDF.replace(b"@@", fragment)


def archive(entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, body in entries:
            target.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


DOCX = [("[Content_Types].xml", b"<Types/>"), ("_rels/.rels", b"<Relationships/>"), ("word/document.xml", b"<w:document/>")]


def docx(*more) -> bytes:
    return archive(DOCX + list(more))


MACRO = docx(("word/vbaProject.bin", b"macro"))
EXTERNAL = b'<Relationships><Relationship Target="https://e.example/x" TargetMode="External"/></Relationships>'
INTERNAL = b'<Relationships><Relationship Target="media/image1.png"/></Relationships>'


def nested(levels: int, inner: bytes, name: str = "inner.zip") -> bytes:
    for _ in range(levels):
        inner = archive([(name, inner)])
    return inner


def segment(code: int, payload: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(payload) + 2) + payload


FRAME = segment(0xC0, b"\x08\x00\x0a\x00\x0a\x01\x01\x11\x00")
SCAN = segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"\x12\xff\x00\x34"


def jpeg(*segments, tail: bytes = b"") -> bytes:
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"".join(segments) + FRAME + SCAN + b"\xff\xd9" + tail


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(*chunks, width: int = 10, height: int = 10) -> bytes:
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    data = chunk(b"IDAT", zlib.compress(b"\0" * 11 * 10))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunks) + data + chunk(b"IEND", b"")


def gif(*blocks) -> bytes:
    head = b"GIF89a" + struct.pack("<HH", 10, 10) + b"\x80\0\0" + b"\0\0\0\xff\xff\xff"
    return head + b"".join(blocks) + b"\x2c\0\0\0\0\x0a\0\x0a\0\0\x02\x02\x44\x01\0\x3b"


def svg(body: str) -> bytes:
    return f'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink">{body}</svg>'.encode()


# id: (file name, bytes, type, status, finding types in order)
CASES = {
    "pdf_clean": ("a.pdf", pdf(), "pdf", "CLEAN", []),
    "pdf_js": ("a.pdf", pdf(b"/JS (evil()) /Launch /XFA 5 0 R"), "pdf", "SANITIZED", ["javascript", "launch_action", "xfa"]),
    "pdf_aa": ("a.pdf", pdf(b"/AA << /O << /S /JavaScript /JS (evil()) >> >>"), "pdf", "SANITIZED", ["javascript", "javascript", "auto_action"]),
    "pdf_aa_end": ("a.pdf", b"%PDF-1.4 /AA", "pdf", "CLEAN", []),
    "pdf_many": ("a.pdf", pdf(b"/JS " * 3000), "pdf", "SANITIZED", ["javascript"] * 3000),
    "pdf_text": ("a.pdf", b"just text", "pdf", "ERROR", []),
    "pdf_empty": ("a.pdf", b"", "pdf", "ERROR", []),
    "pdf_as_bin": ("a.bin", pdf(), "pdf", "CLEAN", []),
    "docx_clean": ("a.docx", docx(), "docx", "CLEAN", []),
    "docx_as_bin": ("a.bin", docx(), "docx", "CLEAN", []),
    "docm": ("a.docm", MACRO, "docx", "SANITIZED", ["macro"]),
    "docx_three": ("a.docx", docx(("word/vbaProject.bin", b"m"), ("word/embeddings/oleObject1.bin", b"o"), ("word/activeX/activeX1.xml", b"x")), "docx", "SANITIZED", ["macro", "ole_object", "activex"]),
    "docx_external": ("a.docx", docx(("word/_rels/document.xml.rels", EXTERNAL)), "docx", "SANITIZED", ["external_ref"]),
    "docx_internal": ("a.docx", docx(("word/_rels/document.xml.rels", INTERNAL)), "docx", "CLEAN", []),
    "docx_traversal": ("a.docx", docx(("../../../etc/passwd", b"x")), "docx", "SANITIZED", ["path_traversal"]),
    "docx_absolute": ("a.docx", docx(("/abs.txt", b"x")), "docx", "CLEAN", []),
    "docx_broken": ("a.docx", b"PK\x03\x04 broken", "docx", "ERROR", []),
    "docx_text": ("a.docx", b"just text", "docx", "ERROR", []),
    "xlsx_clean": ("a.xlsx", archive([("[Content_Types].xml", b"<t/>"), ("xl/workbook.xml", b"<w/>")]), "xlsx", "CLEAN", []),
    "xlsx_connections": ("a.xlsx", archive([("xl/workbook.xml", b"<w/>"), ("xl/connections.xml", b"<c/>")]), "xlsx", "SANITIZED", ["external_ref"]),
    "pptx_clean": ("a.pptx", archive([("ppt/presentation.xml", b"<p/>")]), "pptx", "CLEAN", []),
    "jpeg_clean": ("a.jpg", jpeg(), "jpeg", "CLEAN", []),
    "jpeg_meta": ("a.jpg", jpeg(segment(0xE1, b"Exif\0\0\x88\x25AB"), segment(0xFE, b"note"), tail=b"hidden"), "jpeg", "SANITIZED", ["exif", "gps_location", "comment"]),
    "jpeg_cut": ("a.jpg", jpeg()[:-2], "jpeg", "ERROR", []),
    "png_clean": ("a.png", png(), "png", "CLEAN", []),
    "png_text": ("a.png", png(chunk(b"tEXt", b"Comment\0x"), chunk(b"tIME", b"1234567")), "png", "SANITIZED", ["text_metadata", "timestamp"]),
    "png_huge": ("a.png", png(width=20000, height=20000), "png", "ERROR", []),
    "gif_clean": ("a.gif", gif(), "gif", "CLEAN", []),
    "gif_meta": ("a.gif", gif(b"\x21\xfe\x02hi\0", b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"), "gif", "SANITIZED", ["comment", "app_extension"]),
    "svg_clean": ("a.svg", svg('<rect width="1"/><circle r="2"/><path d="M0"/>'), "svg", "CLEAN", []),
    "svg_bad": ("a.svg", svg('<script>x()</script><a onclick="x()" xlink:href="javascript:y()">t</a><foreignObject><div onclick="z()"/></foreignObject><rect/>'), "svg", "SANITIZED", ["script", "event_handler", "javascript_uri", "foreign_object"]),
    "svg_entity": ("a.svg", svg('<a href=" java&#x73;cript:y()">t</a>'), "svg", "SANITIZED", ["javascript_uri"]),
    "svg_style": ("a.svg", svg("<style>p{width:expression(1)}</style><style>p{}</style>"), "svg", "SANITIZED", ["css_expression"]),
    "svg_nested_drop": ("a.svg", svg('<object><object><rect onload="x"/></object><rect/></object><g><rect/></g>'), "svg", "SANITIZED", ["object"]),
    "svg_external": ("a.svg", svg('<image href="https://e.example/i.png"/><rect style="behavior:url(x)"/>'), "svg", "SANITIZED", ["external_ref", "dangerous_css"]),
    "svg_cut": ("a.svg", b'<svg xmlns="x"><circle', "svg", "ERROR", []),
    "svg_lenient": ("a.svg", b'<svg xmlns="x"><g></svg>', "svg", "CLEAN", []),
    "svg_open": ("a.svg", b'<svg xmlns="x"><g></g>', "svg", "ERROR", []),
    "svg_end_of_nothing": ("a.svg", b'<svg xmlns="x"></b></svg>', "svg", "ERROR", []),
    "svg_unspaced": ("a.svg", svg('<circle r="3"onclick="x()"/>'), "svg", "SANITIZED", ["event_handler"]),
    "svg_long_reference": ("a.svg", svg('<a href="&#00000000106;avascript:x()">t</a>'), "svg", "SANITIZED", ["javascript_uri"]),
    "svg_implied_end": ("a.svg", svg("<foreignObject><p>x</foreignObject><rect/>"), "svg", "SANITIZED", ["foreign_object"]),
    "svg_text": ("a.svg", b"no markup", "svg", "ERROR", []),
    "zip_clean": ("a.zip", archive([("a.txt", b"text"), ("b/c.txt", b"more")]), "zip", "CLEAN", []),
    "zip_mixed": ("a.zip", archive([("clean.txt", b"x"), ("macro.docm", MACRO)]), "zip", "SANITIZED", ["macro"]),
    "zip_nested": ("a.zip", nested(2, MACRO, "x.docm"), "zip", "SANITIZED", ["macro"]),
    "zip_deep": ("a.zip", nested(4, b"x"), "zip", "BLOCKED", ["zip_bomb"]),
    "zip_three": ("a.zip", nested(2, archive([("a.txt", b"x")])), "zip", "CLEAN", []),
    "zip_paths": ("a.zip", archive([("../up.txt", b"x"), ("/abs.txt", b"x"), ("\\win.txt", b"x"), ("n" * 5000, b"x"), ("ok.txt", b"x")]), "zip", "SANITIZED", ["path_traversal", "path_traversal", "path_traversal", "oversized_path"]),
    "zip_bomb": ("a.zip", archive([(f"{i}.bin", b"\0" * (40 << 20)) for i in range(3)]), "zip", "BLOCKED", ["zip_bomb"]),
    "zip_big_entry": ("a.zip", archive([("big.bin", b"\0" * ((50 << 20) + 1)), ("ok.txt", b"x")]), "zip", "SANITIZED", ["oversized_entry"]),
    "zip_bad_member": ("a.zip", archive([("bad.pdf", b"text"), ("j.svg", b"x")]), "zip", "CLEAN", []),
    "zip_svg_png": ("a.zip", archive([("a.svg", svg('<g onload="x"/>')), ("b.png", png(chunk(b"tEXt", b"a\0b"))), ("c.pdf", pdf(b"/JS 1"))]), "zip", "SANITIZED", ["event_handler", "text_metadata", "javascript"]),
    "zip_empty": ("a.zip", archive([]), "zip", "CLEAN", []),
    "zip_text": ("a.zip", b"no zip", "zip", "ERROR", []),
    "zip_zero": ("a.zip", b"", "zip", "ERROR", []),
    "unknown": ("a.tar.gz", b"some bytes", "unknown", "UNSUPPORTED", []),
}


def random_files(n: int = 60):
    """Random bytes behind each magic: whatever they are, there must be one verdict row."""
    rng = random.Random(7)
    heads = [b"", b"%PDF", b"PK\x03\x04", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"<svg>", b"<?xml <svg"]
    return [(f"r{i}", f"r{i}.bin", heads[i % len(heads)] + rng.randbytes(rng.randrange(0, 400))) for i in range(n)]
