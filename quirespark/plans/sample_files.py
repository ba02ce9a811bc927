"""PDF, mail and deck files made from keys, so that queries over given tables can exercise the parsers.

Everything in a file follows from its number; the queries' SQL states what a reader must find.
"""

from __future__ import annotations

import base64
import hashlib
import io
import quopri
import zipfile
import zlib

from ..functions import codecs

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


# -- encoders ---------------------------------------------------------------------------------


def lzw(data: bytes) -> bytes:
    """LZWDecode's inverse, with early change: a reader is one entry behind, and widens its codes when one more would fill it."""
    table: dict[bytes, int] = {}
    bits, held, since = [format(256, "09b")], b"", 0

    def put(code: int) -> None:
        nonlocal since
        known = 258 + max(0, since - 1)  # codes that the reader has
        bits.append(format(code, f"0{max(9, (known + 1).bit_length())}b"))
        since += 1

    code = lambda b: b[0] if len(b) == 1 else table[b]
    for byte in data:
        more = held + bytes([byte])
        if len(more) == 1 or more in table:
            held = more
            continue
        put(code(held))
        table[more] = len(table) + 258
        held = bytes([byte])
        if len(table) == 3000:
            put(code(held))
            put(256)
            table.clear()
            held, since = b"", 0
    if held:
        put(code(held))
    put(257)
    joined = "".join(bits)
    return int(joined.ljust(-(-len(joined) // 8) * 8, "0"), 2).to_bytes(-(-len(joined) // 8))


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and data[i + n : i + n + 1] == data[i : i + 1]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while i + n < len(data) and n < 128 and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


def predicted(data: bytes, columns: int, kind: int) -> bytes:
    """PNG rows of filter `kind`: 0 none, 1 left, 2 up, 3 average, 4 Paeth."""
    out, above = bytearray(), bytes(columns)
    for i in range(0, len(data), columns):
        row = data[i : i + columns].ljust(columns, b"\0")
        out.append(kind)
        for j, v in enumerate(row):
            a, b, c = row[j - 1] if j else 0, above[j], above[j - 1] if j else 0
            paeth = min((abs(a + b - c - a), 0, a), (abs(a + b - c - b), 1, b), (abs(a + b - c - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        above = row
    return bytes(out)


ENCODERS = {"FlateDecode": zlib.compress, "LZWDecode": lzw, "ASCII85Decode": lambda b: base64.a85encode(b) + b"~>", "ASCIIHexDecode": lambda b: b.hex().encode() + b">", "RunLengthDecode": run_length}
CHAINS = [(), ("FlateDecode",), ("LZWDecode",), ("ASCII85Decode",), ("ASCIIHexDecode",), ("RunLengthDecode",), ("ASCII85Decode", "FlateDecode"), ("ASCIIHexDecode", "LZWDecode")]


# -- PDF --------------------------------------------------------------------------------------


def stream(data: bytes, chain: tuple[str, ...] = (), more: str = "", length: int | None = None) -> bytes:
    for name in reversed(chain):
        data = ENCODERS[name](data)
    names = f" /Filter [{' '.join('/' + n for n in chain)}]" if chain else ""
    return f"<< /Length {len(data) if length is None else length}{names} {more} >>\nstream\n".encode() + data + b"\nendstream"


def assemble(objects: dict[int, bytes], style: str = "table", trailer: str = "") -> bytes:
    """style: table; stream (object and cross-reference streams); update (an old section behind /Prev); lost (no cross-references)."""
    out, at = bytearray(b"%PDF-1.6\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, body: bytes) -> None:
        at[n] = len(out)
        out.extend(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    def section(numbers: list[int], more: str) -> None:
        start = len(out)
        out.extend(b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in numbers))
        out.extend(f"trailer\n<< /Size {max(objects) + 2} /Root 1 0 R {trailer} {more} >>\nstartxref\n{start}\n%%EOF\n".encode())

    if style == "stream":
        packed = {n: b for n, b in objects.items() if b"\nstream\n" not in b}
        for n, body in objects.items():
            if n not in packed:
                put(n, body)
        holder, head, inner = max(objects) + 1, b"", b""
        for n, body in packed.items():
            head += b"%d %d " % (n, len(inner))
            inner += body + b"\n"
        put(holder, stream(head + inner, ("FlateDecode",), f"/Type /ObjStm /N {len(packed)} /First {len(head)}"))
        own, order = holder + 1, list(packed)
        at[own] = len(out)
        rows = b"".join(b"\2" + holder.to_bytes(3) + bytes([order.index(n)]) if n in packed else b"\1" + at[n].to_bytes(3) + b"\0" if n in at else bytes(5) for n in range(own + 1))
        table = predicted(rows, 5, 2)
        put(own, stream(table, ("FlateDecode",), f"/Type /XRef /Size {own + 1} /W [1 3 1] /Root 1 0 R /DecodeParms [<< /Predictor 12 /Columns 5 >>] {trailer}"))
        return bytes(out) + b"startxref\n%d\n%%%%EOF" % at[own]
    for n, body in objects.items():
        put(n, body if style != "update" or b"\nstream\n" not in body else stream(b"BT /F1 9 Tf 1 1 Td (old) Tj ET"))
    if style == "lost":
        return bytes(out) + b"trailer\n<< /Root 1 0 R " + trailer.encode() + b" >>\nstartxref\n7\n%%EOF"
    section(list(objects), "")
    if style == "update":
        before = out.rfind(b"xref\n", 0, out.rfind(b"startxref"))
        new = [n for n, b in objects.items() if b"\nstream\n" in b]
        for n in new:
            put(n, objects[n])
        section(new, f"/Prev {before}")
    return bytes(out)


def pdf(pages: list[bytes], resources: str = "", objects: dict[int, bytes] | None = None, catalog: str = "", page: str = "", style: str = "table", chain: tuple[str, ...] = (), trailer: str = "", length: int | None = None) -> bytes:
    """A file of pages with these contents, under a page tree of two levels whose upper one has the page size and resources."""
    first = 100
    body = {1: f"<< /Type /Catalog /Pages 2 0 R {catalog} >>".encode(), 4: FONT}
    body[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [3 0 R] /MediaBox [0 0 500 800] /Resources << /Font << /F1 4 0 R {resources if resources.startswith('/F') else ''} >> {'' if resources.startswith('/F') else resources} >> >>".encode()
    body[3] = f"<< /Type /Pages /Parent 2 0 R /Count {len(pages)} /Kids [{' '.join(f'{first + 2 * i} 0 R' for i in range(len(pages)))}] >>".encode()
    for i, content in enumerate(pages):
        body[first + 2 * i] = f"<< /Type /Page /Parent 3 0 R /Contents {first + 2 * i + 1} 0 R {page} >>".encode()
        body[first + 2 * i + 1] = stream(content, chain, length=length)
    return assemble(body | (objects or {}), style, trailer)


def locked(pages: list[bytes], method: str, title: bytes) -> bytes:
    """An encrypted file that an empty password opens: RC4 (128 bits), AESV2 or AESV3."""
    owner, identity = bytes(range(32)), b"0123456789abcdef"
    if method == "AESV3":
        key = hashlib.sha256(title).digest()
        check, salt = b"checking", b"the salt"
        user = codecs.hardened_hash(b"", check, 5) + check + salt
        held = codecs.aes_cbc_encrypt(codecs.hardened_hash(b"", salt, 5), bytes(16), key)
        rule = f"/Filter /Standard /V 5 /R 5 /Length 256 /P -4 /O <{(owner + bytes(16)).hex()}> /U <{user.hex()}> /UE <{held.hex()}> /OE <{bytes(32).hex()}> /Perms <{bytes(16).hex()}> /CF << /StdCF << /CFM /AESV3 /Length 32 >> >> /StmF /StdCF /StrF /StdCF"
    else:
        r = 4 if method == "AESV2" else 3
        key = codecs.key_of_empty_password(r, owner, -4, identity, 128, True)
        more = "/CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if r == 4 else ""
        rule = f"/Filter /Standard /V {4 if r == 4 else 2} /R {r} /Length 128 /P -4 /O <{owner.hex()}> /U <{bytes(32).hex()}> {more}"

    def hide(data: bytes, number: int) -> bytes:
        own = key
        if method != "AESV3":
            own = hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0" + b"sAlT" * (method == "AESV2")).digest()
        if method == "RC4":
            return codecs.rc4(own, data)
        pad = 16 - len(data) % 16
        return identity + codecs.aes_cbc_encrypt(own, identity, data + bytes([pad]) * pad)

    body = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: FONT, 7: f"<< {rule} >>".encode(), 8: f"<< /Title <{hide(title, 8).hex()}> >>".encode()}
    body[2] = f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 500 800] /Resources << /Font << /F1 4 0 R >> >> /Kids [{' '.join(f'{100 + 2 * i} 0 R' for i in range(len(pages)))}] >>".encode()
    for i, content in enumerate(pages):
        body[100 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {101 + 2 * i} 0 R >>".encode()
        body[101 + 2 * i] = stream(hide(content, 101 + 2 * i))
    return assemble(body, "table", f"/Encrypt 7 0 R /Info 8 0 R /ID [<{identity.hex()}> <{identity.hex()}>]")


def said(text: str, x: int, y: int, size: int = 10, font: str = "F1") -> bytes:
    return f"BT /{font} {size} Tf {x} {y} Td ({text}) Tj ET\n".encode()


def by_structure(n: int) -> bytes:
    """Two pages; the kind of cross-references changes with n, and so does whether /Length is right."""
    pages = [said(f"Doc {n} page {p}", 50 + n % 90, 700 - p, 8 + n % 5) for p in (1, 2)]
    return pdf(pages, style=("table", "stream", "update", "lost")[n % 4], length=3 if n % 4 == 0 and n % 3 == 0 else None)


def by_strings(n: int) -> bytes:
    """Literal strings with nested and escaped parentheses, octal codes and line ends; hexadecimal ones; names with #."""
    text = f"a(b{n})c \\(\\) \\101\\102\\n\\\\ x\\\ny".encode()
    hexed = f"Hex {n}".encode().hex().upper()
    return pdf([b"BT /F1 10 Tf 10 10 Td (" + text + b") Tj ET\nBT /F#31 10 Tf 10 30 Td <" + hexed[:3].encode() + b" \n" + hexed[3:].encode() + b"> Tj ET % a remark (\n" + said("end", 1, 50)])


def by_chain(n: int) -> bytes:
    words = " ".join(f"w{(n * k) % 97}" for k in range(40))
    return pdf([said(f"{words} {'z' * 30}", 20, 20)], chain=CHAINS[n % len(CHAINS)])


def by_lock(n: int) -> bytes:
    return locked([said(f"Locked {n}", 30, 40)], ("RC4", "AESV2", "AESV3")[n % 3], f"Title {n}".encode())


def by_outline(n: int) -> bytes:
    wide = lambda s: f"<FEFF{s.encode('utf-16-be').hex()}>"
    objects = {
        20: b"<< /First 21 0 R /Last 23 0 R >>", 21: f"<< /Title (Part {n}) /Parent 20 0 R /First 22 0 R /Next 23 0 R >>".encode(),
        22: f"<< /Title {wide(f'Kapitel {n} é漢')} /Parent 21 0 R >>".encode(), 23: f"<< /Title (Last {n}) /Parent 20 0 R >>".encode(),
        24: f"<< /Title {wide(f'Ünit {n}')} /Author (Writer {n % 7}) /Producer () >>".encode(),
    }
    return pdf([b""], objects=objects, catalog="/Outlines 20 0 R", trailer="/Info 24 0 R")


def by_paths(n: int) -> bytes:
    w, h = 20 + n % 50, 10 + n % 30
    return pdf([f"q 1 0 0 1 {n % 40} 100 cm 0.2 0.4 0.6 rg 10 20 {w} {h} re f Q\n1 0 0 RG 2 w q 2 0 0 2 0 0 cm 20 30 m 20 {60 + n % 9} l S Q\n0 0 0 1 k 100 100 m 200 100 l 200 200 l h B*\n5 5 m 15 25 35 25 45 5 c n".encode()])


def by_images(n: int) -> bytes:
    picture = stream(bytes(12), (), f"/Type /XObject /Subtype /Image /Width {2 + n % 3} /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")
    photo = b"<< /Type /XObject /Subtype /Image /Width 9 /Height 7 /Filter /DCTDecode /Length 4 >>\nstream\nabcd\nendstream"
    content = f"q {100 + n % 7} 0 0 50 20 {30 + n % 11} cm /I1 Do Q q 40 0 0 40 300 300 cm /I2 Do Q q 8 0 0 8 400 {n % 13} cm BI /W 3 /H 4 /BPC 8 /CS /G ID abcdefghijkl EI Q {said('after', 5, 5).decode()}"
    return pdf([content.encode()], "/XObject << /I1 20 0 R /I2 21 0 R >>", {20: picture, 21: photo})


def by_layers(n: int) -> bytes:
    """Optional content that is off, invisible text, clips and a stamp with an appearance."""
    objects = {20: b"<< /Type /OCG /Name (off) >>", 21: b"<< /Type /OCG /Name (on) >>", 22: f"<< /Type /Annot /Subtype /Stamp /Rect [100 100 {140 + n % 9} 120] /AP << /N 23 0 R >> >>".encode(), 23: stream(b"0 1 0 rg 0 0 10 10 re f", (), "/Type /XObject /Subtype /Form /BBox [0 0 10 10]"), 24: b"<< /Type /Annot /Subtype /Link /Rect [0 0 9 9] /AP << /N 23 0 R >> >>"}
    content = b"/OC /Off BDC " + said(f"off {n}", 10, 100) + b"EMC /OC /On BDC " + said(f"on {n}", 10, 200) + b"EMC BT 3 Tr /F1 10 Tf 10 300 Td (unseen) Tj 0 Tr ET q 0 0 50 60 re W n " + said("clipped", 300, 400) + b"Q "
    return pdf([content], "/Properties << /Off 20 0 R /On 21 0 R >>", objects, "/OCProperties << /OCGs [20 0 R 21 0 R] /D << /OFF [20 0 R] >> >>", "/Annots [22 0 R 24 0 R]")


def by_functions(n: int) -> bytes:
    """Tints by each kind of function, at n % 5 quarters."""
    t = (n % 5) / 4
    straight = "/FunctionType 2 /Domain [0 1] /C0 [0 0 0] /C1 [1 0.5 0.25] /N 1"
    curved = "/FunctionType 2 /Domain [0 1] /C0 [1 1 1] /C1 [0 0 0] /N 2"
    joined = f"/FunctionType 3 /Domain [0 1] /Bounds [0.5] /Encode [0 1 1 0] /Functions [<< {straight} >> << {straight} >>]"
    sampled = stream(bytes([0, 0, 255, 255, 0, 0]), (), "/FunctionType 0 /Domain [0 1] /Range [0 1 0 1 0 1] /Size [2] /BitsPerSample 8")
    program = stream(b"{ dup 0.5 gt { 1 exch sub 0 exch } { 0 exch 2 mul exch } ifelse 0.25 }", (), "/FunctionType 4 /Domain [0 1] /Range [0 1 0 1 0 1]")
    two = stream(bytes([0, 255, 255, 0]), (), "/FunctionType 0 /Domain [0 1 0 1] /Range [0 1] /Size [2 2] /BitsPerSample 8")
    space = lambda f, names="/Spot", base="/DeviceRGB": f"[/Separation {names} {base} {f}]"
    spaces = f"/ColorSpace << /S2 {space(f'<< {straight} >>')} /S2b {space(f'<< {curved} >>')} /S3 {space(f'<< {joined} >>')} /S0 {space('20 0 R')} /S4 {space('21 0 R')} /SN [/DeviceN [/A /B] /DeviceGray 22 0 R] >>"
    content = "".join(f"/{s} cs {t} {'0.5 ' if s == 'SN' else ''}scn {10 * i} 10 5 5 re f\n" for i, s in enumerate(("S2", "S2b", "S3", "S0", "S4", "SN")))
    return pdf([content.encode()], spaces, {20: sampled, 21: program, 22: two})


def by_spaces(n: int) -> bytes:
    """Colour spaces: gray, RGB, CMYK, indexed and by profile, from n."""
    a, b = (n % 6) / 5, (n % 11) / 10
    icc = stream(b"profile", (), "/N 4")
    content = f"{a} g 0 0 5 5 re f {a} {b} 0 rg 10 0 5 5 re f {a} 0 0 {b} k 20 0 5 5 re f /I cs {n % 3} sc 30 0 5 5 re f /P cs 0 {a} 0 {b} sc 40 0 5 5 re f {b} G 50 0 5 5 re S"
    return pdf([content.encode()], "/ColorSpace << /I [/Indexed /DeviceRGB 2 <FF0000 00FF00 0000FF>] /P [/ICCBased 20 0 R] >>", {20: icc})


def by_shading(n: int) -> bytes:
    ramp = "/Function << /FunctionType 2 /Domain [0 1] /C0 [1 0 0] /C1 [0 0 1] /N 1 >>"
    resources = f"/Shading << /A << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 0] {ramp} >> /R << /ShadingType 3 /ColorSpace /DeviceRGB /Coords [0 0 0 0 0 1] {ramp} >> >>"
    return pdf([f"q 10 20 {100 + n % 50} 30 re W n /{'AR'[n % 2]} sh Q".encode()], resources)


def by_fonts(n: int) -> bytes:
    """Glyph names, a ToUnicode map, code spaces of one and two bytes with widths by glyph, and codes that nothing decodes."""
    named = b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Times-BoldItalic /FirstChar 65 /Widths [500 600 700 800] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni4E2D /bullet /Euro] >> >>"
    to_unicode = stream(f"1 begincodespacerange <00> <FFFF> endcodespacerange 1 beginbfchar <41> <0058> endbfchar 2 beginbfrange <8140> <8142> <4E00> <8150> <8151> [<0031> <{ord('a') + n % 26:04X}>] endbfrange".encode())
    codes = stream(b"2 begincodespacerange <00> <7F> <8100> <9FFF> endcodespacerange 1 begincidrange <8140> <8142> 5 endcidrange 1 begincidchar <41> 3 endcidchar")
    wide = b"<< /Type /Font /Subtype /Type0 /BaseFont /Song /Encoding 21 0 R /ToUnicode 22 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [3 [250] 5 7 400] >>] >>"
    bare = b"<< /Type /Font /Subtype /Type0 /BaseFont /Bare /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 >>] >>"
    content = said("ABCD", 10, 10, 10, "F2") + b"BT /F3 10 Tf 10 30 Td <41 8140 8142 8151> Tj ET BT /F4 10 Tf 10 50 Td <00010002> Tj ET"
    return pdf([content], "/F2 20 0 R /F3 23 0 R /F4 24 0 R", {20: named, 21: codes, 22: to_unicode, 23: wide, 24: bare})


def by_grid(n: int) -> bytes:
    """A ruled table of 2 + n % 3 rows and 2 + n % 2 columns."""
    rows, cols = 2 + n % 3, 2 + n % 2
    lines = "".join(f"{100 + 80 * c} 600 m {100 + 80 * c} {600 - 24 * rows} l S " for c in range(cols + 1)) + "".join(f"100 {600 - 24 * r} m {100 + 80 * cols} {600 - 24 * r} l S " for r in range(rows + 1))
    return pdf([lines.encode() + b"".join(said(f"r{r}c{c}-{n}", 110 + 80 * c, 600 - 24 * r - 16, 9) for r in range(rows) for c in range(cols))])


def by_alignment(n: int) -> bytes:
    """6 + n % 3 lines of three entries each, with no rules."""
    return pdf([b"".join(said(f"k{r}c{c}", 60 + 150 * c, 700 - 14 * r) for r in range(6 + n % 3) for c in range(3))])


def by_charts(n: int) -> bytes:
    """Four bars, three wedges of a disc and one line of five points."""
    heights = (30, 60, 90, 120 + n % 30)
    bars = "0.2 0.4 0.6 rg " + "".join(f"{60 + 40 * i} 100 20 {h} re f " for i, h in enumerate(heights))
    wedges = "".join(f"{c} rg 380 600 m {380 + a} {600 + b} l {380 + d} {600 + e} {380 + f} {600 + g} {380 + h} {600 + i} c h f " for c, a, b, d, e, f, g, h, i in (("1 0 0", 50, 0, 50, 30, 30, 50, 0, 50), ("0 1 0", 0, 50, -30, 50, -50, 30, -50, 0), ("0 0 1", -50, 0, -50, -40, 50, -40, 50, 0)))
    return pdf([f"{bars}{wedges}0 0 0 RG 1 w 60 400 m 100 {430 + n % 9} l 140 410 l 180 450 l 220 {400 + n % 5} l S {said('Q1', 62, 88, 8).decode()}".encode()])


def by_outlines(n: int) -> bytes:
    """One filled shape of each kind, side by side."""
    x, round_ = n % 20, 0.5523
    oval = lambda cx, cy, a, b: f"{cx + a} {cy} m {cx + a} {cy + b * round_} {cx + a * round_} {cy + b} {cx} {cy + b} c {cx - a * round_} {cy + b} {cx - a} {cy + b * round_} {cx - a} {cy} c {cx - a} {cy - b * round_} {cx - a * round_} {cy - b} {cx} {cy - b} c {cx + a * round_} {cy - b} {cx + a} {cy - b * round_} {cx + a} {cy} c h f "
    soft = f"{x + 110} 500 m {x + 170} 500 l {x + 176} 500 {x + 180} 504 {x + 180} 510 c {x + 180} 530 l {x + 180} 536 {x + 176} 540 {x + 170} 540 c {x + 110} 540 l {x + 104} 540 {x + 100} 536 {x + 100} 530 c {x + 100} 510 l {x + 100} 504 {x + 104} 500 {x + 110} 500 c h f "
    plain = f"{x} 100 m {x + 30} 100 l {x + 15} 130 l h f {x + 40} 100 m {x + 70} 105 l {x + 65} 130 l {x + 42} 128 l h f {x + 100} 100 m {x + 120} 100 l {x + 130} 117 l {x + 120} 134 l {x + 100} 134 l {x + 90} 117 l h f {x + 200} 100 25 25 re f {x + 240} 100 50 20 re f "
    bent = f"{x + 300} 100 m {x + 310} 140 {x + 330} 140 {x + 340} 100 c S {x + 10} 300 m {x + 40} 320 l {x + 60} 300 l {x + 90} 330 l {x + 99} 310 l S {x + 200} 300 20 10 re {x + 240} 300 20 10 re f {x} 350 m {x + 50} 380 l S "
    return pdf([("0 0 500 800 re f " + plain + oval(x + 50, 520, 20, 20) + oval(x + 50, 600, 30, 15) + soft + bent).encode()])


def by_prose(n: int) -> bytes:
    """Two paragraphs of two lines, a heading of another size and a list entry."""
    return pdf([said(f"Heading {n}", 60, 740, 20) + said("The first line of a paragraph that is long enough to", 60, 700) + said(f"be continued by the second one, number {n}.", 60, 688) + said("Another paragraph stands here, further down, and it", 60, 640) + said("ends on its second line.", 60, 628) + said("1. An entry of a list", 60, 580)])


# -- mail -------------------------------------------------------------------------------------


def mail(n: int, body: str) -> bytes:
    """HTML in one of three charsets and two transfer encodings, with an image beside it and encoded headers."""
    charset = ("utf-8", "gb2312", "iso-8859-1")[n % 3]
    raw = body.encode(charset, "xmlcharrefreplace")
    packed, how = (quopri.encodestring(raw), "quoted-printable") if n % 2 else (base64.encodebytes(raw), "base64")
    subject = "=?utf-8?B?" + base64.b64encode(f"Café {n}".encode()).decode() + "?="
    sender = f"=?iso-8859-1?Q?J=F6rg_{n}?= <j{n}@example.org>"
    head = f'Subject: {subject}\r\nFrom: {sender}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related;\r\n\tboundary="edge{n}"\r\n\r\n--edge{n}\r\nContent-Type: text/html; charset="{charset}"\r\nContent-Transfer-Encoding: {how}\r\n\r\n'
    image = f"\r\n--edge{n}\r\nContent-Type: image/gif\r\nContent-ID: <pic{n}>\r\nContent-Transfer-Encoding: base64\r\n\r\nR0lGODlh\r\n--edge{n}--\r\n"
    return head.encode() + packed + image.encode()


# -- decks ------------------------------------------------------------------------------------

_XML = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _sp(i: int, kind: str = "", box: tuple | None = None, text: str = "", more: str = "", run: str = "", hidden: bool = False) -> str:
    ph = f"<p:ph {kind}/>" if kind else ""
    spot = '<a:xfrm><a:off x="%d" y="%d"/><a:ext cx="%d" cy="%d"/></a:xfrm>' % box if box else ""
    body = f"<p:txBody><a:bodyPr/><a:p><a:r>{run or '<a:rPr/>'}<a:t>{text}</a:t></a:r></a:p></p:txBody>" if text else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="N{i}"{" hidden=\"1\"" * hidden}/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{spot}<a:prstGeom prst="ellipse"/>{more}</p:spPr>{body}</p:sp>'


def deck(n: int) -> bytes:
    """Two slides in the reverse order of their files; title and body places come from master and layout; colours from the theme."""
    tree = lambda tag, inner, end="", bg="": f'<p:{tag} {_XML}><p:cSld name="L{n}">{bg}<p:spTree>{inner}</p:spTree></p:cSld>{end}</p:{tag}>'
    rels = lambda *items: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id=\"{i}\" Type=\"{_REL}/{k}\" Target=\"{t}\"/>" for i, k, t in items)}</Relationships>'
    scheme = '<a:solidFill><a:schemeClr val="accent1"><a:lumMod val="50000"/></a:schemeClr></a:solidFill>'
    style = f'<p:txStyles><p:titleStyle><a:lvl1pPr><a:defRPr sz="{3000 + 100 * (n % 9)}"><a:latin typeface="+mj-lt"/></a:defRPr></a:lvl1pPr></p:titleStyle><p:bodyStyle><a:lvl1pPr><a:defRPr sz="1800"/></a:lvl1pPr></p:bodyStyle></p:txStyles>'
    theme = f'<a:theme {_XML}><a:themeElements><a:clrScheme name="c"><a:dk1><a:srgbClr val="202020"/></a:dk1><a:lt1><a:srgbClr val="FEFEFE"/></a:lt1><a:accent1><a:srgbClr val="804020"/></a:accent1></a:clrScheme><a:fontScheme name="f"><a:majorFont><a:latin typeface="Garamond"/></a:majorFont><a:minorFont><a:latin typeface="Verdana"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
    cells = "".join(f'<a:tr h="{20000 + r}">' + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>v{r}{c}-{n}</a:t></a:r></a:p></a:txBody></a:tc>" for c in range(2)) + "</a:tr>" for r in range(2))
    table = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="Grid"/></p:nvGraphicFramePr><p:xfrm><a:off x="11" y="22"/><a:ext cx="60000" cy="40001"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tblGrid><a:gridCol w="25000"/><a:gridCol w="35000"/></a:tblGrid>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    own = (1000 + n, 2000, 3000, 4000)
    parts = {
        "ppt/presentation.xml": f'<p:presentation {_XML}><p:sldIdLst><p:sldId id="300" r:id="s2"/><p:sldId id="301" r:id="s1"/></p:sldIdLst><p:sldSz cx="9000000" cy="5000000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("s1", "slide", "slides/slide1.xml"), ("s2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide2.xml": tree("sld", _sp(2, 'type="title"', text=f"Head {n}") + _sp(3, 'type="body" idx="4"', text="Body", run='<a:rPr sz="1400" b="1"/>') + _sp(5, box=own, more=scheme)),
        "ppt/slides/slide1.xml": tree("sld", _sp(2, box=(1, 2, 3, 4), text="gone", hidden=True) + table),
        "ppt/slides/_rels/slide1.xml.rels": rels(("l", "slideLayout", "../slideLayouts/y.xml")), "ppt/slides/_rels/slide2.xml.rels": rels(("l", "slideLayout", "../slideLayouts/y.xml")),
        "ppt/slideLayouts/y.xml": tree("sldLayout", _sp(2, 'type="title"') + _sp(3, 'type="body" idx="4"', (500, 600, 700 + n, 800))), "ppt/slideLayouts/_rels/y.xml.rels": rels(("m", "slideMaster", "../slideMasters/z.xml")),
        "ppt/slideMasters/z.xml": tree("sldMaster", _sp(2, 'type="title"', (50, 60, 70, 80 + n)), f'<p:clrMap bg1="lt1" tx1="dk1" accent1="accent1"/>{style}', '<p:bg><p:bgPr><a:solidFill><a:schemeClr val="bg1"/></a:solidFill></p:bgPr></p:bg>'),
        "ppt/slideMasters/_rels/z.xml.rels": rels(("t", "theme", "../theme/t.xml")), "ppt/theme/t.xml": theme,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
