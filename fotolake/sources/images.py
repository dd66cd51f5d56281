"""Metadata bytes: EXIF directories, JPEG segments, PNG chunks, a one-page-per-image PDF; plain binary functions."""

from __future__ import annotations

import struct
import zlib

#: Sizes of EXIF value types: byte, ascii, short, long, rational, undefined, signed rational.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 10: 8}


def _packed(kind: int, value) -> tuple[int, bytes]:
    if kind == 2:
        data = value.encode("utf-8") + b"\0"
        return len(data), data
    if kind in (1, 7):
        return len(value), bytes(value)
    items = value if isinstance(value, list) else [value]
    if kind in (5, 10):
        return len(items), b"".join(struct.pack("<ii" if kind == 10 else "<II", *x) for x in items)
    return len(items), b"".join(struct.pack("<H" if kind == 3 else "<I", x) for x in items)


def exif(main: dict[int, tuple[int, object]], photo: dict | None = None, gps: dict | None = None) -> bytes:
    """A little-endian TIFF block of directories {tag: (type, value)}, entries sorted."""
    main, parts = dict(main), [p for p in ((0x8769, photo), (0x8825, gps)) if p[1]]
    for tag, _ in parts:
        main[tag] = (4, 0)
    out, at, places = b"II*\0\x08\0\0\0", 8, {}

    def directory(entries: dict, at: int) -> bytes:
        head, tail, base = struct.pack("<H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
        for tag in sorted(entries):
            kind, value = entries[tag]
            n, data = _packed(kind, places.get(tag, value))
            if len(data) <= 4:
                head += struct.pack("<HHI", tag, kind, n) + data.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, n, base + len(tail))
                tail += data + b"\0" * (len(data) % 2)
        return head + b"\0\0\0\0" + tail

    place = at + len(directory(main, at))
    for tag, entries in parts:
        places[tag] = place
        place += len(directory(entries, place))
    out += directory(main, at)
    for tag, entries in parts:
        out += directory(entries, places[tag])
    return out


def read_exif(data: bytes) -> dict[int, dict[int, object]]:
    """Directories by the tag that points to them (0 the first)."""
    e = "<" if data[:2] == b"II" else ">"
    out: dict[int, dict[int, object]] = {}
    todo = [(0, struct.unpack(e + "I", data[4:8])[0])]
    while todo:
        name, at = todo.pop()
        (n,) = struct.unpack(e + "H", data[at : at + 2])
        found: dict[int, object] = {}
        for k in range(n):
            tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            size = SIZES.get(kind, 1) * count
            p = at + 10 + 12 * k
            raw = data[p : p + size] if size <= 4 else data[(q := struct.unpack(e + "I", data[p : p + 4])[0]) : q + size]
            if kind == 2:
                found[tag] = raw.rstrip(b"\0").decode("utf-8", "replace")
            elif kind in (3, 4):
                v = list(struct.unpack(e + ("H" if kind == 3 else "I") * count, raw))
                found[tag] = v[0] if count == 1 else v
            elif kind in (5, 10):
                v = struct.unpack(e + ("I" if kind == 5 else "i") * 2 * count, raw)
                pairs = [*zip(v[::2], v[1::2], strict=True)]
                found[tag] = pairs[0] if count == 1 else pairs
            else:
                found[tag] = raw
            if tag in (0x8769, 0x8825):
                todo.append((tag, found[tag]))
        out[name] = found
    return out


def degrees(v: float) -> list[tuple[int, int]]:
    """Degrees, minutes and seconds as rationals."""
    total = round(abs(v) * 3600 * 10_000)
    d, rest = divmod(total, 3600 * 10_000)
    m, s = divmod(rest, 60 * 10_000)
    return [(d, 1), (m, 1), (s, 10_000)]


def inject_jpeg(jpeg: bytes, exif_block: bytes | None = None, xmp: bytes | None = None, icc: bytes | None = None) -> bytes:
    """Segments after the start, or after APP0; blocks too large for one segment are left out."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at = 2
    if jpeg[2:4] == b"\xff\xe0":
        at = 4 + struct.unpack(">H", jpeg[4:6])[0]
    out = b""
    for marker, head, data in ((0xE1, b"Exif\0\0", exif_block), (0xE1, b"http://ns.adobe.com/xap/1.0/\0", xmp), (0xE2, b"ICC_PROFILE\0\x01\x01", icc)):
        if data and len(head) + len(data) + 2 <= 0xFFFF:
            out += bytes([0xFF, marker]) + struct.pack(">H", len(head) + len(data) + 2) + head + data
    return jpeg[:at] + out + jpeg[at:]


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def inject_png(png: bytes, exif_block: bytes | None = None, xmp: str | None = None) -> bytes:
    """eXIf and iTXt chunks after the header."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at = 8 + 12 + struct.unpack(">I", png[8:12])[0]
    out = chunk(b"eXIf", exif_block) if exif_block else b""
    out += chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp.encode()) if xmp else b""
    return png[:at] + out + png[at:]


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB PNG."""
    rows = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def pdf(pages: list[tuple[bytes, int, int]], width_pt: float, height_pt: float) -> bytes:
    """A PDF with one JPEG (bytes, width, height) on each page."""
    out, offsets = bytearray(b"%PDF-1.4\n"), []

    def put(body: bytes) -> None:
        offsets.append(len(out))
        out.extend(b"%d 0 obj\n" % len(offsets) + body + b"\nendobj\n")

    kids = b" ".join(b"%d 0 R" % (3 + 3 * i) for i in range(len(pages)))
    put(b"<< /Type /Catalog /Pages 2 0 R >>")
    put(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), kids))
    for i, (jpeg, w, h) in enumerate(pages):
        draw = b"q %.2f 0 0 %.2f 0 0 cm /I Do Q" % (width_pt, height_pt)
        put(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (width_pt, height_pt, 4 + 3 * i, 5 + 3 * i))
        put(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        put(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (w, h, len(jpeg), jpeg))
    xref = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, xref))
