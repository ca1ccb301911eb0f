"""Formats by their bytes, and whether an extension fits one."""

from __future__ import annotations

import mimetypes
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import containers, encoding
from .values import EXTENSION_SPELLINGS

# ---- fixed values: signatures and families of extensions -----------------------------------
SAMPLE = 8192
#: Leading bytes, MIME type and usual extension; the first that fits counts.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", ".png"),
    (b"SQLite format 3\x00", "application/vnd.sqlite3", ".sqlite"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage", ".doc"),
    (b"GIF87a", "image/gif", ".gif"),
    (b"GIF89a", "image/gif", ".gif"),
    (b"%PDF-", "application/pdf", ".pdf"),
    (b"PK\x03\x04", "application/zip", ".zip"),
    (b"PK\x05\x06", "application/zip", ".zip"),
    (b"PK\x07\x08", "application/zip", ".zip"),
    (b"bplist00", "application/x-bplist", ".plist"),
    (b"\xff\xd8\xff", "image/jpeg", ".jpg"),
    (b"\x1f\x8b", "application/gzip", ".gz"),
    (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed", ".7z"),
    (b"Rar!\x1a\x07", "application/vnd.rar", ".rar"),
    (b"\x7fELF", "application/x-executable", ""),
    (b"fLaC", "audio/flac", ".flac"),
    (b"OggS", "audio/ogg", ".ogg"),
    (b"ID3", "audio/mpeg", ".mp3"),
    (b"II*\x00", "image/tiff", ".tiff"),
    (b"MM\x00*", "image/tiff", ".tiff"),
)
RIFF = {b"WEBP": ("image/webp", ".webp"), b"WAVE": ("audio/x-wav", ".wav"), b"AVI ": ("video/x-msvideo", ".avi")}
BRANDS = {
    b"heic": ("image/heic", ".heic"),
    b"heix": ("image/heic", ".heic"),
    b"mif1": ("image/heif", ".heif"),
    b"avif": ("image/avif", ".avif"),
    b"avis": ("image/avif", ".avif"),
    b"qt  ": ("video/quicktime", ".mov"),
    b"M4A ": ("audio/mp4", ".m4a"),
    b"M4V ": ("video/x-m4v", ".m4v"),
    b"3gp4": ("video/3gpp", ".3gp"),
    b"3gp5": ("video/3gpp", ".3gp"),
    b"3gp6": ("video/3gpp", ".3gp"),
    b"3g2a": ("video/3gpp2", ".3g2"),
    b"crx ": ("image/x-canon-cr3", ".cr3"),
}
BMP_HEADERS = (12, 40, 52, 56, 64, 108, 124)
ISO_MEDIA = frozenset(".mp4 .m4v .m4a .m4b .m4p .mov .qt .3gp .3g2 .heic .heif .avif .avifs .f4v .cr3".split())
TIFF = frozenset(".tiff .cr2 .nef .nrw .dng .arw .srf .sr2 .orf .rw2 .pef .srw .3fr .erf .kdc .dcr .mos .iiq".split())
TEXT = frozenset(
    (
        ".txt .log .csv .tsv .json .xml .md .reg .ini .conf .cfg .yaml .yml .toml .srt .vtt .plist .svg .rtf .eml .vcf .ics .mbox .properties .pem .key "
        ".html .css .js .ts .py .sh .bat .ps1 .sql .java .kt .c .h .cpp .go .rs .rb .php"
    ).split()
)
ZIP = frozenset(
    (
        ".zip .docx .xlsx .pptx .docm .xlsm .pptm .odt .ods .odp .odg .hwpx .epub .jar .war .ear .apk .aar .aab .apks .xapk .ipa .pages .numbers .key "
        ".whl .xpi .nupkg .vsix .appx .msix .kmz .3mf .xps .oxps .cbz .usdz"
    ).split()
)
OLE = frozenset(".doc .xls .ppt .msg .hwp .msi .db".split())
ELF = frozenset(".so .elf .bin .o .ko .axf .prx .out .mod .oat .odex".split())
PE = frozenset(".exe .dll .sys .scr .ocx .cpl .com .efi .mui .drv".split())
SQLITE = frozenset((".sqlite", ".sqlite3", ".db"))
GZIP = frozenset((".gz", ".tgz", ".gzip", ".svgz"))
#: Extensions that are right for a MIME type besides its registered ones.
FITTING = {
    "text/plain": TEXT,
    "application/zip": ZIP - containers.STRUCTURED,
    "application/vnd.sqlite3": SQLITE,
    "application/x-sqlite3": SQLITE,
    "application/x-ole-storage": OLE,
    "application/cdfv2": OLE,
    "application/vnd.ms-office": OLE,
    "application/x-hwp": frozenset((".hwp",)),
    "application/vnd.hancom.hwp": frozenset((".hwp",)),
    "application/haansofthwp": frozenset((".hwp",)),
    "application/vnd.hancom.hwpx": frozenset((".hwpx",)),
    "application/x-bplist": frozenset((".plist",)),
    "image/jpeg": frozenset((".jpg",)),
    "application/java-archive": frozenset((".jar", ".apk", ".aar")),
    "application/x-dosexec": PE,
    "application/vnd.microsoft.portable-executable": PE,
    "application/x-7z-compressed": frozenset((".7z",)),
    "application/vnd.rar": frozenset((".rar",)),
    "application/x-rar": frozenset((".rar",)),
    "application/x-executable": ELF,
    "application/x-sharedlib": ELF,
    "application/x-pie-executable": ELF,
    "application/x-object": ELF,
    "application/x-coredump": ELF | {".core"},
    "application/gzip": GZIP,
    "application/x-gzip": GZIP,
    "image/tiff": TIFF,
    "audio/mpeg": frozenset((".mp3",)),
    **dict.fromkeys(
        ("video/mp4", "video/quicktime", "audio/mp4", "audio/x-m4a", "video/x-m4v", "video/3gpp", "video/3gpp2", "image/heic", "image/heif", "image/avif", "image/x-canon-cr3"),
        ISO_MEDIA,
    ),
    **{mime: frozenset((*exts, ".zip")) for mime, _, _, exts in containers.KINDS.values()},
}
#: Extensions whose files always begin with a known signature.
SIGNED = (ZIP | OLE | frozenset(".png .jpg .gif .pdf .sqlite .sqlite3 .gz .exe .dll .7z .rar .bmp .webp .wav .tiff .flac .ogg .heic".split())) - {".db", ".key"}
NEEDS_EXTENSION = ("image/", "video/", "audio/", "application/pdf")
EMPTY_TYPES = ("inode/x-empty", "application/x-empty")
UNKNOWN_TYPES = ("", "application/octet-stream")
#: Where a verdict comes from.
CONTAINER, HEADER, TEXTUAL, UNKNOWN, FAILED, LINK = "container", "header", "text", "unknown", "error", "symlink"
# ----------------------------------------------------------------------------------------------

_REGISTRY = mimetypes.MimeTypes()


def _spelled(ext: str) -> str:
    return EXTENSION_SPELLINGS.get(ext, ext)


KNOWN = TEXT | ZIP | OLE | TIFF | ISO_MEDIA | frozenset(e for exts in FITTING.values() for e in exts) | frozenset(_spelled(e) for e in _REGISTRY.types_map[True])


@lru_cache(maxsize=4096)
def fitting(mime: str, usual: str = "") -> frozenset[str]:
    """Extensions that a file of this type may have; empty when nothing is known."""
    found = {_spelled(e) for e in (*_REGISTRY.guess_all_extensions(mime), usual) if e}
    return frozenset(found | FITTING.get(mime, frozenset()) | (TEXT if mime.startswith("text/") else frozenset()))


def all_types() -> list[str]:
    """Every MIME type for which extensions are known."""
    return sorted({*FITTING, *_REGISTRY.types_map[True].values(), "image/bmp", *(m for m, _ in (*RIFF.values(), *BRANDS.values())), *(m for _, m, _ in SIGNATURES)})


def little(data: bytes) -> int:
    return int.from_bytes(data, "little")


def by_header(head: bytes) -> tuple[str, str, str, str] | None:
    """(type, extension, why, source) by the leading bytes alone."""
    found = RIFF.get(head[8:12]) if head[:4] == b"RIFF" else BRANDS.get(head[8:12], ("video/mp4", ".mp4")) if head[4:8] == b"ftyp" else None
    if found:
        return *found, f"{head[:4] if head[:4] == b'RIFF' else b'ftyp'!r} {head[8:12]!r}", HEADER
    for mark, mime, ext in SIGNATURES:
        if head.startswith(mark):
            return mime, ext, f"signature {mark[:8]!r}", HEADER
    if head.startswith(b"MZ") and len(head) >= 64:
        at = little(head[60:64])
        if at >= 64 and head[at : at + 4] == b"PE\0\0":
            return "application/x-dosexec", ".exe", "MZ and PE headers", HEADER
    if head.startswith(b"BM") and len(head) >= 18 and little(head[14:18]) in BMP_HEADERS:
        return "image/bmp", ".bmp", "BM and DIB headers", HEADER
    return None


def by_head(head: bytes) -> tuple[str, str, str, str]:
    """The same for any bytes: text and unknown data have verdicts too."""
    found = by_header(head)
    if found:
        return found
    name = encoding.detect(head)
    if name:
        return "text/plain", ".txt", f"text ({name})", TEXTUAL
    return "application/octet-stream", "", "unknown binary" if head.strip(b"\0") else "nothing but NUL bytes", UNKNOWN


def entropy_bits(data: bytes) -> float:
    import numpy as np

    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, np.uint8))
    p = p[p > 0] / len(data)
    return float(max(0.0, -(p * np.log2(p)).sum()))


def high_entropy(data: bytes) -> bool:
    return len(data) >= encoding.ENTROPY_BYTES and entropy_bits(data) >= encoding.ENTROPY_BITS


def probe(path: str) -> dict | None:
    """The format of a file; None if it can't be read."""
    try:
        with open(path, "rb") as f:
            head = f.read(SAMPLE)
            size = f.seek(0, 2)
            later = []
            for start in ((size - SAMPLE) // 2, size - SAMPLE) if size > 2 * SAMPLE else ():
                f.seek(start)
                later.append(f.read(SAMPLE))
    except OSError:
        return None
    if not head:
        mime, ext, why, source = EMPTY_TYPES[0], "", "empty", HEADER
    else:
        mime, ext, why, source = by_head(head)
    if mime == "application/zip":
        kind, why = containers.inspect(path)
        source = CONTAINER
        if kind:
            mime, ext = containers.KINDS[kind][:2]
    hidden = mime.startswith("text/") and any(x.strip(b"\0") and encoding.detect(x, partial=True) is None for x in later)
    if hidden:
        why += "; data that isn't text further inside"
    return {"sig_mime": mime, "sig_ext": ext, "sig_desc": why, "sig_source": source, "sig_high_entropy": any(map(high_entropy, (head, *later))), "hidden": hidden}


# ---- the rule as a column expression ---------------------------------------------------------


def _in(column: Column, values) -> Column:
    return column.isin(*sorted(values))


def extension_mismatch(ext: Column, mime: Column, usual: Column, hidden: Column, other_mime: Column | None = None, other_usual: Column | None = None) -> Column:
    """Whether an extension contradicts the content; all in the JVM, with the tables as literals.

    ``other_mime`` is a second opinion, asked when nothing is known of ``mime``.
    """
    table = F.create_map(*(x for m in all_types() for x in (F.lit(m), F.array(*map(F.lit, sorted(fitting(m)))))))
    none = F.array().cast("array<string>")

    def allowed(m: Column, u: Column) -> Column:
        known = F.coalesce(F.try_element_at(table, m), none)
        textual = F.when(m.startswith("text/"), F.array(*map(F.lit, sorted(TEXT)))).otherwise(none)
        return F.array_union(F.array_union(known, textual), F.when(F.coalesce(u, F.lit("")) != "", F.array(u)).otherwise(none))

    low = F.lower(F.coalesce(mime, F.lit("")))
    right = allowed(low, usual)
    if other_mime is not None:
        second = F.lower(F.coalesce(other_mime, F.lit("")))
        usable = ~_in(second, (*UNKNOWN_TYPES, *EMPTY_TYPES))
        right = F.when((F.size(right) == 0) & usable, allowed(second, other_usual)).otherwise(right)
    bare = low.startswith(NEEDS_EXTENSION[0])
    for p in NEEDS_EXTENSION[1:]:
        bare = bare | low.startswith(p)
    return (
        F.when(_in(low, EMPTY_TYPES), False)
        .when(ext == "", bare)
        .when(~_in(ext, KNOWN), False)
        .when(_in(low, UNKNOWN_TYPES), _in(ext, SIGNED | TEXT))
        .when(low.startswith("text/") & hidden & _in(ext, TEXT), True)
        .when(F.size(right) == 0, False)
        .otherwise(~F.array_contains(right, ext))
    )


def head_type(hex_head: Column) -> Column:
    """MIME type by upper-case hex of the leading bytes; null where only text or structure could tell.

    The signature table as a CASE expression, for heads that are columns already.
    """

    def at(byte: int, mark: bytes) -> Column:
        return F.substring(hex_head, 2 * byte + 1, 2 * len(mark)) == mark.hex().upper()

    out = None
    rules = [(at(0, b"RIFF") & at(8, form), mime) for form, (mime, _) in RIFF.items()]
    rules += [(at(4, b"ftyp") & at(8, brand), mime) for brand, (mime, _) in BRANDS.items()]
    rules += [(at(4, b"ftyp"), "video/mp4")] + [(at(0, mark), mime) for mark, mime, _ in SIGNATURES]
    for test, mime in rules:
        out = F.when(test, mime) if out is None else out.when(test, mime)
    return out
