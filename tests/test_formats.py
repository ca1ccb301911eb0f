import random

import pytest
from pyspark.sql import functions as F

from tests import evidence as E
from tracewell.functions import containers, formats
from tracewell.operators import inventory

DOCX = {"[Content_Types].xml": b"<x/>", "word/document.xml": b"<x/>"}
XLSX = {"[Content_Types].xml": b"<x/>", "xl/workbook.xml": b"<x/>"}


def disguised() -> dict[str, bytes]:
    rng = random.Random(1)
    return {
        "png_as.jpg": E.PNG,
        "random.txt": rng.randbytes(4096),
        "bom_random.txt": b"\xff\xfe" + rng.randbytes(4096),
        "wiped.png": rng.randbytes(2000),
        "bare_png": E.PNG,
        "payload.txt": ("안건 검토\n" * 3000).encode() + rng.randbytes(12000),
        "exe_as.jpg": E.PE,
        "exe_as.txt": E.PE,
        "docx_as.txt": E.archive(DOCX),
        "fake.exe": b"not a program\n" * 20,
        "elf_as.jpg": E.ELF,
        "raw_as.png": b"II*\0" + bytes(100),
        "plain.apk": E.archive({"photo.jpg": b"x"}),
        "docx_as.apk": E.archive(DOCX),
        "text_manifest.apk": E.archive({"AndroidManifest.xml": b"<manifest/>", "classes.dex": E.DEX}),
        "fake_dex.apk": E.archive({"AndroidManifest.xml": E.manifest(), "classes.dex": E.DEX, "classes2.dex": b"text"}),
        "plain.ipa": E.archive({"readme.txt": b"x"}),
        "fake_plist.ipa": E.archive({"Payload/X.app/Info.plist": b"text"}),
        "apk_as.docx": E.apk(),
        "docx_as.xlsx": E.archive(DOCX),
        "plain.hwpx": E.archive({"Contents/section0.xml": b"x"}),
        "cut.apk": E.apk()[:120],
    }


def honest() -> dict[str, bytes]:
    rng = random.Random(2)
    return {
        "a.py": b"print('hello')\n" * 20,
        "b.html": b"<html><body>x</body></html>\n" * 20,
        "c.log": b"[2025] INFO start\n" * 100 + bytes(3000),
        "latin1.txt": ("café naïve " * 300).encode("latin-1"),
        "sjis.txt": ("日本語のテキスト。" * 200).encode("shift_jis"),
        "u16.txt": ("한국어 메모 비밀번호 " * 200).encode("utf-16-le"),
        "doc.hwp": E.OLE + rng.randbytes(600),
        "Thumbs.db": E.OLE + rng.randbytes(600),
        "app.apk": E.apk(),
        "split.apk": E.archive({"AndroidManifest.xml": E.manifest()}),
        "app.ipa": E.ipa(),
        "report.docx": E.archive(DOCX),
        "macro.docm": E.archive(DOCX),
        "sheet.xlsx": E.archive(XLSX),
        "doc.hwpx": E.archive({"mimetype": b"application/hwp+zip"}),
        "app_as.zip": E.apk(),
        "ls": E.ELF,
        "libc.so.6": E.ELF,
        "photo.cr2": b"II*\0" + bytes(100),
        "blob.bin": rng.randbytes(3000),
        "empty.jpg": b"",
        "unknown.xyz": E.PNG,
        ".bashrc": b"alias x=y\n",
        "video.mov": b"\0\0\0\x18ftypisom" + bytes(50),
        "app.db": b"SQLite format 3\0" + bytes(100),
    }


def test_disguises_are_found_and_honest_files_are_left_alone(spark, tmp_path):
    for folder, files in (("bad", disguised()), ("good", honest())):
        for name, data in files.items():
            E.put(tmp_path, f"{folder}/{name}", data)
    files, _ = inventory.build(spark, str(tmp_path), signature=True)
    got = {r.rel_path: r.ext_mismatch for r in files.collect()}
    assert [n for n in disguised() if not got[f"bad/{n}"]] == []
    assert [n for n in honest() if got[f"good/{n}"]] == []


def test_heads_by_column_and_by_bytes_agree(spark):
    from tracewell.plans.catalog import HEADS

    rows = spark.createDataFrame([(h,) for h, _ in HEADS], "head string").select("head", formats.head_type(F.col("head")).alias("t")).collect()
    for r in rows:
        found = formats.by_header(bytes.fromhex(r.head))
        assert r.t == (found[0] if found else None)


@pytest.mark.parametrize(("data", "want"), [(E.PE, "application/x-dosexec"), (b"MZ is a city", "text/plain"), (b"BM" + bytes(12) + b"\x28\0\0\0", "image/bmp"), (bytes(20), "application/octet-stream")])
def test_structures_behind_short_marks(data, want):
    assert formats.by_head(data)[0] == want


def test_tampered_archives_have_no_kind(tmp_path):
    twice = E.archive({"AndroidManifest.xml": E.manifest()}, [("classes.dex", E.DEX), ("classes.dex", E.DEX)])
    kind, why = containers.inspect(str(E.put(tmp_path, "a.apk", twice)))
    assert kind == "" and "twice" in why
    data = bytearray(E.apk())
    at = data.rfind(b"PK\x01\x02")
    while at >= 0:  # the flag for encryption on every member
        data[at + 8] |= 1
        at = data.rfind(b"PK\x01\x02", 0, at)
    kind, why = containers.inspect(str(E.put(tmp_path, "b.apk", bytes(data))))
    assert kind == "" and "unreadable" in why


def test_entropy():
    assert formats.entropy_bits(b"") == 0.0 and formats.entropy_bits(b"aaaa") == 0.0
    assert formats.entropy_bits(bytes(range(256))) == 8.0
    assert formats.high_entropy(bytes(range(256))) and not formats.high_entropy(bytes(range(255)))
