"""Folders in, tables out: every command against files that the tests write."""

import csv
import json
import os
import shutil

import pytest

from tests import evidence as E
from tracewell import cli, schemas, sink
from tracewell.operators import content, inventory, snapshot, validate
from tracewell.sources import artifacts, files


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


@pytest.fixture
def folder(tmp_path):
    return E.folder(tmp_path / "evidence")


def run(spark, tmp_path, command, root, *more):
    out = tmp_path / f"{command}.csv"
    flag = "--" + cli.RESULTS[command].replace("_", "-")
    cli.main([command, str(root), "--out-dir", str(tmp_path / "outputs"), flag, str(out), *more], spark)
    return read(out)


def test_inventory_has_every_file(spark, tmp_path, folder):
    rows = run(spark, tmp_path, "inventory", folder, "--with-hash", "--hash-algorithms", "SHA256", "md5", "sha256")
    by = {r["rel_path"]: r for r in rows}
    assert {"empty.bin", ".hidden/_keep", "link.txt", "broken"} <= by.keys() and len(rows) == 14
    assert by["broken"]["link_broken"] == "True" and by["broken"]["link_target"] == "nowhere" and by["link.txt"]["link_broken"] == "False"
    assert by["link.txt"]["hash_status"] == "symlink_skipped" and by["link.txt"]["sha256"] == ""
    assert by["empty.bin"]["md5"] == "d41d8cd98f00b204e9800998ecf8427e"
    assert list(rows[0])[-3:] == ["sha256", "md5", "hash_status"]
    meta = json.loads(sink.meta_path(tmp_path / "inventory.csv").read_text())
    assert meta["row_count"] == 14 and meta["hash_algorithms"] == ["sha256", "md5"]
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


def test_without_hashes_there_is_no_hash_column(spark, tmp_path, folder):
    assert "sha256" not in run(spark, tmp_path, "inventory", folder)[0]
    empty = tmp_path / "nothing"
    empty.mkdir()
    run(spark, tmp_path, "inventory", empty)
    assert (tmp_path / "inventory.csv").read_bytes().startswith(b"\xef\xbb\xbfpath,rel_path")


def test_excludes_and_cycles(spark, tmp_path):
    root = tmp_path / "r"
    E.put(root, ".git/config", "x")
    E.put(root, "a/b/keep.txt", "x")
    E.put(root, "a/drop.tmp", "x")
    os.symlink("..", root / "a/up")
    os.symlink("nowhere", root / "a/gone")
    plain = inventory.inventory(files.scan(spark, str(root), exclude=["*/.git/*", "*.tmp"])).collect()
    assert {r.rel_path for r in plain} == {"a/b/keep.txt", "a/up", "a/gone"}
    scanned = files.scan(spark, str(root), follow_symlinks=True, exclude=["*/.git/*"])
    followed = {r.rel_path: r for r in inventory.inventory(scanned).collect()}
    assert set(followed) == {"a/b/keep.txt", "a/drop.tmp", "a/gone"} and followed["a/gone"].link_broken
    assert [r.kind for r in inventory.notes(scanned).collect()] == [schemas.NOTE_CYCLE]
    hidden = files.scan(spark, str(root), exclude_paths=[str(root / "a")])
    assert [r.rel_path for r in inventory.inventory(hidden).collect()] == [".git/config"]


def test_platform_times():
    class St:
        st_ctime = 5.0

    assert files.times(St, False) == (None, 5.0) and files.times(St, True) == (5.0, None)
    St.st_birthtime = 3.0
    assert files.times(St, False) == (3.0, 5.0) and files.times(St, True) == (3.0, None)


def test_unreadable_files_are_rows(spark, tmp_path, folder):
    rows, _ = inventory.build(spark, str(folder))
    gone = rows.collect()
    os.remove(folder / "docs/readme.txt")
    again = spark.createDataFrame(gone, schemas.INVENTORY)
    hashed = {r.rel_path: r for r in content.with_signature(content.with_hashes(again, ["sha256"])).collect()}
    r = hashed["docs/readme.txt"]
    assert (r.hash_status, r.sha256, r.sig_source, r.ext_mismatch) == ("read_error", "", "error", False)
    (folder / "empty.bin").write_bytes(b"grown")
    assert {r.rel_path: r.hash_status for r in content.with_hashes(again, ["md5"]).collect()}["empty.bin"] == "changed_during_hash"


def test_search(spark, tmp_path, folder):
    hits = run(spark, tmp_path, "search", folder, "--kw", "PASSWORD", "--kw", "비밀번호")
    assert [(os.path.basename(h["path"]), h["line_no"], h["encoding"]) for h in hits] == [("memo_cp949.txt", "2", "cp949"), ("memo_utf16.txt", "2", "utf-16"), ("readme.txt", "2", "utf-8")]
    assert read(tmp_path / "search_skipped.csv")[0]["reason"] == "symlink"
    hits = run(spark, tmp_path, "search", folder, "--kw", r"pass(?P<rest>\w*)|(?:unseen){0}", "--regex", "--case-sensitive")
    assert [(h["matched"], h["match_span_start"], h["match_span_end"]) for h in hits] == [("password", "7", "15")]


def test_byte_searches_hold_little(spark, monkeypatch):
    import pyarrow as pa

    from tracewell.operators import search

    rows = spark.createDataFrame([], "id long, data binary")
    runs = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: runs.append(run) or self, raising=False)
    search.search_bytes(rows, "data", search.compile_all(["x"]), ["id"])
    search.decoded_texts(rows, "data", ["id"])
    texts = [b"x " * 20_000, None, b"", b"ax\n" * 5]
    hits = list(runs[0](iter([pa.record_batch({"id": [7, 8, 9, 10], "data": pa.array(texts, pa.binary())})])))
    assert max(b.num_rows for b in hits) <= 5000
    got = pa.Table.from_batches(hits).to_pylist()
    assert [r["match_span_start"] for r in got if r["id"] == 7] == list(range(0, 40_000, 2))
    assert [(r["line_no"], r["match_span_start"]) for r in got if r["id"] == 10] == [(k, 1) for k in range(1, 6)] and len(got) == 20_005
    # a text of any length, and nulls between them
    texts = [None if k % 50 == 3 else b"%d\n" % k * 1000 if k != 1500 else b"y" * (9 << 20) for k in range(3000)]
    parts = list(runs[1](iter([pa.record_batch({"id": range(3000), "data": pa.array(texts, pa.binary())}), pa.record_batch({"id": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})])))
    assert max(b.num_rows for b in parts) < 1500
    got = pa.Table.from_batches(parts).to_pylist()
    assert [r["id"] for r in got] == list(range(3000)) and all((r["lines"] and "".join(r["lines"]).encode()) == t for r, t in zip(got, texts, strict=True))


def test_decoded_lines(spark, tmp_path):
    from tracewell.functions import encoding
    from tracewell.operators import search

    mixed = E.put(tmp_path, "m.log", "한글\n".encode() + "한글\n".encode("cp949") * 3)
    rows = spark.createDataFrame([(str(mixed),), ("/no/such",)], "path string")
    got = [(r.line_no, r.line, r.encoding) for r in search.decoded_lines(rows).orderBy("path", "line_no").collect()]
    assert got == [(None, None, None), (1, "한글\n", "utf-8"), *((k, "한글\n", "cp949") for k in (2, 3, 4))]
    assert encoding.decode_file(str(mixed)) == (["한글\n"] * 4, "mixed(utf-8,cp949)") and encoding.decode_file("/no/such") is None


def test_search_skips_and_previews(spark, tmp_path):
    root = tmp_path / "r"
    E.put(root, "big.txt", "needle " * 400)
    E.put(root, "small.txt", "a" * 500 + "needle" + "b" * 500)
    hits = run(spark, tmp_path, "search", root, "--kw", "needle", "--max-size-mb", "0.002")
    assert len(hits) == 1 and len(hits[0]["line_preview"]) == 242 and "needle" in hits[0]["line_preview"]
    assert read(tmp_path / "search_skipped.csv") == [{"path": str((root / "big.txt").resolve()), "reason": "too_large", "size_bytes": "2800"}]


def test_timeline(spark, tmp_path, folder):
    os.utime(folder / "docs/readme.txt", (0, 1_000_000_000.5))
    rows = run(spark, tmp_path, "timeline", folder, "--tz-offset-min", "540")
    mine = [r for r in rows if r["rel_path"] == "docs/readme.txt"]
    assert {(r["event"], r["ts_iso"], r["ts_suspicious"]) for r in mine if r["event"] != "MetadataChanged"} == {("Accessed", "1970-01-01T09:00:00+09:00", "True"), ("Modified", "2001-09-09T10:46:40+09:00", "False")}
    assert [float(r["ts_epoch"]) for r in rows] == sorted(float(r["ts_epoch"]) for r in rows)


def test_odd_times(spark):
    from tracewell.operators.timeline import ordered, timeline

    rows = spark.createDataFrame([("a", "nan", "1e20"), ("b", "", "abc"), ("c", None, "-62135596801")], "path string, mtime_epoch string, atime_epoch string")
    got = [(r.path, r.ts_iso, r.ts_suspicious) for r in ordered(timeline(rows, 0.0)).collect()]
    assert got == [("c", "", True), ("a", "", True)]


def changed(folder):
    E.put(folder, "docs/new.txt", "n")
    os.rename(folder / "images/photo.png", folder / "images/moved.png")
    os.rename(folder / "images/mismatch.jpg", folder / "images/also.jpg")
    stat = os.stat(folder / "docs/readme.txt")
    data = bytearray((folder / "docs/readme.txt").read_bytes())
    data[0] ^= 1
    (folder / "docs/readme.txt").write_bytes(data)
    os.utime(folder / "docs/readme.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.remove(folder / "docs/secret.txt")
    os.remove(folder / "link.txt")
    os.symlink("docs/memo_cp949.txt", folder / "link.txt")


def test_validate_against_a_baseline(spark, tmp_path, folder):
    base = tmp_path / "base.csv"
    cli.main(["inventory", str(folder), "--with-hash", "--out", str(base), "--out-dir", str(tmp_path / "outputs")], spark)
    calm = run(spark, tmp_path, "validate", folder, "--baseline", str(base), "--verify-hash")
    assert {r["code"] for r in calm} == {"LINK_BROKEN"}
    changed(folder)
    rows = run(spark, tmp_path, "validate", folder, "--baseline", str(base))
    codes = {(r["code"], os.path.relpath(r["path"], folder)) for r in rows}
    # both pictures are equal, so it isn't known which of them went where
    assert codes == {
        ("LINK_BROKEN", "broken"),
        ("BASELINE_NEW", "docs/new.txt"),
        ("BASELINE_NEW", "images/moved.png"),
        ("BASELINE_NEW", "images/also.jpg"),
        ("BASELINE_MISSING", "images/photo.png"),
        ("BASELINE_MISSING", "images/mismatch.jpg"),
        ("BASELINE_MISSING", "docs/secret.txt"),
        ("HASH_CHANGED", "docs/readme.txt"),
        ("LINK_TARGET_CHANGED", "link.txt"),
        ("MTIME_CHANGED", "link.txt"),
        ("SIZE_CHANGED", "link.txt"),
    }
    assert rows[0]["code"] == "LINK_BROKEN"
    run(spark, tmp_path, "validate", folder, "--baseline", str(base), "--exclude", "*.none")
    assert {r["code"] for r in read(tmp_path / "validate.csv")} >= {"BASELINE_OPTIONS_DIFFER"}


def test_a_moved_folder_has_no_issues(spark, tmp_path, folder):
    base = tmp_path / "base.csv"
    cli.main(["inventory", str(folder), "--with-hash", "--out", str(base), "--out-dir", str(tmp_path / "outputs")], spark)
    shutil.move(folder, tmp_path / "elsewhere")
    os.remove(sink.meta_path(base))
    rows = run(spark, tmp_path, "validate", tmp_path / "elsewhere", "--baseline", str(base))
    assert {r["code"] for r in rows} == {"LINK_BROKEN", "BASELINE_META_MISSING"}


def test_rules_over_rows(spark):
    cols = "path string, name string, size_bytes long, mtime_epoch string, atime_epoch string, link_broken boolean, link_target string, hash_status string, sig_source string, ext_mismatch boolean, ext_on_disk string, sig_mime string, sig_desc string"
    rows = spark.createDataFrame(
        [
            ("a", "a", 1, "5", "5", False, "", "read_error", "error", False, "", "", ""),
            ("a", "", None, "x", "0", True, "t", "changed_during_hash", "header", True, ".jpg", "image/png", "d"),
            ("b", "b", 1, "1e12", "inf", False, "", "ok", "text", False, "", "", ""),
        ],
        cols,
    )
    got = sorted((r.code, r.path, r.field) for r in validate.check_rows(rows, 1000.0, hashed=True, look_again=False).collect())
    assert got == sorted(
        [
            ("HASH_READ_FAIL", "a", ""),
            ("SIGNATURE_READ_FAIL", "a", ""),
            ("MISSING_FIELD", "a", "name"),
            ("MISSING_FIELD", "a", "size_bytes"),
            ("TS_BAD_TYPE", "a", "mtime_epoch"),
            ("TS_SUSPICIOUS", "a", "atime_epoch"),
            ("CHANGED_DURING_HASH", "a", ""),
            ("EXT_MISMATCH", "a", "ext_mismatch"),
            ("LINK_BROKEN", "a", ""),
            ("TS_FUTURE", "b", "mtime_epoch"),
            ("TS_BAD_TYPE", "b", "atime_epoch"),
            ("DUP_PATH", "a", ""),
        ]
    )


def test_looking_again(spark, tmp_path, folder):
    rows, _ = inventory.build(spark, str(folder))
    kept = spark.createDataFrame(rows.collect(), schemas.INVENTORY)
    os.remove(folder / "docs/readme.txt")
    (folder / "empty.bin").write_bytes(b"grown")
    got = {(r.code, os.path.relpath(r.path, folder)) for r in validate.check_rows(kept, 4e9).collect()}
    assert got == {("FILE_NOT_FOUND", "docs/readme.txt"), ("SIZE_MISMATCH", "empty.bin"), ("LINK_BROKEN", "broken")}


def test_recheck_finds_a_wrong_digest(spark, tmp_path, folder):
    rows, _ = inventory.build(spark, str(folder), algorithms=["sha256"])
    wrong = spark.createDataFrame([r.asDict() | {"sha256": "0" * 64 if r.name == "readme.txt" else r.sha256} for r in rows.collect()], rows.schema)
    got = validate.recheck(wrong, ["sha256"], least=50).collect()
    assert [(r.code, os.path.basename(r.path)) for r in got] == [("HASH_VERIFY_FAIL", "readme.txt")]
    assert len(validate.sample_ordinals(1000)) == 50 and len(validate.sample_ordinals(3)) == 3 and len(validate.sample_ordinals(10**6)) == 200


def test_compare_is_quiet_on_equal_tables_and_says_when_nothing_was_hashed(spark):
    rows = spark.createDataFrame([("é.txt", 1, 1.0, "a" * 64), ("x", 2, 1.0, "b" * 64)], "rel_path string, size_bytes long, mtime_epoch double, sha256 string")
    assert validate.compare(rows, rows, ["sha256"]).count() == 0
    apart = spark.createDataFrame([("é.txt", 1, 1.0, "a" * 64), ("x", 2, 1.0, "b" * 64)], rows.schema)
    assert validate.compare(rows, apart, ["sha256"]).count() == 0
    assert [r.code for r in validate.compare(rows, rows.drop("sha256"), ["sha256"]).collect()] == ["BASELINE_NO_HASH"]
    assert {r.code for r in validate.compare(rows, rows.limit(0), []).collect()} == {"BASELINE_NO_HASH", "BASELINE_NEW"}


def test_apps(spark, tmp_path, folder):
    rows = {r["rel_path"]: r for r in run(spark, tmp_path, "apps", folder, "--with-hash")}
    assert {k: r["status"] for k, r in rows.items()} == {"apps/app.apk": "ok", "apps/phone.ipa": "ok", "apps/backup.zip": "ok", "apps/renamed.apk": "not_app"}
    r = rows["apps/app.apk"]
    assert (r["package"], r["version_name"], r["version_code"], r["min_os"], r["target_sdk"], r["permissions"], r["signing"], r["app_name"]) == ("org.example.app", "1.2", "7", "21", "33", "android.permission.CAMERA", "v1", "Example")
    r = rows["apps/phone.ipa"]
    assert (r["package"], r["version_code"], r["permissions"], r["signing"], len(r["sha256"])) == ("org.example.ios", "31", "NSCameraUsageDescription", "code_signature", 64)
    assert rows["apps/backup.zip"]["ext_on_disk"] == ".zip"


def test_appdiff_of_databases_and_settings(spark, tmp_path):
    before, after = tmp_path / "before", tmp_path / "after"
    E.notes_database(before / "db/notes.db", [(1, "x", b"1"), (2, "y", None), (9, "same", b"")])
    E.notes_database(after / "db/notes.db", [(1, "x2", b"1"), (10, "z", b"\x01"), (9, "same", b"")])
    E.put(before, "p.xml", '<map><string name="k">v</string><int name="n" value="1"/></map>')
    E.put(after, "p.xml", '<map><string name="k">w</string><long name="n" value="1"/><set name="s"><string>b</string><string>a</string></set></map>')
    E.put(before, "broken.xml", "<map>")
    E.put(after, "broken.xml", "<map> ")
    E.put(before, "gone.bin", b"\0")
    rows = run(spark, tmp_path, "appdiff", after, "--before", str(before))
    got = [(r["rel_path"], r["change"], r["key"], r["column"], r["before"], r["after"]) for r in rows if r["change"] not in ("FILE_MODIFIED", "PARSE_ERROR")]
    assert [g for g in got if g[0] == "p.xml"] == [("p.xml", "KEY_CHANGED", "k", "", "string:v", "string:w"), ("p.xml", "KEY_CHANGED", "n", "", "int:1", "long:1"), ("p.xml", "KEY_ADDED", "s", "", "", "set:{a, b}")]
    assert [g[1:] for g in got if g[0] == "db/notes.db"] == [
        ("ROW_CHANGED", "rowid=1", "title", "x", "x2"),
        ("ROW_DELETED", "rowid=2", "", "id=2; title=y; body=NULL", ""),
        ("ROW_ADDED", "rowid=10", "", "", "id=10; title=z; body=x'01'"),
    ]
    assert [r["rel_path"] for r in rows if r["change"] == "PARSE_ERROR"] == ["broken.xml"]
    assert [r["rel_path"] for r in rows if r["change"] == "FILE_DELETED"] == ["gone.bin"]
    same = run(spark, tmp_path, "appdiff", after, "--before", str(after))
    assert same == []


def test_appdiff_reads_the_log_and_leaves_evidence_alone(spark, tmp_path):
    before, after = tmp_path / "before", tmp_path / "after"
    E.notes_database(before / "notes.db", [(1, "x", b"1")])
    (after).mkdir()
    shutil.copy(before / "notes.db", after / "notes.db")
    import sqlite3

    c = sqlite3.connect(after / "notes.db")
    c.execute("PRAGMA journal_mode=WAL")
    c.execute("PRAGMA wal_autocheckpoint=0")
    c.execute("INSERT INTO notes VALUES (2, 'late', NULL)")
    c.commit()
    marks = {p.name: p.read_bytes() for p in after.iterdir()}
    rows = run(spark, tmp_path, "appdiff", after, "--before", str(before))
    assert [(r["change"], r["key"]) for r in rows if r["change"].startswith("ROW")] == [("ROW_ADDED", "rowid=2")]
    assert {p.name: p.read_bytes() for p in after.iterdir()} == marks
    c.close()


def test_row_keys(tmp_path):
    import sqlite3

    path = tmp_path / "k.db"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE shadow (rowid TEXT, v TEXT)")
    c.execute("INSERT INTO shadow VALUES ('r', 'v')")
    c.execute("CREATE TABLE bare (rowid TEXT, _rowid_ TEXT, oid TEXT)")
    c.executemany("INSERT INTO bare VALUES (?, ?, ?)", [("a", "b", "c")] * 2)
    c.execute("CREATE TABLE kv (k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID")
    c.execute("INSERT INTO kv VALUES ('k', 'v')")
    c.commit()
    c.close()
    db = artifacts.Database(str(path))
    keys = {t: [artifacts.key_text(k) for k, _ in db.rows(t)] for t in db.tables}
    db.close()
    assert keys == {"bare": ["a, b, c, #1", "a, b, c, #2"], "kv": ["k"], "shadow": ["rowid=1"]}


def test_large_changes_are_cut_with_their_number(spark, tmp_path):
    before, after = tmp_path / "b", tmp_path / "a"
    E.notes_database(before / "n.db", [])
    E.notes_database(after / "n.db", [(k, "t", None) for k in range(1, 1501)])
    changes, _ = snapshot.compare(spark, str(before), str(after))
    rows = changes.collect()
    assert sum(r.change == "ROW_ADDED" for r in rows) == 1000 and rows[-1].change == "TRUNCATED" and "500" in rows[-1].after
    assert [r.key for r in rows if r.change == "ROW_ADDED"][:10] == [f"rowid={k}" for k in range(1, 11)]


def test_property_lists():
    assert dict(artifacts.flat({"a": {"b": [1, {"c": 2}]}, "e": {}, "f": []})) == {"a.b[0]": 1, "a.b[1].c": 2, "e": {}, "f": []}


def test_cells_survive_the_csv_file(spark, tmp_path):
    texts = ["=1+1", "'=y", "-1.5", "-1_0", "-inf", "+x", "@a", "\tq", "plain", "", "a\nb", 'say "x"', "'"]
    path = tmp_path / "c.csv"
    rows = spark.createDataFrame([(t, "1", "2", "3") for t in texts], "path string, rel_path string, size_bytes string, mtime_epoch string")
    sink.write_csv(rows, path)
    raw = [r["path"] for r in read(path)]
    assert raw[:7] == ["'=1+1", "''=y", "-1.5", "-1_0", "-inf", "'+x", "'@a"]
    assert [sink.unescape(x) for x in raw] == texts
    assert [r.path for r in sink.read_inventory(spark, path).orderBy("_order").collect()] == texts


def test_result_names_never_repeat(tmp_path):
    from datetime import datetime

    now = datetime(2025, 1, 2, 3, 4, 5)
    first = sink.out_path("inventory", tmp_path, "사건 1/2", now=now)
    assert first.name == "inventory_사건_1_2_20250102_030405.csv"
    first.touch()
    assert sink.out_path("inventory", tmp_path, "사건 1/2", now=now).name.endswith("_1.csv")


@pytest.mark.parametrize(
    "argv",
    [
        ["inventory", "/no/such/folder"],
        ["inventory", ".", "--hash-algorithms", "nope"],
        ["inventory", ".", "--hash-algorithms", "shake_128"],
        ["inventory", ".", "--hash-algorithms"],
        ["inventory", ".", "--hash-block-size", "0"],
        ["search", "."],
        ["search", ".", "--kw", "(", "--regex"],
        ["search", ".", "--kw", "x", "--max-size-mb", "0"],
        ["search", ".", "--kw", "x", "--encodings", "nope"],
        ["search", ".", "--kw", "x", "--encodings"],
        ["timeline", ".", "--tz-offset-min", "1440"],
        ["validate", ".", "--baseline", "/no/such.csv"],
        ["validate", ".", "--baseline", __file__],
        ["appdiff", ".", "--before", "/no/such"],
        ["appdiff", "."],
    ],
)
def test_wrong_arguments_end_with_code_2(spark, argv):
    with pytest.raises(SystemExit) as e:
        cli.main(argv, spark)
    assert e.value.code == 2


def test_results_inside_the_root_are_left_out(spark, tmp_path):
    root = tmp_path / "r"
    E.put(root, "a.txt", "x")
    for _ in range(2):
        cli.main(["inventory", str(root), "--out-dir", str(root / "outputs"), "--out", str(root / "inv.csv")], spark)
    assert [r["rel_path"] for r in read(root / "inv.csv")] == ["a.txt"]
