"""Files as tables."""

import hashlib

from tessella.sources import files


def test_scan_originals_health_and_report(spark, tmp_path):
    for name, data in (("b/IMG.JPG", b"12345"), ("a/x.png", b"1"), ("a/raw.NEF", b"123"), ("a/.hid.png", b"1"), ("a/note.txt", b"1"), ("a/side.xmp", b"22")):
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(data)
    found = files.scan(spark, str(tmp_path)).collect()
    assert [(r["name"], r["length"], r["unsupported"]) for r in found] == [("raw.NEF", 3, True), ("x.png", 1, False), ("IMG.JPG", 5, False)]
    assert found[0]["revision"] == f"{(tmp_path / 'a/raw.NEF').stat().st_mtime_ns // 1000000 * 1000000}:3"
    assert files.scan(spark, str(tmp_path), after=found[1]["path"]).count() == 1
    assert {r["name"] for r in files.scan(spark, str(tmp_path), files.MEDIA + files.SIDECARS).collect()} == {"x.png", "IMG.JPG", "side.xmp", "note.txt"}
    assert tuple(files.health(spark, str(tmp_path)).first()) == (3, 2, 9)
    assert files.originals(spark, [found[2]["path"]]).first()["sha256"] == hashlib.sha256(b"12345").hexdigest()
    files.write_report(files.scan(spark, str(tmp_path)), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
