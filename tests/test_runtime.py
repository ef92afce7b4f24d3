import struct

import pytest

from lexweave.sources import runtime as R


def test_settings():
    assert R.settings(None) == R.Settings()
    raw = {"runtimeDir": " a\\b/ ", "databasePath": " ", "entityDir": "/w/x/", "preferredLang": "fr", "noteGlobs": "a, b\r\n\n"}
    assert R.settings(raw) == R.Settings("a/b", "notes.db", "w/x", "zh", ("a", "b"))
    assert R.settings({"noteGlobs": [1, " "]}).note_globs == ("**/*.md",)


def test_manifest():
    good = {"format": "v1", "endian": "little", "mode": "charwise"} | R.WIDTHS | R.ENTITY_WIDTHS
    R.check_manifest(good, {"v1"}, True, False, False)
    for bad, tables in ((good | {"mode": "bytewise"}, (True, False, False)), (good, (False, False, False)), (good, (True, True, False)), (good, (False, False, True))):
        with pytest.raises(ValueError):
            R.check_manifest(bad, {"v1"}, *tables)


def test_records(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(struct.pack("<4I", 1, 4294967295, 258, 0))
    assert {tuple(r) for r in R.read_records(spark, str(tmp_path / "t.bin"), ["a", "b"]).collect()} == {(1, 4294967295), (258, 0)}
