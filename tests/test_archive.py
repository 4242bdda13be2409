"""Archives are taken back whole or not at all."""

import json
import shutil
from pathlib import Path

import pytest

from marquee.operators import archive


@pytest.fixture
def packed(spark, tmp_path):
    tables = {"a": spark.range(250).selectExpr("id", "id * 2 as twice"), "b_2": spark.createDataFrame([("x",), (None,)], "s string")}
    archive.export_tables(tables, f"{tmp_path}/pack", rows_per_file=40)
    return tables, tmp_path / "pack", tmp_path / "target"


def rewrite(root: Path, change):
    part = next(p for p in (root / "manifest").glob("part-*") if p.stat().st_size)
    rows = [json.loads(x) for x in part.read_text().splitlines()]
    part.write_text("".join(json.dumps(r) + "\n" for r in change(rows)))
    for crc in (root / "manifest").glob(".*.crc"):
        crc.unlink()


def test_round_trip(spark, packed):
    tables, root, target = packed
    assert archive.import_tables(spark, str(root), str(target)) == ["a", "b_2"]
    for name, table in tables.items():
        assert sorted(map(repr, spark.read.parquet(f"{target}/{name}").collect())) == sorted(map(repr, table.collect()))
    assert archive.manifest(spark, str(root)).where("table = 'a'").count() >= 7


@pytest.mark.parametrize(
    "change",
    [
        lambda rows: [rows[0] | {"sha256": "0" * 64}, *rows[1:]],
        lambda rows: [rows[0] | {"bytes": 1}, *rows[1:]],
        lambda rows: rows[1:],
        lambda rows: [*rows, rows[0] | {"path": "data/a/part-none.parquet"}],
        lambda rows: [*rows, rows[0]],
        lambda rows: [rows[0] | {"path": "../" + rows[0]["path"]}, *rows[1:]],
        lambda rows: [rows[0] | {"path": "data/../../x.parquet"}, *rows[1:]],
        lambda rows: [rows[0] | {"path": "/etc/passwd"}, *rows[1:]],
        lambda rows: [rows[0] | {"path": "file:/etc/passwd"}, *rows[1:]],
        lambda rows: [{k: v for k, v in rows[0].items() if k != "path"}, *rows[1:]],
        lambda rows: [],
    ],
)
def test_a_tampered_manifest_is_refused(spark, packed, change):
    _, root, target = packed
    rewrite(root, change)
    with pytest.raises(archive.BrokenArchive):
        archive.import_tables(spark, str(root), str(target))
    assert not target.exists()


def test_changed_missing_and_added_files_are_refused(spark, packed):
    _, root, target = packed
    files = sorted((root / "data" / "a").glob("part-*.parquet"))
    for harm in (lambda: shutil.copy(files[0], files[0].parent / "part-more.parquet"), lambda: (files[0].parent / "part-more.parquet").unlink() or files[0].unlink()):
        harm()
        with pytest.raises(archive.BrokenArchive):
            archive.import_tables(spark, str(root), str(target))
    assert not target.exists()


def test_names_and_old_archives(spark, packed):
    tables, root, _ = packed
    with pytest.raises(ValueError):
        archive.export_tables({"../x": tables["a"]}, str(root))
    with pytest.raises(archive.BrokenArchive):  # the older manifest went first
        archive.verify(spark, str(root))
