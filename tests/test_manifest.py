"""A document's files are small enough to be read whole."""

from plumbline.sources import artifacts


def test_large_tables_are_written_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts, "FILE_ROWS", 1000)
    m = artifacts.write_document({"scales": spark.range(10_500).coalesce(1), "none": spark.range(0)}, str(tmp_path / "document"))
    rows = m.where("artifact = 'scales'").collect()
    assert len(rows) == 11 and max(r.bytes for r in rows) < 20_000 and all(len(r.sha256) == 64 for r in rows)
    assert spark.read.json(str(tmp_path / "document" / "scales")).count() == 10_500
