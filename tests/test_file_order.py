import json

import __spark_entry__ as job
from ragspark.queries import corpus


def test_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    """More documents make more files, and the order over all of them stays."""
    monkeypatch.setattr(corpus, "FILE_ROWS", 20)
    monkeypatch.setattr(corpus, "shared_folder", lambda _: str(tmp_path))
    rows = job.queries()["provisions_in_file_order"](spark, "/root/testdata/sf0.001").collect()
    files = [p.read_text().splitlines() for p in sorted(tmp_path.glob("ragspark/*/part-*.json"))]
    assert len(files) >= len(rows) // 20 > 5 and max(map(len, files)) < 60
    assert [r.provision_id for r in sorted(rows, key=lambda r: r.ord)] == [json.loads(x)["provision_id"] for f in files for x in f]
