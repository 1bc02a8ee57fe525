import pytest
from test_line_templates import corpus

from orthoplan.llm import line_templates, scratch


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def test_tables_have_no_checksum_files_and_damage_is_found(spark, folder):
    table = scratch.written(spark.range(50_000).selectExpr("id", "cast(xxhash64(id) as string) as name").repartition(3), "some")
    assert not list(folder.rglob("*.crc"))
    assert table.selectExpr("sum(id)", "count(distinct name)").first()[:] == (50_000 * 49_999 // 2, 50_000)
    part = max(folder.rglob("part-*"), key=lambda f: f.stat().st_size)
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 3] ^= 1
    part.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table.selectExpr("bit_xor(xxhash64(*))").collect()


def test_lines_writes_few_tables(spark, folder, monkeypatch):
    names, new_path = [], scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda spark, name: names.append(name) or new_path(spark, name))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    assert sum(r.n_dropped for r in line_templates.deduplicated(docs).collect()) > 40
    assert sorted(names) == ["form-tokens", "forms", "lines", "templates"]
    assert not list(folder.rglob("*.crc"))
