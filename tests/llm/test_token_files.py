"""Rows of one key are dealt over several tasks and files."""

import pytest

from logloom.llm.token_files import read_token_files, with_crc32, write_token_files

from . import brute

TEXTS = {
    "many texts": [f"text {i:04} of the hot key" for i in range(400)],
    "one text": ["the same text of the hot key " * 5] * 400,
    "one head": ["the same head of the hot key " * 5 + str(i) for i in range(400)],
}


@pytest.fixture
def eight_parts(spark):
    asked = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", TEXTS)
def test_a_hot_key_is_not_one_task(spark, tmp_path, eight_parts, name):
    import public_tokenizers

    docs = [{"doc_id": 5, "text": t} for t in TEXTS[name]] + [{"doc_id": k, "text": f"other {k}"} for k in (1, 2, 9)]
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string").repartition(4)
    write_token_files(frame, str(tmp_path / "files"), public_tokenizers.path("word_bpe_49k.json"))
    parts = spark.read.parquet(str(tmp_path / "files")).filter("doc_id = 5").groupBy("part").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 200
    found = sorted(tuple(r) for r in with_crc32(read_token_files(spark, str(tmp_path / "files")), "doc_id", "start", "n_tokens").collect())
    theirs = brute.token_stream(docs)
    assert sorted((r[0], r[2], r[3]) for r in found) == sorted((r[0], r[2], r[3]) for r in theirs)
    at = 0
    for _, start, n, _ in sorted(found, key=lambda r: r[1]):
        assert start == at
        at += n
    if name != "one head":
        assert found == sorted(theirs)


def test_layout_of_the_files(spark, tmp_path):
    """Ids are dictionary-encoded and numbers delta-encoded, in small row groups with page indexes; numbers are read without the ids."""
    import public_tokenizers
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 50) for i in range(3000)], "doc_id bigint, text string").coalesce(1)
    path = str(tmp_path / "files")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), row_group_bytes=1 << 16, page_bytes=1 << 13)
    files = sorted((tmp_path / "files").glob("*.parquet"))
    groups = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "n_tokens", "local_start"))
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert meta.row_group(g).num_rows < 3000
    assert groups > len(files)
    numbers = read_token_files(spark, path).filter("doc_id >= 2990").select("doc_id", "n_tokens")
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("ids" not in line.split("ReadSchema")[1] for line in scans) and any("GreaterThanOrEqual(doc_id,2990)" in line for line in scans)
    assert sorted(r["doc_id"] for r in numbers.collect()) == list(range(2990, 3000))


def test_wide_vocabularies_keep_their_ids(spark, tmp_path, monkeypatch):
    import public_tokenizers

    from logloom.llm import token_files

    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    token_files.write_token_files(docs, str(tmp_path / "wide"), public_tokenizers.path("word_bpe_49k.json"), end_id=1 << 20)
    rows = sorted(read_token_files(spark, str(tmp_path / "wide")).select("doc_id", "ids").collect())
    assert rows[0]["ids"][-1] == 1 << 20 and rows[1]["ids"] == [1 << 20] and len(rows[0]["ids"]) == 4
