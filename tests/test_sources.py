from pathlib import Path

import pytest
from pyspark.sql import functions as F

from patchloom import (
    analyze_files,
    file_summaries,
    files_from_sections,
    parse_files,
    read_patch_files,
    SECTION_KEYS,
    number_files,
    read_patch_sections,
    render_diffs,
    render_parts,
    summarize,
    summarize_diffs,
    write_parts,
    write_rendered,
)
from patchloom.streaming.patch_stream import read_patch_stream, start_report_stream

A = "diff --git a/é.py b/é.py\n@@ -1 +1 @@\n+x = 'é'\n"
B = "diff --git a/b b/b\nnew file mode 1\n@@ -0,0 +1 @@\n+b\n"


@pytest.fixture
def patches(tmp_path):
    folder = tmp_path / "patches"
    folder.mkdir()
    (folder / "utf8.patch").write_bytes((A + B).encode())
    (folder / "latin.patch").write_bytes((B + A).encode("latin-1"))
    (folder / "crlf.patch").write_bytes(("intro\n" + A + B + A).replace("\n", "\r\n").encode())
    (folder / "big.patch").write_bytes((B * 3000 + A).encode())
    (folder / "empty.patch").write_bytes(b"")
    return str(folder)


COLUMNS = ["path", "file_seq", "filename", "change_type", "old_filename", "lines_added", "lines_removed", "added_lines"]


def test_files_read_whole(spark, patches):
    df = read_patch_files(spark, patches, "*.patch")
    texts = {r.path.split("/")[-1]: r.diff_text for r in df.collect()}
    assert texts["utf8.patch"] == A + B and texts["latin.patch"] == B + A
    assert set(texts) == {"utf8.patch", "latin.patch", "crlf.patch", "big.patch"}
    assert texts["crlf.patch"] == "intro\n" + A + B + A


@pytest.mark.parametrize("block", [700, 1 << 27])
def test_files_read_in_sections_give_the_same_files(spark, patches, block):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    bare = lambda rows: sorted((r[0].rsplit("/", 1)[-1], *map(str, r[1:])) for r in rows)
    whole = parse_files(read_patch_files(spark, patches), keys=("path",)).select(*COLUMNS).collect()
    spark.conf.set(name, block)
    try:
        sections = read_patch_sections(spark, patches)
        parts = number_files(files_from_sections(sections, keys=SECTION_KEYS)).select(*COLUMNS).collect()
        assert sections.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set(name, before)
    assert len(parts) == 3001 + 2 + 2 + 3
    assert bare(parts) == bare(whole)


def test_rendered_text_is_written(spark, diffs_of, tmp_path):
    rendered = render_diffs(diffs_of(A, B))
    out = str(tmp_path / "out")
    for _ in range(2):
        write_rendered(rendered, out, by=("diff_id",))
    got = {i: "".join(f.read_text() for f in Path(out).glob(f"diff_id={i}/part-*")) for i in (1, 2)}
    assert got == {r.diff_id: r.rendered + "\n" for r in rendered.collect()}


def test_parts_are_written_in_order(spark, tmp_path):
    diffs = spark.createDataFrame([(1, A + B * 50), (2, B)], "diff_id bigint, diff_text string")
    analysis = analyze_files(parse_files(diffs))
    parts = render_parts(summarize(analysis, with_files=False), file_summaries(analysis))
    out = tmp_path / "parts"
    write_parts(parts, str(out))
    text = "".join(f.read_text() for f in sorted(out.glob("part-*")))
    expected = "".join(r.rendered + "\n" for r in render_diffs(diffs).orderBy("diff_id").collect())
    assert text == expected


def test_stream_of_patch_files(spark, patches, tmp_path):
    out, checkpoint = str(tmp_path / "reports"), str(tmp_path / "checkpoint")
    stream = read_patch_stream(spark, patches, max_files=2)
    query = start_report_stream(stream, out, checkpoint, "json")
    assert query.awaitTermination(120)
    got = {r.path: r.rendered for r in spark.read.parquet(out).collect()}
    expected = render_diffs(read_patch_files(spark, patches), "json", keys=("path",)).collect()
    assert got == {r.path: r.rendered for r in expected} and len(got) == 4


def test_analysis_runs_on_a_stream(spark, patches, tmp_path):
    stream = analyze_files(parse_files(read_patch_stream(spark, patches), keys=("path",)), keys=("path",))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(str(tmp_path / "o"))
    )
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3008


def test_sections_are_read_in_one_scan_without_a_join_or_a_shuffle(spark, patches):
    files = files_from_sections(read_patch_sections(spark, patches), keys=SECTION_KEYS)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan


def test_sections_feed_the_roll_up(spark, patches):
    keys = ("path",)
    files = number_files(files_from_sections(read_patch_sections(spark, patches), SECTION_KEYS))
    row = summarize(analyze_files(files, keys), keys, known_purposes=True).where(F.endswith("path", F.lit("big.patch"))).first()
    whole = summarize_diffs(read_patch_files(spark, patches), keys).where(F.endswith("path", F.lit("big.patch"))).first()
    assert (row.overview, row.statistics, row.key_changes) == (whole.overview, whole.statistics, whole.key_changes)


def test_each_section_is_decoded_on_its_own(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "m.patch").write_bytes(b"intro\r\n" + A.encode() + A.encode("latin-1") + b"\r")
    rows = number_files(files_from_sections(read_patch_sections(spark, str(folder)), SECTION_KEYS))
    got = sorted((r.file_seq, r.filename, list(r.added_lines)) for r in rows.collect())
    assert got == [(1, "é.py", ["x = 'é'"]), (2, "é.py", ["x = 'é'"])]


def test_json_comes_in_parts(spark, monkeypatch):
    from patchloom.operators import render as render_module

    monkeypatch.setattr(render_module, "SALTS", 3)
    diffs = spark.createDataFrame([(1, A + B * 50), (2, B), (3, "no diff here")], "diff_id bigint, diff_text string")
    analysis = analyze_files(parse_files(diffs, keep_empty=True), keep_empty=True)
    parts = render_parts(summarize(analysis, known_purposes=True, with_files=False), file_summaries(analysis), "json")
    joined = {}
    for r in parts.orderBy("diff_id", "part").collect():
        joined.setdefault(r.diff_id, []).append(r.text)
    whole = {r.diff_id: r.rendered for r in render_diffs(diffs, "json").collect()}
    assert {k: "\n".join(v) for k, v in joined.items()} == whole
    assert len(joined[1]) == 2 + 51 and len(joined[3]) == 1
    assert all(len(t) < 2000 for t in joined[1])


def test_json_parts_compute_headers_and_files_once(spark, monkeypatch, capsys):
    from patchloom.operators import render as render_module

    monkeypatch.setattr(render_module, "SALTS", 3)
    statistics = "struct<total_files bigint, files_added bigint, files_modified bigint, files_deleted bigint,"
    statistics = statistics.replace(" bigint", ": bigint") + "total_lines_added: bigint, total_lines_removed: bigint>"
    columns = f"diff_id bigint, overview string, statistics {statistics}, key_changes array<string>, recommendations array<string>"
    failed = render_module.ROLLUP_FAILED
    rows = [(i, failed if i == 2 else "o", (3, 0, 0, 0, 0, 0), [], []) for i in (1, 2, 3, 4, None)]
    headers = spark.createDataFrame(rows, columns)
    listed = [(1, n, f"f{n}", "s", []) for n in range(1, 8)] + [(2, 1, "f", "s", []), (3, 5, "f", "s", []), (9, 1, "f", "s", [])]
    files = spark.createDataFrame(listed, "diff_id bigint, file_seq bigint, filename string, summary string, key_changes array<string>")
    parts = render_parts(headers, files, "json")
    parts.explain()
    assert capsys.readouterr().out.count("ExistingRDD") == 2
    found = {}
    for r in parts.orderBy("diff_id", "part").collect():
        found.setdefault(r.diff_id, []).append(r.text)
    assert {k: len(v) for k, v in found.items()} == {1: 9, 2: 1, 3: 3, 4: 1}
    assert [t.endswith(",") for t in found[1][1:-1]] == [True] * 6 + [False] and not found[3][1].endswith(",")
