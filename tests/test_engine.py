"""Cases of single operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, IoError, ModelError, PluginError, SecurityError, SerializationError, StoreError
from tidemark.functions import exprs as X
from tidemark.operators import content, exact, keepers, matchers, models, reports, similarity, store
from tidemark.plans.session import ensure_checkpoints
from tidemark.sources import crawl, manifest
from tidemark.streaming import watch

SCORES = {
    "/srv/media/beach.jpg": 100,
    "/srv/media/beach - Copy (2).jpg": 75,
    "/srv/media/beach-copy.jpg": 75,
    "/srv/media/beach_COPY.jpg": 75,
    "/srv/media/beach (copy).png": 75,
    "/srv/media/beach copy.png": 75,
    "/srv/media/beach copy of mine.png": 75,
    "/srv/media/copy beach.png": 75,
    "/srv/media/copy_beach.png": 75,
    "/srv/media/Copy of beach.png": 75,
    "/srv/media/copybook.png": 100,
    "/srv/media/scopy.png": 100,
    "/srv/media/thumbnail.png": 50,
    "/srv/media/beach edited.png": 90,
    "/srv/media/beach_edited - copy thumb.png": 15,
    "/srv/trash/beach.png": -400,
    "/srv/.Trash-1000/files/beach.png": -400,
    "/srv/recycled/beach.png": -400,
    "D:\\$RECYCLE.BIN\\x\\beach.png": -400,
    "D:\\trash\\beach_copy.png": -425,
    "/srv/trashed/beach.png": 100,
}


def test_keeper_scores(spark):
    d = spark.createDataFrame([(p,) for p in SCORES], "path string").withColumn("s", X.keeper_score(F.col("path")))
    assert {r.path: r.s for r in d.collect()} == SCORES


@pytest.fixture
def tree(tmp_path):
    for name, data in {"pic.jpg": b"x" * 10, "sub/movie.mp4": b"y" * 5, "sub/deep/notes.txt": b"z", ".hidden/a.bin": b"q", "empty.png": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    for name in X.EXCLUDED_NAMES:
        (tmp_path / name).mkdir()
        (tmp_path / name / "skip_me.jpg").write_bytes(b"1")
    os.symlink(tmp_path / "pic.jpg", tmp_path / "link.jpg")
    return tmp_path


def test_crawl(spark, tree):
    d = crawl.scan_files(spark, [str(tree), str(tree / "sub")])
    got = {os.path.relpath(r.path, tree): r.category for r in d.collect()}
    assert got == {"pic.jpg": "PHOTO", "sub/movie.mp4": "VIDEO", "sub/deep/notes.txt": "FILE", ".hidden/a.bin": "FILE"}
    assert exact.scan_stats(d).first()[:] == (4, 2)
    flat = crawl.scan_files(spark, [str(tree)], recursive=False)
    assert [os.path.basename(r.path) for r in flat.collect()] == ["pic.jpg"]


def test_crawl_of_a_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        crawl.scan_files(spark, [str(tmp_path / "nowhere")])


def _files(spark, rows):
    return crawl.classify(spark.createDataFrame([(p, len(c), 0, c) for p, c in rows], "path string, size_bytes bigint, modified_epoch bigint, content string"))


def test_exact_pairs(spark):
    f = _files(spark, [("/a.bin", "same"), ("/b.bin", "same"), ("/c.bin", "longer"), ("/d.bin", "emas"), ("/e.bin", "")])
    r = exact.duplicate_records(f).orderBy("rank").collect()
    assert [(x.path, x.action) for x in r] == [("/a.bin", "KEEP"), ("/b.bin", "DUPLICATE")]
    assert exact.exact_members(f, funnel=True).count() == 2
    assert exact.duplicate_records(_files(spark, [("/a", "x")])).count() == 0


def test_keeper_is_not_the_copy_and_paths_order_by_component(spark):
    f = _files(spark, [("/p/IMG - Copy.jpg", "1"), ("/p/IMG.jpg", "1"), ("/a-b/x.jpg", "22"), ("/a/b.jpg", "22")])
    keep = exact.duplicate_records(f).where("action = 'KEEP'").orderBy("group_id").collect()
    assert [(x.group_id, x.path) for x in keep] == [(1, "/a/b.jpg"), (2, "/p/IMG.jpg")]


def test_backends():
    assert matchers.backend("blockhash") == "perceptual"
    with pytest.raises(ConfigError):
        matchers.backend("onnx")


def test_warehouse(spark, tmp_path):
    w = store.Warehouse(spark, str(tmp_path))
    runs = spark.sql("select 'r1' run_id, timestamp'2024-01-01' timestamp, array('/v') scanned_paths, 3L total_files, 1L duplicate_groups, 5L wasted_bytes, 1.0D duration_seconds, 'completed' status")
    clusters = spark.sql("select 1L id, 'r1' run_id, 1L cluster_id, 'EXACT_HASH' match_type, 'PHOTO' category, 1.0D similarity_score")
    items = spark.sql("select * from values (1L, 1L, '/a', 'KEEP', 5L, null), (2L, 1L, '/b', 'DUPLICATE', 5L, null) t(id, cluster_id, path, action, size_bytes, dimensions)")
    for _ in range(2):  # saving a run again puts it in its own place
        w.save_run(runs, clusters, items)
    assert (w.read("scan_runs").count(), w.read("duplicate_clusters").count(), w.read("duplicate_items").count()) == (1, 1, 2)
    assert w.read("watched_paths").count() == 0
    t = store.remove_paths(store.RunTables(w.read("scan_runs"), w.read("duplicate_clusters"), w.read("duplicate_items")), spark.createDataFrame([("/b",)], "path string"))
    assert t.items.count() == 0 and t.clusters.count() == 0 and t.runs.first().wasted_bytes == 0
    w.write(scan_runs=t.runs, duplicate_clusters=t.clusters, duplicate_items=t.items)
    assert w.read("scan_runs").first().duplicate_groups == 0
    with pytest.raises(StoreError):
        w.read("nothing")


def test_runs_are_saved_by_themselves(spark, tmp_path):
    w = store.Warehouse(spark, str(tmp_path))

    def save(k, waste, path):
        run = f"r{k}"
        w.save_run(
            spark.sql(f"select '{run}' run_id, timestamp'2024-01-0{k}' timestamp, array('/v') scanned_paths, 3L total_files, 1L duplicate_groups, {waste}L wasted_bytes, 1.0D duration_seconds, 'completed' status"),
            spark.sql(f"select {k}L id, '{run}' run_id, 1L cluster_id, 'EXACT_HASH' match_type, 'PHOTO' category, 1.0D similarity_score"),
            spark.sql(f"select {k * 10}L id, {k}L cluster_id, '{path}' path, 'DUPLICATE' action, 5L size_bytes, cast(null as string) dimensions"),
        )

    save(1, 5, "/a")
    before = {k: v for k, v in w.current().items() if k[1] == "r1"}
    save(2, 7, "/b")
    assert before.items() <= w.current().items()  # nothing of the first run was written again
    save(1, 6, "/c")
    assert sorted((r.run_id, r.wasted_bytes) for r in w.read("scan_runs").collect()) == [("r1", 6), ("r2", 7)]
    assert sorted(r.path for r in w.read("duplicate_items").collect()) == ["/b", "/c"]
    w.write(scan_runs=w.read("scan_runs"), duplicate_clusters=w.read("duplicate_clusters"), duplicate_items=w.read("duplicate_items"))
    save(2, 8, "/d")  # now within tables written as a whole
    assert sorted((r.run_id, r.wasted_bytes) for r in w.read("scan_runs").collect()) == [("r1", 6), ("r2", 8)]
    assert sorted(r.path for r in w.read("duplicate_items").collect()) == ["/c", "/d"]
    pointers = tmp_path / "_pointers"
    assert len([p for p in os.listdir(pointers) if p.isdigit()]) <= w.KEPT_POINTERS + 1
    (pointers / "notes").mkdir()  # what a writer that died has left there is no pointer
    assert w.read("scan_runs").count() == 2


def test_upsert_takes_the_newest(spark):
    now = spark.createDataFrame([("/a", 1), ("/b", 1)], "path string, t int")
    new = spark.createDataFrame([("/b", 3), ("/b", 2), ("/c", 1), ("/c", 1)], "path string, t int")
    assert sorted(map(tuple, store.upsert(now, new, "path", "t").collect())) == [("/a", 1), ("/b", 3), ("/c", 1)]


def test_reports_are_one_file(spark, tmp_path):
    r = exact.duplicate_records(_files(spark, [("/a.jpg", "1"), ("/b \"x\".jpg", "1"), ("/c.jpg", "22"), ("/d.jpg", "22")]))
    out = tmp_path / "report.csv"
    for _ in range(2):  # a report is written over
        reports.write_lines(reports.csv_lines(r), str(out), reports.CSV_HEADER)
    lines = out.read_text().split("\n")
    assert lines[0] == reports.CSV_HEADER and [x.split(",")[0] for x in lines[1:5]] == ["1", "1", "2", "2"] and lines[5:] == [""]
    script = tmp_path / "clean.sh"
    reports.write_lines(reports.script_lines(r), str(script), reports.script_head("trash", "/vault"))
    text = script.read_text().split("\n")
    assert text[:2] == ["#!/usr/bin/env bash", "set -euo pipefail"] and sum(x.startswith("mv ") for x in text) == 2
    none = tmp_path / "none.csv"
    reports.write_lines(reports.csv_lines(r.limit(0)), str(none), "head")
    assert none.read_text().strip() in ("", "head")
    assert os.listdir(tmp_path).count("report.csv") == 1 and not [p for p in os.listdir(tmp_path) if p.startswith("report.csv.")]


def test_trash(spark, tmp_path):
    folder = tmp_path / reports.TRASH_DIR
    (folder / "sub").mkdir(parents=True)
    (folder / "a").write_bytes(b"12")
    (folder / "b").write_bytes(b"3")
    (folder / "sub" / "c").write_bytes(b"4")
    status = reports.trash_status(crawl.scan_files(spark, [str(tmp_path)])).first()
    assert (status.items_count, status.total_bytes, status.trash_dirs) == (2, 3, 1)
    assert reports.empty_trash([str(tmp_path), str(tmp_path / "nowhere")]) == (2, 3)
    assert (folder / "sub" / "c").exists() and reports.empty_trash([str(tmp_path)]) == (0, 0)


def test_content_is_not_exchanged(spark, sf):
    from tidemark.plans import corpus

    plan = exact.exact_members(corpus.files(spark, sf, content=True))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.rindex("Exchange")]
    assert "Exchange" in plan and "content#" not in above and "text#" not in above


def test_strategies_and_plugins(spark):
    f = spark.createDataFrame([("/a.jpg", 1, 10, "x", True, "PHOTO"), ("/b.jpg", 1, 20, "x", True, "PHOTO")], "path string, size_bytes bigint, modified_epoch bigint, content string, is_media boolean, category string")
    kept = lambda p: [r.path for r in p.records(f).where("action = 'KEEP'").collect()]
    assert kept(matchers.Pipeline().register(matchers.ExactMatcher())) == ["/a.jpg"]
    assert kept(matchers.Pipeline(keeper=keepers.NewestKeeper()).register(matchers.ExactMatcher())) == ["/b.jpg"]

    class Broken(matchers.ExactMatcher):
        name, priority = "broken", 1

        def records(self, files, keeper=None):
            raise RuntimeError("no")

    class Away(Broken):
        def available(self):
            return False, "not here"

    with pytest.raises(PluginError, match="broken"):
        matchers.Pipeline().register(Broken()).records(f)
    assert kept(matchers.Pipeline().register(matchers.ExactMatcher()).register(Away())) == ["/a.jpg"]


def test_models(spark, tmp_path):
    toml = """default_model = "quick"
[models.quick]
backend = "blockhash"
embedding_dim = 64
[models.deep]
backend = "onnx"
embedding_dim = 512
"""
    (tmp_path / "models.toml").write_text(toml)
    r = models.ModelRegistry.load(str(tmp_path / "models.toml"))
    assert r.create().dim == 64 and r.create("perceptual").name == "perceptual_blockhash_64"
    for name in ("deep", "nothing"):
        with pytest.raises(ConfigError):
            r.create(name)
    for text in ("default_model = ", "x = 1", "default_model = 'a'\n[models.a]\nbackend = 1"):
        with pytest.raises(ConfigError):
            models.ModelRegistry.from_toml(text)
    with pytest.raises(IoError):
        models.ModelRegistry.load(str(tmp_path / "nowhere.toml"))
    board = bytes(255 if (x // 4 + y // 4) % 2 else 0 for y in range(32) for x in range(32))
    images = [("/board", b"P5\n# made\n32 32\n255\n" + board), ("/colour", b"P6 32 32 255\n" + bytes(v for v in board for _ in range(3))), ("/red", b"P6 8 8 255\n" + b"\xff\0\0" * 64), ("/text", b"hello"), ("/gone", None)]
    got = {x.path: x.embedding for x in r.create().signatures(spark.createDataFrame(images, "path string, content binary")).collect()}
    assert got["/board"] == got["/colour"] and sum(got["/board"]) == 32 and got["/red"] == [0.0] * 64 and got["/text"] is None and got["/gone"] is None
    with pytest.raises(ModelError):
        models.PerceptualBackend().embed(b"P5 9")


def test_manifests(spark, tmp_path):
    import json

    record = {"group_id": 1, "match_type": "EXACT_HASH", "action": "KEEP", "category": "PHOTO", "similarity": "100%", "similarity_score": 1.0, "size_mb": 0.5, "path": "/a", "dimensions": None}
    summary = {"total_files_scanned": 2, "total_duplicate_groups": 1, "wasted_gb": 0.1, "duration_seconds": 1.0, "scanned_paths": "odd", "groups": [{"records": [record, {**record, "action": "DUPLICATE", "path": "/b"}]}]}
    (tmp_path / "s.json").write_text(json.dumps(summary))
    (tmp_path / "runs.json").write_text(json.dumps([{"run_id": "r1", "summary_json": str(tmp_path / "s.json")}]))
    path = manifest.find_summary(run_id="r1", history=str(tmp_path / "runs.json"))
    assert manifest.load_summary(path)["scanned_paths"] == []
    assert sorted((r.path, r.action) for r in manifest.load_records(spark, path).collect()) == [("/a", "KEEP"), ("/b", "DUPLICATE")]
    (tmp_path / "bad.json").write_text("{")
    for arguments in ({"run_id": "r2", "history": str(tmp_path / "runs.json")}, {"run_id": "r1", "history": str(tmp_path / "bad.json")}, {"path": str(tmp_path / "no")}, {}):
        with pytest.raises(StoreError):
            manifest.find_summary(**arguments)
    (tmp_path / "list.json").write_text("[]")
    for name in ("bad.json", "list.json"):
        with pytest.raises(SerializationError):
            manifest.load_summary(str(tmp_path / name))


def test_watcher(spark, tmp_path):
    files, told = tmp_path / "files", []
    (files / "sub").mkdir(parents=True)
    for name in ("a.jpg", "sub/a copy.jpg", "b.txt"):
        (files / name).write_bytes(b"same" if "a" in name else b"other!")
    w = store.Warehouse(spark, str(tmp_path / "store"))
    watcher = watch.Watcher(spark, w, progress=lambda *x: told.append(x))
    assert watcher.cycle() is None  # nothing is watched
    asked = spark.createDataFrame([(str(files), True), (str(tmp_path / "gone"), True)], "path string, recursive boolean")
    w.write(watched_paths=store.upsert_watched(w.read("watched_paths").select("id", "path", "recursive", "enabled"), asked).selectExpr("*", "cast(null as timestamp) last_scanned_at", "timestamp'2024-01-01' created_at"))
    watcher.pause()
    assert watcher.sweep() is None and w.read("scan_runs").count() == 0
    first = watcher.trigger()  # a manual scan is carried out while paused
    assert first and watcher.watched == {str(files)}
    run = w.read("scan_runs").first()
    assert (run.run_id, run.total_files, run.duplicate_groups, run.wasted_bytes, run.scanned_paths) == (first, 3, 1, 4, [str(files)])
    assert w.read("file_index").count() == 3 and w.read("watched_paths").where("last_scanned_at is not null").count() == 2
    (files / "b.txt").write_bytes(b"changed")
    watcher.resume()
    second = watcher.sweep()
    index = {os.path.basename(r.path): r.last_seen_run for r in w.read("file_index").collect()}
    assert index == {"a.jpg": first, "a copy.jpg": first, "b.txt": second} and w.read("duplicate_clusters").count() == 2
    assert [s["status"] for s in watcher.statuses()] == ["completed"] and told[-1] == ("complete", 3, 3)
    for f in (files / "a.jpg", files / "sub" / "a copy.jpg", files / "b.txt"):
        f.unlink()
    watcher.cycle()
    assert store.latest_run(w.read("scan_runs")).first().total_files == 0


def test_watcher_follows_events(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a").write_bytes(b"1")
    w = store.Warehouse(spark, str(tmp_path / "store"))
    w.write(watched_paths=spark.sql(f"select 1L id, '{files}' path, true recursive, true enabled, cast(null as timestamp) last_scanned_at, timestamp'2024-01-01' created_at"))
    events = spark.sql("select timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, i) event_ts, 'modify' kind, array('/f') paths from (select explode(array(0, 1, 600, 1200)) i)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    watcher = watch.Watcher(spark, w, gap="5 seconds")
    watcher.start(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    assert watcher.runs >= 1 and w.read("scan_runs").count() == watcher.runs


def test_stream_of_files(spark, tmp_path):
    import time

    root = tmp_path / "files"
    root.mkdir()
    for name in ("a.jpg", "b.txt"):
        (root / name).write_bytes(b"1")
        os.utime(root / name, (1000, 1000))
    got = []
    start = lambda: crawl.stream_files(spark, [str(root)]).writeStream.foreachBatch(lambda d, _: got.append(sorted(os.path.basename(r.path) for r in d.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q = start()
    for _ in range(100):
        if any(got):
            break
        time.sleep(0.3)
    (root / "c.mp4").write_bytes(b"2")
    for _ in range(100):
        if sum(map(len, got)) > 2:
            break
        time.sleep(0.3)
    q.stop()
    assert [x for x in got if x] == [["a.jpg", "b.txt"], ["c.mp4"]]


def test_pauses_without_interval_join(spark):
    e = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, i, 0) event_ts, i from (select explode(sequence(0, 300, 10)) i)")
    p = spark.sql("select timestamp'2024-01-01 00:30:00' from_ts, timestamp'2024-01-01 02:00:00' to_ts union all select timestamp'2024-01-01 00:40:00', timestamp'2024-01-01 00:50:00' union all select timestamp'2024-01-01 04:00:00', timestamp'2024-01-01 04:00:00'")
    d = watch.outside_pauses(e, p)
    assert sorted(r.i for r in d.collect()) == [i for i in range(0, 301, 10) if not 30 <= i < 120]
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()


def test_content_classes(spark):
    ensure_checkpoints(spark)
    base = [f"w{i}" for i in range(100)]
    texts = [(1, " ".join(base)), (2, "  ".join(base).upper()), (3, " ".join([*base[:50], "x", *base[51:]])), (4, " ".join(base[50:] + base[:50])), (5, None), (6, "one two"), (6, "one two three"), (7, "one two"), (None, "one two"), (8, "")]
    got = {r.doc_id: r.class_id for r in content.content_classes(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}
    assert content.content_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_command_line(spark, tmp_path, capsys):
    import json

    from tidemark.__main__ import main

    files = tmp_path / "files"
    files.mkdir()
    for name in ("a.jpg", "a - Copy.jpg"):
        (files / name).write_bytes(b"123")
    base = ["--warehouse", str(tmp_path / "store")]
    said = lambda: json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert main([*base, "status"], spark) == 0 and said() == {"status": "none"}
    assert main([*base, "scan", str(files), "--report", str(tmp_path / "r.csv")], spark) == 0
    assert said()["duplicate_groups"] == 1 and len((tmp_path / "r.csv").read_text().split()) > 2
    assert main([*base, "clean", "--base", str(tmp_path)], spark) == 0
    assert os.listdir(files) == ["a.jpg"] and os.listdir(tmp_path / reports.TRASH_DIR) == ["a - Copy.jpg"]
    assert main([*base, "prune", str(files)], spark) == 0 and said()["duplicate_groups"] == 0
    assert main([*base, "prune", str(tmp_path / "nowhere")], spark) == 1


def test_plans_spare_keepers(spark, tmp_path):
    a, b = tmp_path / "a.jpg", tmp_path / "b.jpg"
    a.write_bytes(b"1")
    b.write_bytes(b"1")
    r = exact.duplicate_records(_files(spark, [(str(a), "1"), (str(b), "1")]))
    ask = spark.createDataFrame([(str(a),), (str(b),)], "path string")
    plan = reports.delete_plan(r, ask, "hardlink")
    keepers = r.where("action = 'KEEP'").select("path")
    assert reports.carry_out(plan, keepers) == (1, 1)
    assert os.stat(a).st_ino == os.stat(b).st_ino
    with pytest.raises(SecurityError):
        reports.carry_out(ask.selectExpr("'permanent' op", "path src", "null dst", "1 size_bytes"), keepers)


def test_rates_round_as_printf(spark):
    """Halves to even, and by the exact value: 1.45 is a little less, 1.05 a little more than it says."""
    sizes = [*range(1990, 42000, 25), 9999999, 123456789012345, 39999, 2000 * 7 + 1999, 19_900, 19_901]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", X.rate(F.col("n"), F.lit(2)).alias("r")).collect()
    assert {r.n: r.r for r in got} == {n: f"{n / 2000:.1f}k/s" if n >= 2000 else f"{round(n / 2)}/s" for n in sizes}


def test_hamming_clusters(spark):
    ensure_checkpoints(spark)
    codes = [(1, 0), (2, 0), (3, 7), (4, 7 << 30), (5, (7 << 30) | 3), (6, -1)]
    d = spark.createDataFrame(codes, "id bigint, code bigint")
    assert {r.id: r.label for r in similarity.hamming_clusters(d, 3).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    for bands in (2, 5, 16):
        got = {(r.x, r.y) for r in similarity.code_pairs(d.select("code").distinct(), 3, bands).collect()}
        assert got == {(0, 7), (0, 7 << 30), (7 << 30, (7 << 30) | 3)}


def test_hamming_pairs_by_bands(spark):
    codes = [(i, c) for i, c in enumerate([0, 1, 3, -1, 0x0F0F, 0x0F0E, 1 << 62])]
    got = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(spark.createDataFrame(codes, "id bigint, code bigint"), 3).collect()}
    bits = lambda x: bin(x & (1 << 64) - 1).count("1")
    assert got == {(i, j): bits(x ^ y) for i, x in codes for j, y in codes if i < j and bits(x ^ y) <= 3}


def _exchanged(spark, run):
    """What ``run`` returns, and the rows that its stages wrote to exchanges."""
    sc = spark.sparkContext._jsc.sc()
    convert = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters

    def stages():
        sc.listenerBus().waitUntilEmpty()
        s = sc.statusStore()
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in convert.asJava(s.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_hamming_pairs_exchange_few_rows(spark):
    """At 19 of 64 bits an index is probed with hundreds of values a code and more; none of that may become rows."""
    rng = np.random.default_rng(4)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 1500)
    d = spark.createDataFrame(list(enumerate(codes.tolist())), "id bigint, code bigint")
    got, rows = _exchanged(spark, lambda: {(r.a, r.b): r.distance for r in similarity.hamming_pairs(d, 19).collect()})
    apart = np.bitwise_count(codes.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None, :])
    assert got == {(i, j): int(apart[i, j]) for i, j in zip(*np.nonzero(np.triu(apart <= 19, 1)), strict=True)}
    assert rows < 20 * len(codes)
    few = {(r.x, r.y) for r in similarity.code_pairs(d.select("code").distinct(), 19, 100).collect()}  # 15 blocks
    assert few == {tuple(sorted((int(codes[i]), int(codes[j])))) for i, j in got}


def test_hamming_clusters_of_dense_codes(spark):
    """Codes that are all near each other take some links a code, not all pairs."""
    ensure_checkpoints(spark)
    rng = np.random.default_rng(5)
    flips = [sum(1 << int(b) for b in rng.choice(40, 4, replace=False)) for _ in range(1200)]
    codes = [*flips, *(f ^ ((1 << 23) - 1 << 40) for f in flips[:100]), 0x5555555555555555]
    d = spark.createDataFrame(list(enumerate(codes)), "id bigint, code bigint")
    got, rows = _exchanged(spark, lambda: {r.id: r.label for r in similarity.hamming_clusters(d, 10).collect()})
    assert got == {**dict.fromkeys(range(1200), 0), **dict.fromkeys(range(1200, 1300), 1200)}
    assert rows < 60 * len(codes)
    assert similarity.code_links(d.select("code").distinct(), 10, 100).count() < 30 * len(codes)  # 14 blocks


def test_cosine_pairs_by_blocks(spark):
    """Pairs as by brute force over several blocks; vectors of zeros make NaN as in SQL, odd ones are in no pair."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    v[7] = v[700] * 2
    d = spark.createDataFrame([*((f"{i:03}", v[i].tolist()) for i in range(900)), ("odd", [1.0]), ("null", None), ("hole", [None] * 8), (None, v[0].tolist())], "id string, vec array<float>")
    w = v.astype(np.float64)
    w /= np.linalg.norm(w, axis=1)[:, None]
    s = w @ w.T
    expected = {(f"{i:03}", f"{j:03}"): s[i, j] for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)}
    for block_rows in (1024, 32768):
        got = {(r.a, r.b): r.similarity for r in similarity.cosine_pairs(d, 0.9, block_rows).collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id bigint, vec array<double>")
    assert sorted((r.a, r.b, repr(r.similarity)) for r in similarity.cosine_pairs(few, 0.4).collect()) == [(1, 2, "nan"), (1, 3, "nan")]


def test_clusters_of_long_chains(spark):
    ensure_checkpoints(spark)
    chains = spark.range(200).selectExpr("id a", "id + 1 b").union(spark.range(1000, 1090).selectExpr("id + 1", "id"))
    got = {r.id: r.label for r in similarity.clusters(chains).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1091), 1000)}


def test_debounce_stream_equals_batch(spark, sf, tmp_path):
    """The stream emits every window but the last, which is open still."""
    src = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("event_ts"), F.lit("modify").alias("kind"), F.array(F.lit("/f")).alias("paths"))
    src.orderBy("event_ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = watch.start(stream, "60 seconds", lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = {(r.first_ts, r.n_events) for r in watch.debounce(src, "60 seconds").collect()}
    streamed = {(r.first_ts, r.n_events) for r in got}
    assert streamed <= batch and len(batch) - len(streamed) <= 2
