"""Operators on small inputs, against plain Python where there is something to compute."""

import random

from pyspark.sql import functions as F

from archive_catalog.functions import text as tx
from archive_catalog.operators import acoustic, analyze, browse, cue, dedup, enrich, scan_job, snapshot, stats
from archive_catalog.operators.graph import components
from archive_catalog.sources import readers
from archive_catalog.streaming.ingest import read_table, stream_ingest

CUE = 'REM x\nPERFORMER "P"\nTITLE "Album"\nFILE "rip.flac" WAVE\n  TRACK 01 AUDIO\n    TITLE "One"\n    INDEX 00 00:00:00\n    INDEX 01 00:02:00\n  TRACK 02 AUDIO\n    TITLE Two\n    PERFORMER "Q"\n    INDEX 00 03:00:00\n'


def test_cue(spark):
    sheets = spark.createDataFrame([("a", CUE), ("b", ""), ("c", "TRACK 05 AUDIO\r\nINDEX 01 1:0:0"), ("d", None)], "sheet_id string, text string")
    tracks = [tuple(r) for r in cue.cue_tracks(sheets).select("sheet_id", "ord", "track_no", "title", "performer", "start_ms", "end_ms").orderBy("sheet_id", "ord").collect()]
    assert tracks == [("a", 1, 1, "One", None, 2000, 180000), ("a", 2, 2, "Two", "Q", 180000, None), ("c", 1, 5, None, None, 60000, None)]
    found = {r["sheet_id"]: (r["file_ref"], r["album_title"], r["n_tracks"], r["status"]) for r in cue.cue_sheets(sheets).collect()}
    assert found == {"a": ("rip.flac", "Album", 2, "OK"), "b": (None, None, 0, "PARTIAL"), "c": (None, None, 1, "PARTIAL"), "d": (None, None, 0, "PARTIAL")}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in {n for e in edges for n in e}}


def test_bit_error_rate_and_pairs(spark):
    items = spark.createDataFrame([(1, [0, 0xFFFFFFFF], 100.0), (2, [0, 0xFFFFFFFE], 107.0), (3, [0, 0xFFFFFFFF], 107.5), (4, [], 100.0), (5, None, 100.0)], "file_id long, fp array<bigint>, duration_sec double")
    got = {(r["a"], r["b"]): r["ber"] for r in acoustic.fingerprint_pairs(items).collect()}
    assert got == {(1, 2): 1 / 64, (2, 3): 1 / 64}
    assert {(r["a"], r["b"]): r["ber"] for r in acoustic.fingerprint_pairs(items, share=1).collect()} == got


def test_clusters_of_equal_fingerprints(spark):
    """Groups are those of all pairs, with copies, empty and missing fingerprints among the items; buckets are cut into parts."""
    rng = random.Random(3)
    prints = [[rng.randrange(1 << 32) for _ in range(2)] for _ in range(6)] + [[]]
    rows = [(i, rng.choice(prints), 100.0 + 3 * rng.randrange(5)) for i in range(60)]
    rows += [(100 + i, [rng.choice(prints[:6])[0] ^ (1 << rng.randrange(32)), 7], 103.0) for i in range(10)] + [(200, None, 100.0), (201, [], 100.0), (202, [1], None)]
    items = spark.createDataFrame(rows, "file_id long, fp array<bigint>, duration_sec double")
    got = {(r["group_id"], r["file_id"], r["n_members"]) for r in acoustic.fingerprint_clusters(items).collect()}
    want = {(r["group_id"], r["file_id"], r["n_members"]) for r in acoustic.fingerprint_groups(acoustic.fingerprint_pairs(items, share=7)).collect()}
    assert got == want and len(want) > 40


def compressed(words, head=b"\x01"):
    """A plain encoder: steps between set bits of each word XORed with the one before."""
    steps, more, last = [], [], 0
    for w in words:
        at = 0
        for bit in range(32):
            if (w ^ last) >> bit & 1:
                step, at = bit + 1 - at, bit + 1
                steps.append(min(step, 7))
                if step >= 7:
                    more.append(step - 7)
        steps.append(0)
        last = w
    out = b""
    for values, width in ((steps, 3), (more, 5)):
        bits = "".join(format(v, f"0{width}b")[::-1] for v in values)
        bits += "0" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return head + len(words).to_bytes(3, "big") + out


def test_decode_fingerprint(spark):
    import base64

    rng = random.Random(1)
    prints = [[5, 5 ^ (1 << 9)], [0], [0xFFFFFFFF, 1, 1 << 31]] + [[rng.randrange(1 << 32) & rng.randrange(1 << 32) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    raw = [compressed(p) for p in prints]
    bad = [b"", b"\x01\x00", b"\x01\x00\x00\x00", b"\x01\x00\x00\x05\x00", b"\x01\x0f\xff\xff" + b"\x00" * 9, raw[0][:-1], b"\x01\x00\x00\x01" + b"\xff" * 3]
    mixed = [x for pair in zip(raw, bad * 7, strict=False) for x in pair]
    got = [None if x is None else x.tolist() for x in acoustic.decode_many(mixed)]
    assert got[::2] == prints and not any(got[1::2])
    texts = [base64.urlsafe_b64encode(raw[3]).decode().rstrip("="), base64.b64encode(raw[4]).decode(), "AQ", "not base64!", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    assert [r["w"] for r in df.select("i", acoustic.decode_fingerprint(F.col("t")).alias("w")).orderBy("i").collect()] == [prints[3], prints[4], None, None, None]
    assert acoustic.decode_many([]) == []


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("v", "a", 1), ("v", "b", 2)], "volume_id string, rel_path string, size_bytes int")
    old = spark.createDataFrame([("v", "a", 9, 1, 1), ("v", "c", 3, 1, 1)], "volume_id string, rel_path string, size_bytes int, first_seen long, last_seen long")
    once = snapshot.snapshot_upsert(old, new, F.lit(2).cast("long"))
    twice = snapshot.snapshot_upsert(once, new, F.lit(2).cast("long"))
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect())) == [("v", "a", 1, 1, 2), ("v", "b", 2, 2, 2), ("v", "c", 3, 1, 1)]


def test_sequence_and_types(spark):
    files = spark.createDataFrame([(1, f"{i:02d} - x.mp3") for i in range(1, 6)] + [(2, "99 Luftballons.mp3"), (2, "other.mp3")], "directory_id int, filename string")
    assert {r["directory_id"]: r["has_sequence"] for r in analyze.sequence_flags(files).collect()} == {1: True, 2: False}
    rows = [(1, 2, 2, 0, False, None, True), (2, 1, 1, 0, False, 1, False), (3, 1, 1, 0, True, None, False), (4, 0, 2, 0, False, None, False), (5, 0, 0, 0, False, None, False), (6, 2, 2, 1, False, None, False), (7, 2, 2, 0, False, None, False), (8, 0, 1, 2, False, None, False)]
    df = spark.createDataFrame(rows, "id int, a long, f long, c long, rip boolean, d int, p boolean")
    kinds = [r["t"] for r in df.orderBy("id").select(analyze.directory_type(*[F.col(c) for c in ("a", "f", "c", "rip", "d", "p")]).alias("t")).collect()]
    assert kinds == ["MULTIDISC_PARENT", "MULTIDISC_CHILD", "ALBUM_RIP", "NON_AUDIO", "UNKNOWN", "MIXED", "ALBUM", "UNKNOWN"]


def test_duplicates_ignore_null_and_empty(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, ""), (6, "")], "file_id int, content_hash string")
    assert sorted((r["group_id"], r["file_id"], r["n_members"]) for r in dedup.exact(df).collect()) == [(1, 1, 2), (1, 2, 2)]
    assert dedup.exact(df.limit(0)).count() == 0


def test_inventory_skips_system_folders(spark):
    paths = ["a/b.mp3", "$RECYCLE.BIN/x.mp3", "a/.hidden", "a/Thumbs.db", "x/.Spotlight-V100/y"]
    df = spark.createDataFrame([("v", p) for p in paths], "volume_id string, rel_path string")
    assert sorted(r["rel_path"] for r in readers.file_inventory(df).collect()) == ["a/.hidden", "a/Thumbs.db", "a/b.mp3"]


def test_tool_output(spark):
    df = spark.createDataFrame([('{"duration": 12.5, "fingerprint": "AQ"}',), ("DURATION=254\nFINGERPRINT=AQB\n",), ("oops",), ("{bad",), (None,)], "stdout string")
    got = [(r["fingerprint"], r["duration"]) for r in readers.fingerprint_ingest(df).collect()]
    assert got == [("AQ", 12.5), ("AQB", 254.0), (None, None), (None, None), (None, None)]
    out = spark.createDataFrame([("a\nAm\n\n", "9000 then 128.04 bpm 900"), ("", "none"), ("x", "7 9")], "k string, b string")
    assert [tuple(r) for r in out.select(readers.key_of_output(F.col("k")), readers.bpm_of_output(F.col("b"))).collect()] == [("Am", 128.0), (None, None), ("x", 9.0)]


def test_enrichment_parsers(spark):
    raw = '{"status":"ok","results":[{"score":0.5,"recordings":[{"id":"r1","title":"T","artists":[{"name":"A"},{"name":"B"}]}]},{"score":0.9,"recordings":[{"id":"r2"},{"id":"r3"}]}]}'
    df = spark.createDataFrame([("q", raw), ("e", '{"status":"error"}'), ("n", None)], "query_used string, raw string")
    assert [(r["query_used"], r["recording_mbid"], r["score"]) for r in enrich.acoustid_best(df).collect()] == [("q", "r2", 0.9)]
    rel = spark.createDataFrame([("a", '{"results":[{"id":1,"title":"X","year":"1999","genre":["Rock"]}]}'), ("b", '{"results":[]}')], "query_used string, raw string")
    assert [tuple(r) for r in enrich.discogs_albums(rel).collect()] == [("a", 1, "X", 1999, ["Rock"], [])]


def test_search_union_prefers_audio(spark):
    audio = spark.createDataFrame([(1, 1, "A", None, "a.mp3")], "file_id int, directory_id int, resolved_title string, tag_title string, filename string")
    files = spark.createDataFrame([(1, 1, "a.mp3"), (2, 1, "b.mp3")], "file_id int, directory_id int, filename string")
    assert [tuple(r) for r in browse.search_union(audio, files, 10).orderBy("file_id").collect()] == [("audio", 1, 1, "A", 2), ("file", 2, 1, "b.mp3", 2)]


def test_stream_continues_after_restart(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, x int, seq long")
    table = str(tmp_path / "t")
    schema = rows.withColumn("first_seen", F.lit(0).cast("long")).withColumn("last_seen", F.lit(0).cast("long")).schema
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert read_table(spark, table, schema).count() == 0

    def run(state, source="in"):
        stream_ingest(spark, str(tmp_path / source), rows.schema, table, schema, str(tmp_path / state), ["k"], "seq").awaitTermination()
        return sorted((r["k"], r["x"], r["first_seen"]) for r in read_table(spark, table, schema).collect())

    assert run("state") == [("a", 1, 0), ("b", 2, 0)]
    spark.createDataFrame([("a", 5, 2)], "k string, x int, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run("state") == [("a", 5, 0), ("b", 2, 0)]
    # a new checkpoint goes on with the table that is there
    spark.createDataFrame([("c", 7, 1)], "k string, x int, seq long").coalesce(1).write.parquet(str(tmp_path / "more"))
    assert run("other", "more") == [("a", 5, 0), ("b", 2, 0), ("c", 7, 0)]


def test_sources_from_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "list.csv").write_text("volume_id,rel_path,is_dir,size_bytes,mtime,ctime\nv,sub,true,0,2020-01-02 03:04:05,\nv,sub/b.mp3,false,7,2020-01-02 03:04:05,\nv,.hidden,false,1,,\nv,a.txt,false,1,,\n")
    listed = readers.read_manifest(spark, str(tmp_path / "m"), "csv")
    walked = [r["rel_path"] for r in readers.file_inventory(listed).orderBy(readers.walk_order()).collect()]
    assert walked == [".hidden", "a.txt", "sub", "sub/b.mp3"]  # a directory before what it holds
    listed.write.parquet(str(tmp_path / "p"))
    assert readers.read_manifest(spark, str(tmp_path / "p")).count() == 4

    (tmp_path / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "a.cue").write_bytes("TITLE \"Zażółć\"".encode("cp1250"))
    (tmp_path / "raw" / "deep" / "b.cue").write_bytes(b"\xef\xbb\xbf" + "Łódź".encode())
    (tmp_path / "raw" / "c.bin").write_bytes(b"x")
    files = readers.read_binary(spark, str(tmp_path / "raw"), "*.cue")
    assert {(r["text"], r["encoding"]) for r in readers.decode_text(files).collect()} == {('TITLE "Zażółć"', "windows-1250"), ("Łódź", "UTF-8")}
    hashes = {r["content_hash"] for r in readers.content_hash(files).collect()}
    assert len(hashes) == 2 and all(len(h) == 64 for h in hashes)

    (tmp_path / "ref" / "0" / "a").mkdir(parents=True)
    one = '{"metadata": {"tags": {"musicbrainz_recordingid": ["m1"]}}, "rhythm": {"bpm": 120.5}, "tonal": {"key_key": "A", "key_scale": "minor"}}'
    (tmp_path / "ref" / "0" / "m1.json").write_text(one)
    (tmp_path / "ref" / "0" / "a" / "again.json").write_text(one)
    (tmp_path / "ref" / "0" / "a" / "noid.json").write_text('{"metadata": {}, "rhythm": {"bpm": 1}}')
    (tmp_path / "ref" / "bad.json").write_text("{no json")
    (tmp_path / "ref" / "x.txt").write_text("x")
    got = readers.reference_features(readers.read_reference(spark, str(tmp_path / "ref"))).collect()
    assert [tuple(r) for r in got] == [("m1", 120.5, "A", "minor", "8A")]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame([("Zażółć gęślą jaźń",), ("plain",), ("€ „x”",)], "t string")
    raw = df.select("t", readers.encode_text(F.col("t")).alias("content"))
    assert all(bytes(r["content"]) == r["t"].encode("cp1250") for r in raw.collect())
    assert all(r["t"] == r["text"] for r in readers.decode_text(raw).collect())


def test_register_volumes(spark):
    volumes = spark.createDataFrame([("v1", "OLD", "S1", None, 5), ("v2", "SOFT", None, "ntfs", 9)], "volume_id string, label string, serial string, fs_type string, total_bytes long")
    probes = spark.createDataFrame(
        [
            ("p1", "S1", "DET", None, "ext4", 6), ("p2", "S1", None, None, None, None), ("p3", None, "SOFT", "Given", "ntfs", 9), ("p4", "X7", "A", None, "fat", 1), ("p5", "X7", "B", "Mine", None, 2),
            ("p6", None, "N", None, "fat", 3), ("p7", None, "N", None, "fat", 3), ("p8", None, None, None, None, None), ("p9", None, None, None, None, None), ("q0", None, "Given", None, "ntfs", 9),
        ],
        "probe_id string, serial string, label string, given_label string, fs_type string, total_bytes long",
    )
    rows = {r["volume_id"]: tuple(r)[1:] for r in snapshot.register_volumes(probes, volumes).collect()}
    assert rows == {
        "v1": ("UNNAMED", "S1", "ext4", 6), "v2": ("Given", None, "ntfs", 9), "p4": ("Mine", "X7", "fat", 2), "p6": ("N", None, "fat", 3), "p8": ("UNNAMED", None, None, None), "p9": ("UNNAMED", None, None, None),
        "q0": ("Given", None, "ntfs", 9),  # what is detected is matched, not what was given
    }
    again = snapshot.register_volumes(probes, snapshot.register_volumes(probes, volumes))
    assert sum(r["serial"] == "X7" for r in again.collect()) == 1


FILES = "volume_id string, rel_path string, size_bytes long, mtime long, content_hash string, status string, filename string, extension string, filename_norm string, file_type string, is_hidden boolean, directory_id string, file_id string, first_seen long, last_seen long"


def test_scan_from_inventory_to_counters(spark):
    """Two scans of a small tree: an album, a set of two discs, system files; a file changes, one goes, one can't be read."""
    tree = ["Album/01 - A.mp3", "Album/02 - B.mp3", "Album/x.cue", "Album/front.jpg", "Set/CD1/01.flac", "Set/CD2/01.flac", "Thumbs.db", "$RECYCLE.BIN/x.mp3"]
    manifest = lambda rows: spark.createDataFrame([("v", p, s, m) for p, s, m in rows], "volume_id string, rel_path string, size_bytes long, mtime long")
    digest = lambda m, mark: m.select("volume_id", "rel_path", F.concat(F.lit(mark), "rel_path").alias("content_hash"))
    first = manifest([(p, 10, 1) for p in tree])
    one = scan_job.scan(first, spark.createDataFrame([], FILES), F.lit(1).cast("long"), digest(first, "h1 "))
    assert one.counters.first().asDict() == {"dirs_seen": 4, "files_seen": 7, "audio_seen": 4, "errors": 0, "bytes_seen": 70}
    counts = {r["rel_path"]: (r["file_count"], r["audio_count"], r["has_cue"]) for r in one.directories.collect()}
    assert counts == {"": (1, 0, False), "Album": (4, 2, True), "Set": (0, 0, False), "Set/CD1": (1, 1, False), "Set/CD2": (1, 1, False)}
    known = one.files.select(*[c.split()[0] for c in FILES.split(", ")])
    second = manifest([(p, 11 if p.endswith("A.mp3") else 10, 1) for p in tree if not p.endswith("B.mp3")] + [("Album/03 - C.mp3", 5, 1)])
    two = scan_job.scan(second, known, F.lit(2).cast("long"), digest(second, "h2 "), manifest([("Album/03 - C.mp3", 0, 0)]))
    rows = {r["rel_path"]: (r["content_hash"], r["status"], r["first_seen"], r["last_seen"]) for r in two.files.collect()}
    assert rows["Album/01 - A.mp3"] == ("h2 Album/01 - A.mp3", "METADATA_READ", 1, 2)
    assert rows["Album/02 - B.mp3"] == ("h1 Album/02 - B.mp3", "METADATA_READ", 1, 1)
    assert rows["Album/03 - C.mp3"] == ("h2 Album/03 - C.mp3", "ERROR", 2, 2)
    assert rows["Album/x.cue"] == ("h1 Album/x.cue", "HASHED", 1, 2)
    assert two.counters.first()["errors"] == 1


def test_enrich_requests(spark):
    albums = spark.createDataFrame(
        [("d1", "Album", "f1", "print", 10.0, "w1", "Artist", "Tagged"), ("d2", "B", None, None, None, None, None, None), ("d3", "Third", "f3", "other", 5.0, None, None, None), ("d4", "", None, None, None, None, None, None)],
        "directory_id string, name string, file_id string, fingerprint string, duration_sec double, work_id string, resolved_artist string, tag_album string",
    )
    best = albums.where("fingerprint IS NOT NULL").select(F.sha2("fingerprint", 256).alias("query_used"), F.concat(F.lit("mb-"), "file_id").alias("recording_mbid"))
    got = {tuple(r)[1:] for r in enrich.enrich_requests(albums, best).collect()}
    import hashlib

    key = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {("ACOUSTID", "f1", None, key("print")), ("ACOUSTID", "f3", None, key("other")), ("MUSICBRAINZ", "f1", None, "mb-f1"), ("DISCOGS", None, "d1", "Artist Tagged"), ("DISCOGS", None, "d3", "Third")}
    assert got == want  # a query of one letter is none
    cache = spark.createDataFrame([("ALBUM", "DISCOGS", "Third"), ("FILE", "ACOUSTID", key("print"))], "scope string, source string, query_used string")
    assert {r["query_used"] for r in enrich.open_requests(enrich.enrich_requests(albums, best), cache).collect()} == {x[3] for x in want} - {"Third"}


def test_newest_groups_of_a_kind(spark):
    groups = spark.createDataFrame([("A", i, 10 * i + j, i) for i in range(5) for j in range(2)] + [("B", 9, 99, 9), ("B", 9, 98, 9)], "kind string, group_id int, file_id int, created_at int")
    files = groups.select("file_id", F.lit("v").alias("volume_id"), F.lit(1).alias("size_bytes"))
    ids = lambda df: sorted(r["group_id"] for r in df.collect())
    assert ids(dedup.report(groups, files, 2)) == [4, 9] and ids(dedup.report(groups, files, 2, "A")) == [3, 4]


def test_report_gives_every_member_with_file_and_volume(spark):
    groups = spark.createDataFrame([("A", i, 10 * i + j, i) for i in range(3) for j in range(3)], "kind string, group_id int, file_id int, created_at int")
    files = spark.createDataFrame([(10 * i + j, [None, "v", "w"][j], f"{j}.mp3", f"d{i}/{j}.mp3", 5 + j) for i in range(3) for j in range(3)], "file_id int, volume_id string, filename string, rel_path string, size_bytes int")
    volumes = spark.createDataFrame([("v", "Disk")], "volume_id string, label string")
    got = sorted(map(tuple, dedup.report_members(groups, files, volumes, 2).collect()))
    assert got == [("A", i, 3, 2, 18, 10 * i + j, f"{j}.mp3", f"d{i}/{j}.mp3", 5 + j, "Disk" if j == 1 else None) for i in (1, 2) for j in range(3)]


def test_interrupted_runs(spark):
    runs = spark.createDataFrame([(i, "v", "SCAN", "INTERRUPTED" if i in (1, 18) else "COMPLETED", i) for i in range(20)], "run_id int, volume_id string, kind string, status string, started_at int")
    volumes = spark.createDataFrame([("v", "Disk")], "volume_id string, label string")
    assert [(r["run_id"], r["label"]) for r in stats.interrupted_runs(runs, volumes).collect()] == [(18, "Disk")]


def test_lookups_under_either_key(spark):
    long = "A" * 70
    albums = spark.createDataFrame([(1, 10, long, 200.0, "w1", None, None, "name"), (2, 11, long + "B", 200.0, None, "x", "y", "name")], "directory_id long, file_id long, fingerprint string, duration_sec double, work_id string, resolved_artist string, tag_album string, name string")
    cache = spark.createDataFrame([("FINGERPRINT", "ACOUSTID", "A" * 64)], "scope string, source string, query_used string")
    best = spark.createDataFrame([("A" * 64, "rec")], "query_used string, recording_mbid string")
    old = enrich.enrich_requests(albums, best, enrich.print_start)
    assert {(r["source"], r["query_used"]) for r in enrich.open_requests(old, cache).collect()} == {("MUSICBRAINZ", "rec"), ("DISCOGS", "name"), ("DISCOGS", "x y")}
    new = enrich.enrich_requests(albums, best)
    assert len({r["query_used"] for r in enrich.open_requests(new, cache).where("source = 'ACOUSTID'").collect()}) == 2


def test_recordings_reach_their_works(spark):
    works = spark.createDataFrame([("w1", "old", "a", 0.5), ("w2", "stays", "b", 0.4), ("w3", "bare", None, 0.3)], "work_id string, title string, artist string, confidence double")
    audio = spark.createDataFrame([(2, "k2", "w1"), (1, "k1", "w1"), (3, "k9", "w2"), (4, "k1", None), (5, "k3", "w3")], "file_id long, lookup_key string, work_id string")
    best = spark.createDataFrame([("k1", "r1"), ("k2", "r2"), ("k3", "r3")], "query_used string, recording_mbid string")
    recordings = spark.createDataFrame([("r1", "m1", "One", "A1"), ("r2", "m2", "Two", "A2"), ("r3", "m3", "Bare!", None)], "recording_mbid string, work_mbid string, work_title string, artist string")
    got = sorted((r["work_id"], r["title"], r["artist"], r["work_mbid"], r["confidence"]) for r in enrich.apply_to_works(works, audio, best, recordings).collect())
    assert got == [("w1", "One", "A1", "m1", enrich.WORK_CONFIDENCE), ("w2", "stays", "b", None, 0.4), ("w3", "Bare!", None, "m3", enrich.WORK_CONFIDENCE)]


def test_white_space_beyond_ascii(spark):
    rows = [("Song by x", "Song"), ("Song (Official Video)", "Song"), ("Song by x", "Song"), ("Songbyx", "Songbyx"), ("Song - Video", "Song")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", tx.strip_junk(F.col("t"))).collect())
    kinds = spark.createDataFrame([("Radio Edit", "RADIO_EDIT"), ("a cappella", "ACAPELLA"), ("a-cappella", "ACAPELLA"), ("original　mix", "ORIGINAL")], "t string, want string")
    assert all(r["got"] == r["want"] for r in kinds.withColumn("got", tx.version_kind(F.col("t"))).collect())


def test_subtrees_of_a_deep_chain(spark):
    """A chain of 60 directories with a file at every third, a sibling with a name that begins alike, and a second volume."""
    chain = ["/".join(f"d{k}" for k in range(i)) for i in range(61)]
    paths = [("v", f"{d}/f{i}.mp3" if d else f"f{i}.mp3", i) for i, d in enumerate(chain) if i % 3 == 0] + [("v", "d0x/a.txt", 1000), ("v", "d0/b.mp3", 5), ("w", "d0/c.mp3", 7)]
    files = spark.createDataFrame(paths, "volume_id string, rel_path string, size_bytes long").withColumn("file_type", tx.file_type(F.col("rel_path")))
    tree = snapshot.with_parent(snapshot.directory_tree(files))
    placed = snapshot.file_directory(files, tree)
    rows = snapshot.subtree_totals(tree, placed).join(tree.select("directory_id", "volume_id", "rel_path"), "directory_id").collect()
    got = {(r["volume_id"], r["rel_path"]): (r["tree_files"], r["tree_audio"], r["tree_bytes"], r["tree_directories"], r["height"]) for r in rows}
    for (v, d), have in got.items():
        under = [p for p in paths if p[0] == v and (not d or p[1].startswith(d + "/"))]
        dirs = [x for w, x in got if w == v and (not d or x == d or x.startswith(d + "/"))]
        level = lambda x: x.count("/") + 1 if x else 0
        assert have == (len(under), sum(p[1].endswith(".mp3") for p in under), sum(p[2] for p in under), len(dirs), max(map(level, dirs)) - level(d)), d
    assert len(got) == 61 + 1 + 2
