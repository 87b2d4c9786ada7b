"""The atomic sink, packets merged with cues, container headers as a source, and the run slot."""

import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from cuelake.plans import runs
from cuelake.sources import containers, media, mux, named_files, subtitles

# --- sink


def contents(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(folder) for f in fs}


def test_named_files(spark, tmp_path):
    to = str(tmp_path / "out")
    rows = [(f"film{k}.zh.srt", f"text {k}\r\n字") for k in range(20)] + [("show/one.ass", None), ("empty.srt", "")]
    named_files.write_named(spark.createDataFrame(rows, "name string, text string").repartition(4), to)
    assert contents(to).keys() == {n for n, _ in rows} and (tmp_path / "out" / "film3.zh.srt").read_bytes() == "text 3\r\n字".encode()
    named_files.write_named(spark.createDataFrame([("film3.zh.srt", "new"), ("more.srt", "x")], "name string, text string"), f"file://{to}")
    assert contents(to)["film3.zh.srt"] == "new" and len(contents(to)) == 23


@pytest.mark.parametrize("broken", ["row", "twice", "outside"])
def test_a_failed_job_leaves_old_files(spark, tmp_path, broken):
    to = str(tmp_path / "out")
    named_files.write_named(spark.createDataFrame([(f"{k}.srt", f"old {k}") for k in range(8)], "name string, text string"), to)
    files = spark.range(8).repartition(4).select(F.concat("id", F.lit(".srt")).alias("name"), F.concat(F.lit("new "), "id").alias("text"))
    if broken == "row":
        files = files.withColumn("text", F.when(F.col("name") == "5.srt", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    elif broken == "twice":
        files = files.unionByName(files.where("name = '5.srt'"))
    else:
        files = files.withColumn("name", F.when(F.col("name") == "5.srt", "../5.srt").otherwise(F.col("name")))
    with pytest.raises(Exception):  # noqa: B017
        named_files.write_named(files, to)
    assert contents(to) == {f"{k}.srt": f"old {k}" for k in range(8)} and not (tmp_path / "5.srt").exists()
    assert len(os.listdir(to)) == 8  # nor a folder of the job


def test_many_files_need_few_tasks(spark, tmp_path):
    """Neither moving nor reading has a task for each file, nor does the driver move them."""
    files = spark.range(300).repartition(3).select(F.concat_ws("/", F.col("id") % 7, F.concat("id", F.lit(".srt"))).alias("name"), F.concat(F.lit("t"), "id").alias("text"))
    names = named_files.write_named(files, str(tmp_path))
    back = named_files.read_named(names, str(tmp_path))
    assert back.rdd.getNumPartitions() == 3
    assert {(r["name"], r["text"]) for r in back.collect()} == {(f"{k % 7}/{k}.srt", f"t{k}") for k in range(300)}
    named_files.remove_named(names.where("name <> '0/0.srt'"), str(tmp_path))
    assert contents(str(tmp_path)) == {"0/0.srt": "t0"}


def test_files_under_free_names(spark, tmp_path):
    """Names of SNK-5 for texts of films."""
    names = media.output_name(spark.createDataFrame([("a", "zh"), ("b", "zh")], "stem string, suffix string"), spark.createDataFrame([("a.zh.mkv",)], "path string"))
    texts = spark.createDataFrame([("a", "one"), ("b", "two")], "stem string, text string")
    files = names.join(texts, "stem").select(F.lit(0).alias("video_id"), F.col("path").alias("name"), "text")
    subtitles.write_files(files, str(tmp_path))
    assert contents(str(tmp_path)) == {"a.zh.2.mkv": "one", "b.zh.mkv": "two"}


def test_names_in_parts_of_bounded_size(spark, monkeypatch):
    """More names make more parts, not larger ones; the first free number, whatever is taken twice or beyond a gap."""
    monkeypatch.setattr(media, "PART", 10)
    taken = {f"f{k}": [1, 1, *range(2, k % 5 + 2), 9] for k in range(40) if k % 3}
    paths = [(f"{stem}.zh.mkv" if n == 1 else f"{stem}.zh.{n}.mkv",) for stem, ns in taken.items() for n in ns]
    names = spark.createDataFrame([(f"f{k}", "zh") for k in (*range(40), 1)], "stem string, suffix string")
    got = media.output_name(names, spark.createDataFrame(paths, "path string"))
    free = {f"f{k}": next(n for n in range(1, 99) if n not in taken.get(f"f{k}", ())) for k in range(40)}
    assert sorted(r["path"] for r in got.collect()) == sorted(f"{s}.zh.mkv" if n == 1 else f"{s}.zh.{n}.mkv" for s, n in free.items())
    assert got.rdd.getNumPartitions() > 10


# --- merge

PACKET = "video_id long, seq long, pts long, dts long, tick double, size long, start_time double"


def by_hand(packets, cues):
    """Each cue before the first packet, in order of decoding, that is shown at or after it."""
    out, left = [], sorted(cues, key=lambda c: (c[1], c[0]))
    for seq, at in packets:
        while left and left[0][1] <= at:
            out.append(("cue", left.pop(0)[0]))
        out.append(("packet", seq))
    return out + [("cue", c[0]) for c in left]


def test_merge_by_hand(spark):
    rnd = random.Random(9)
    packets, cues, want = [], [], {}
    for v in range(1, 7):
        own = [(v, k, k * 40 + rnd.choice([0, 0, 80, -40]) if rnd.random() < 0.95 else None, k * 40 - 80, 0.001, rnd.choice([0, 9, 9]), 0.0) for k in range(1, rnd.choice([2, 400]))]
        mine = [(v, n, rnd.choice([-1.0, 0.0, rnd.randrange(16_000) / 1000, 40.0])) for n in range(rnd.choice([0, 30]))]
        packets, cues = packets + own, cues + mine
        zero = min(0.0, own[0][3] / 1000)
        shown = [(k, 0.0 if pts is None else (pts - round(zero / 0.001)) * 0.001) for _, k, pts, _, _, size, _ in own if size]
        want[v] = by_hand(shown, [(n, s) for _, n, s in mine])
    got = mux.merge_streams(spark.createDataFrame(packets, PACKET), spark.createDataFrame(cues, "video_id long, cue_no long, start double")).collect()
    for v, rows in want.items():
        own = sorted((r for r in got if r["video_id"] == v), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and [(r["kind"], r["item"]) for r in own] == rows
        decoded = [r["dts"] for r in own if r["kind"] == "packet"]
        assert decoded == sorted(decoded) and (not decoded or decoded[0] >= 0)


def test_merge_of_one_kind(spark):
    none = spark.createDataFrame([], PACKET)
    cues = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (2, 1, 0.0)], "video_id long, cue_no long, start double")
    assert sorted((r["video_id"], r["place"], r["item"]) for r in mux.merge_streams(none, cues).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert mux.merge_streams(none, cues.limit(0)).count() == 0


# --- containers


def ebml(name, content):
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (len(content) | 1 << 56).to_bytes(8, "big") + content


def matroska(tracks, late=False, padding=200_000):
    entries = b""
    for kind, language, title, codec, default, audio in tracks:
        body = ebml(containers.TYPE, bytes([kind])) + ebml(containers.CODEC, codec.encode())
        body += ebml(containers.LANGUAGE, language.encode()) if language else b""
        body += ebml(containers.NAME, title.encode()) if title else b""
        body += ebml(containers.DEFAULT, bytes([default])) if default is not None else b""
        if audio:
            body += ebml(containers.AUDIO, ebml(containers.CHANNELS, bytes([audio[0]])) + ebml(containers.RATE, struct.pack(">d", audio[1])))
        entries += ebml(containers.ENTRY, body)
    listed, void, cluster = ebml(containers.TRACKS, entries), ebml(0xEC, b"\0" * padding), ebml(containers.CLUSTER, b"\1" * padding)
    seek = lambda at: ebml(containers.SEEK_HEAD, ebml(containers.SEEK, ebml(containers.SEEK_ID, containers.TRACKS.to_bytes(4, "big")) + ebml(containers.SEEK_AT, at.to_bytes(8, "big"))))
    body = seek(len(seek(0)) + len(void) + len(cluster)) + void + cluster + listed if late else void + listed + cluster
    return ebml(containers.EBML, b"\x42\x86\x81\x01") + ebml(containers.SEGMENT, body)


def box(name, *parts):
    content = b"".join(parts)
    return struct.pack(">I4s", len(content) + 8, name) + content


def mp4(tracks, padding=200_000):
    made = []
    for kind, language, codec, enabled, channels, rate in tracks:
        packed = sum((ord(c) - 0x60) << s for c, s in zip(language, (10, 5, 0)))
        entry = struct.pack(">I4s6xH8xHHIHH", 36, codec, 1, channels, 16, 0, rate, 0)
        media_box = box(b"mdia", box(b"mdhd", b"\0" * 20, struct.pack(">HH", packed, 0)), box(b"hdlr", b"\0" * 8, kind, b"\0" * 12, b"Handler\0"), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stsz", b"\0" * padding))))
        made.append(box(b"trak", box(b"tkhd", bytes([0, 0, 0, enabled]), b"\0" * 80), media_box))
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"\2" * padding) + box(b"moov", box(b"mvhd", b"\0" * 100), *made)


MKV = [(1, "", "", "V_MPEG4/ISO/AVC", None, None), (2, "jpn", "日本語", "A_AAC", 1, (2, 48000.0)), (2, "", "", "A_AC3", 0, (6, 44100.0)), (17, "chi", "", "S_TEXT/UTF8", 0, None)]
MP4 = [(b"vide", "und", b"avc1", 1, 0, 0), (b"soun", "ger", b"mp4a", 1, 2, 44100), (b"soun", "eng", b"ac-3", 0, 6, 48000)]


def test_tracks_of_containers(spark, tmp_path):
    files = {"a.mkv": matroska(MKV), "late.mkv": matroska(MKV, late=True), "b.mp4": mp4(MP4), "cut.mkv": matroska(MKV)[:120], "cut.mp4": mp4(MP4)[:200_300], "x.avi": b"RIFF____AVI ", "none": b"", "noise.mkv": matroska(MKV)[:40] + b"\0" * 500}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = containers.list_tracks(spark, str(tmp_path)).collect()
    by = {n: [tuple(r)[1:9] for r in got if r["path"].endswith(f"/{n}") and r["error"] is None] for n in files}
    mkv = [(1, "audio", "jpn", "日本語", "aac", 2, 48000, True), (2, "audio", "eng", "", "ac3", 6, 44100, False)]
    assert by["a.mkv"] == by["late.mkv"] == mkv
    assert by["b.mp4"] == [(1, "audio", "ger", "Handler", "aac", 2, 44100, True), (2, "audio", "eng", "Handler", "ac3", 6, 48000, False)]
    assert {r["path"].rsplit("/", 1)[1] for r in got if r["error"]} == {"cut.mkv", "cut.mp4", "x.avi", "none", "noise.mkv"}
    assert {r["kind"] for r in containers.list_tracks(spark, str(tmp_path), None).collect()} == {"video", "audio", "subtitle", None}
    tracks = containers.list_tracks(spark, str(tmp_path / "a.mkv")).withColumn("video_id", F.lit(1))
    wanted = spark.createDataFrame([(1, None, "en")], "video_id int, want_index int, want_language string")
    assert media.pick_track(tracks, wanted).first()["index"] == 2


def test_only_headers_are_read(tmp_path):
    for raw in (matroska(MKV), matroska(MKV, late=True), mp4(MP4)):
        (tmp_path / "f").write_bytes(raw)
        with open(tmp_path / "f", "rb") as f:
            reader = containers.Reader(f, len(raw))
            assert len(containers.tracks_of(reader)) in (3, 4)
        assert reader.read_bytes < 3_000 < len(raw) / 100


def test_damaged_headers_never_crash(tmp_path):
    rnd = random.Random(1)
    for raw in (matroska(MKV, padding=50), mp4(MP4, padding=50)):
        for _ in range(1_500):
            bad = bytearray(raw)
            for _ in range(rnd.randrange(1, 4)):
                bad[rnd.randrange(len(bad))] = rnd.randrange(256)
            bad = bytes(bad[: rnd.randrange(len(bad))]) if rnd.random() < 0.3 else bytes(bad)
            (tmp_path / "f").write_bytes(bad)
            with open(tmp_path / "f", "rb") as f:
                try:
                    containers.tracks_of(containers.Reader(f, len(bad)))
                except containers.Broken:
                    pass


# --- runs


def test_slot_and_cancellation(spark, tmp_path):
    """The second run waits for the first; a cancelled one stops within its stage, leaves no table, and frees the slot."""
    slot, began = runs.Runs(spark), []

    def long_run():
        began.append("long")
        slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
        runs.write_whole(spark.range(0, 4000, 1, 8).select(slow("id").alias("x")), str(tmp_path / "long"))

    def short_run():
        began.append("short")
        runs.write_whole(spark.range(5), str(tmp_path / "short"))
        return spark.read.json(str(tmp_path / "short")).count()

    a, b, c = slot.start("a", long_run), slot.start("b", short_run), slot.start("c", short_run)
    with pytest.raises(ValueError):
        slot.start("b", short_run)
    slot.cancel("c")
    with pytest.raises(runs.Cancelled):
        c.result(10)
    while not began:
        time.sleep(0.05)
    time.sleep(2)
    assert began == ["long"] and slot.stages == {"a": "running", "b": "pending", "c": "cancelled"}
    at = time.time()
    slot.cancel("a")
    with pytest.raises(runs.Cancelled):
        a.result(10)
    assert time.time() - at < 20
    assert b.result(60) == 5 and slot.stages == {"a": "cancelled", "b": "done", "c": "cancelled"}
    assert sorted(os.listdir(tmp_path)) == ["short"]
    failed = slot.start("d", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(30)
    assert slot.stages["d"] == "failed" and spark.range(3).count() == 3
    slot.cancel("a")


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    to = str(tmp_path / "t")
    runs.write_whole(spark.range(3), to)
    with pytest.raises(Exception):  # noqa: B017
        runs.write_whole(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id")), to)
    assert spark.read.json(to).count() == 3
    runs.write_whole(spark.range(9), to)
    assert spark.read.json(to).count() == 9 and os.listdir(tmp_path) == ["t"]
