import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.__main__ import main
from gneiss.functions import codecs, kernels, strictjson
from gneiss.plans import archive, constraints, report
from gneiss.sources import layout
from gneiss.sources.names import collect_sources, local_component, safe_name, validate_names


def wav(x: np.ndarray, width: int, rate: int = 48000, extra: bytes = b"") -> bytes:
    frames, channels = x.shape
    body = x.astype("<i4").view(np.uint8).reshape(frames, channels, 4)[:, :, :width].tobytes()
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    chunks = b"fmt " + struct.pack("<I", 16) + form + extra + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def dsf(channels: list[bytes], lsb: bool = True) -> bytes:
    n = len(channels[0])
    blocks = -(-n // 4096)
    padded = [np.frombuffer(c.ljust(blocks * 4096, b"\0"), np.uint8) for c in channels]
    body = b"".join((layout.REVERSED[p[4096 * i : 4096 * i + 4096]] if lsb else p[4096 * i : 4096 * i + 4096]).tobytes() for i in range(blocks) for p in padded)
    form = b"fmt " + struct.pack("<QIIIIIIQII", 52, 1, 0, 2, len(channels), 2822400, 1 if lsb else 8, n * 8, 4096, 0)
    rest = form + b"data" + struct.pack("<Q", 12 + len(body)) + body
    return b"DSD " + struct.pack("<QQQ", 28, 28 + len(rest), 0) + rest


def dff(channels: list[bytes]) -> bytes:
    chunk = lambda name, data: name + struct.pack(">Q", len(data)) + data + b"\0" * (len(data) % 2)
    prop = chunk(b"PROP", b"SND " + chunk(b"FS  ", struct.pack(">I", 2822400)) + chunk(b"CHNL", struct.pack(">H", len(channels)) + b"SLFTSRGT") + chunk(b"CMPR", b"DSD \x00"))
    body = np.stack([np.frombuffer(c, np.uint8) for c in channels], axis=1).tobytes()
    rest = b"DSD " + chunk(b"FVER", b"\x01\x05\0\0") + prop + chunk(b"DSD ", body)
    return b"FRM8" + struct.pack(">Q", len(rest)) + rest


@pytest.mark.parametrize("width", [2, 3, 4])
@pytest.mark.parametrize("n", [1, 2, 9, 127, 4097])
def test_pcm_round_trip(width, n):
    rng = np.random.default_rng(width * n)
    for scale in (1, 256):
        data = (rng.integers(-100, 100, n) * scale).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        payload, meta = kernels.canonical_pcm(data, width)
        assert kernels.restore_pcm(payload, meta, width) == data
    with pytest.raises(ValueError):
        kernels.restore_pcm(payload[:-4], meta, width)


def test_pcm_payload_is_shared_by_scaled_copies():
    x = np.random.default_rng(1).integers(-(1 << 20), 1 << 20, 5000)
    one = lambda y, w: kernels.canonical_pcm(y.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :w].tobytes(), w)[0]
    assert one(x, 3) == one(x * 256, 4) == one(-x, 3) == one(x + 77, 4)
    assert one(x, 3) != one(x + np.arange(5000) % 2, 3)


def test_dsd_round_trip_and_complement():
    data = random.Random(2).randbytes(9000)
    payload, meta = kernels.canonical_dsd(data)
    assert kernels.restore_dsd(payload, meta) == data
    assert kernels.canonical_dsd(bytes(b ^ 255 for b in data))[0] == payload
    with pytest.raises(ValueError):
        kernels.restore_dsd(b"\1" + payload[1:], meta)


@pytest.mark.parametrize("kind", ["raw", "dsd"])
def test_content_cuts_equal_a_rolling_hash(kind):
    data, average = random.Random(3).randbytes(300_000) + bytes(200_000), 1 << 14
    ends, fp, at, last = [], 0, 0, 0
    for i, b in enumerate(data):
        fp = ((fp << 1) + int(kernels.GEAR[b ^ last if kind == "dsd" else b])) % (1 << 64)
        last = b
        if i + 1 - at >= 8192 and (fp % average == 0 or i + 1 - at >= 4 * average):
            ends.append(i + 1)
            at, fp = i + 1, 0
    assert kernels.content_cuts(data, kind, average) == ends + [len(data)] * (at < len(data))


def test_codecs_are_strict():
    for data in (b"", b"x", bytes(1000), random.Random(4).randbytes(5000), b"ab" * 9000):
        codec, encoded = codecs.encode(data)
        assert codecs.decode(encoded, codec, len(data)) == data
        if codec != "raw":
            for bad in (encoded[:-1], encoded + b"x", encoded * 2):
                with pytest.raises(codecs.CodecError):
                    codecs.decode(bad, codec, len(data))
        with pytest.raises(codecs.CodecError):
            codecs.decode(encoded, codec, len(data) + 1)


def test_layouts():
    rng = np.random.default_rng(5)
    x = rng.integers(-30000, 30000, (700, 2))
    for width in (2, 3, 4):
        data = wav(x, width, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
        info = layout.probe(data)
        assert info["container"] == "wav" and info["frames"] == 700
        out = np.zeros(len(data), np.uint8)
        for a, n in layout.raw_spans(info, len(data)):
            out[a : a + n] = np.frombuffer(data, np.uint8)[a : a + n]
        for c in range(2):
            layout.write_channel(out, info, c, layout.read_channel(data, info, c))
        assert out.tobytes() == data
        assert all(layout.probe(data[:k]) is None for k in (0, 3, 20, 60, len(data) - 2))
    channels = [rng.bytes(10_000), rng.bytes(10_000)]
    for data in (dsf(channels), dsf(channels, lsb=False), dff(channels)):
        info = layout.probe(data)
        assert [layout.read_channel(data, info, c) for c in range(2)] == channels


def test_names(tmp_path):
    for bad in ("", "a/../b", "con.txt", "a\\b", "x/" * 17 + "y", "a.", "a?", "\x01"):
        with pytest.raises(ValueError):
            safe_name(bad)
    for bad in (["a", "A"], ["a", "a/b"]):
        with pytest.raises(ValueError):
            validate_names(bad)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_bytes(b"1")
    assert [n for n, _ in collect_sources([str(tmp_path / "d")])] == ["d/f"]
    (tmp_path / "d" / "l").symlink_to(tmp_path / "d" / "f")
    with pytest.raises(ValueError):
        collect_sources([str(tmp_path / "d")])


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("packed")
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 22), 1 << 22, (20_000, 2))
    stream = [rng.bytes(60_000), rng.bytes(60_000)]
    files = {"a.wav": wav(x, 3), "b.wav": wav(x * 256, 4), "c.dsf": dsf(stream), "d.dff": dff(stream), "e.bin": bytes(rng.bytes(30_000)) * 2, "empty": b""}
    (top / "in").mkdir()
    for name, data in files.items():
        (top / "in" / name).write_bytes(data)
    report = archive.pack(spark, [str(top / "in")], str(top / "out"), average=1 << 14)
    return top, files, report


def test_pack_and_unpack(spark, packed):
    top, files, report = packed
    assert report["status"] == "created" and report["verified"] and report["net_saving_bytes"] > 0
    assert set(report["candidate_bytes"]) == set(archive.POLICIES)
    archive.unpack(spark, str(top / "out"), str(top / "back"))
    assert {p.name: p.read_bytes() for p in (top / "back" / "in").iterdir()} == files
    with pytest.raises(archive.ArchiveError):
        archive.unpack(spark, str(top / "out"), str(top / "back"))


def test_broken_tables_are_found(spark, packed):
    tables = archive.open_archive(spark, str(packed[0] / "out"))
    info = lambda field, value: F.col("info").withField(field, F.lit(value))
    sampled = F.col("info").isNotNull()
    breaks = {
        "C1 meta": [("meta", lambda d: d.where("key <> 'complete'").union(spark.createDataFrame([("complete", "no")], d.schema)))],
        "C4 file fields": [("files", lambda d: d.withColumn("path", F.repeat(F.lit("x"), F.lit(221))))],
        "C6 file sizes, digests and layouts": [("files", lambda d: d.withColumn("sha256", F.lit("x"))), ("files", lambda d: d.withColumn("info", F.when(sampled, info("rate", 1 << 32)))), ("files", lambda d: d.withColumn("info", F.when(sampled, info("valid_bits", 33))))],
        "C7 one recipe a file": [("recipes", lambda d: d.union(d)), ("recipes", lambda d: d.limit(1))],
        "C8 streams": [("streams", lambda d: d.withColumn("offset", F.when(F.col("role") == "raw", F.col("offset") + 1).otherwise(F.col("offset")))), ("streams", lambda d: d.withColumn("channel", F.when(F.col("channel") == 1, 0).otherwise(F.col("channel")))), ("recipes", lambda d: d.withColumn("kind", F.lit("semantic")))],
        "C9 ordinals": [("pieces", lambda d: d.withColumn("ordinal", F.col("ordinal") + 1))],
        "C10 sizes": [("pieces", lambda d: d.withColumn("size", F.col("size") + 1))],
        "C11 transforms": [("pieces", lambda d: d.withColumn("params", F.lit("[]"))), ("pieces", lambda d: d.withColumn("params", F.when(F.col("transform") == "dsd", F.lit('{"anchor":1,"anchor":2}')).otherwise(F.col("params")))), ("pieces", lambda d: d.withColumn("transform", F.lit("dsd")))],
        "C12 objects there": [("pieces", lambda d: d.withColumn("object_id", F.col("object_id") + 10**6))],
        "C13 no orphans": [("pieces", lambda d: d.where("object_id > 1")), ("streams", lambda d: d.limit(2))],
        "C14 object fields": [("objects", lambda d: d.withColumn("codec", F.lit("other"))), ("objects", lambda d: d.withColumn("width", F.lit(3)))],
    }
    assert set(breaks) == set(constraints.broken(tables)) and all(rows.isEmpty() for rows in constraints.broken(tables).values())
    for rule, changes in breaks.items():
        for name, change in changes:
            assert not constraints.broken(tables | {name: change(tables[name])})[rule].isEmpty(), rule
    settings = lambda text: {"meta": tables["meta"].withColumn("value", F.when(F.col("key") == "settings", F.lit(text)).otherwise(F.col("value")))}
    for change in (settings('{"average":16384,"average":16384,"strategy":"raw"}'), settings('{"average":5,"strategy":"raw"}'), {"files": tables["files"].withColumn("path", F.lit("same"))}):
        with pytest.raises(archive.ArchiveError, match="C2|C5"):
            constraints.check(tables | change)


def test_limits(spark, packed, monkeypatch):
    tables = archive.open_archive(spark, str(packed[0] / "out"))
    for name, most, rule in (("MOST_METADATA", 100, "C4"), ("MOST_STREAMS", 1, "C3"), ("MOST_OBJECTS", 1, "C3"), ("MOST_BYTES", 9, "C3")):
        with monkeypatch.context() as m:
            m.setattr(constraints, name, most)
            with pytest.raises(archive.ArchiveError, match=rule):
                constraints.check(tables)


def test_publish_never_replaces(tmp_path, monkeypatch):
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "x").write_bytes(b"1")
    (tmp_path / "there").mkdir()
    with pytest.raises(archive.ArchiveError):
        archive.publish(tmp_path / "new", str(tmp_path / "there"))
    assert not list((tmp_path / "there").iterdir())

    def fails(*_):
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(archive.os, "rename", fails)
        with pytest.raises(OSError):
            archive.publish(tmp_path / "new", str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and (tmp_path / "new" / "x").exists()
    archive.publish(tmp_path / "new", str(tmp_path / "out"))
    assert (tmp_path / "out" / "x").read_bytes() == b"1"


def test_a_failed_unpack_leaves_nothing(spark, packed, tmp_path, monkeypatch):
    def fails(*_):
        raise archive.ArchiveError("no")

    monkeypatch.setattr(archive, "publish", fails)
    with pytest.raises(archive.ArchiveError):
        archive.unpack(spark, str(packed[0] / "out"), str(tmp_path / "back"))
    assert not list(tmp_path.iterdir())


def test_layouts_with_more_around():
    rng = np.random.default_rng(8)
    x, channels = rng.integers(-30000, 30000, (500, 2)), [rng.bytes(9000), rng.bytes(9000)]
    body = wav(x, 2)
    extended = body[:16] + struct.pack("<I", 20) + body[20:36] + struct.pack("<H", 2) + b"zz" + body[36:]
    extended = b"RIFF" + struct.pack("<I", len(extended) - 8) + extended[8:]
    guid = struct.pack("<HHI", 22, 12, 3) + layout.PCM_GUID
    wide = body[:16] + struct.pack("<I", 40) + b"\xfe\xff" + body[22:36] + guid + body[36:]
    wide = b"RIFF" + struct.pack("<I", len(wide) - 8) + wide[8:]
    data = body[44:]
    table = struct.pack("<QQQI", 0, len(data), 500, 1) + b"LIST" + struct.pack("<Q", 4)
    large = b"WAVE" + b"ds64" + struct.pack("<I", len(table)) + table + b"LIST" + struct.pack("<I", 0xFFFFFFFF) + b"abcd" + body[12:40] + struct.pack("<I", 0xFFFFFFFF) + data
    large = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + large[:12] + struct.pack("<Q", len(large)) + large[20:]
    one, two = dsf(channels), dff(channels)
    extra = b"junk" + struct.pack("<Q", 20) + b"abcdefgh"
    with_extra = one[:28] + extra + one[28:80] + extra + one[80:]
    tagged = with_extra + b"ID3tag"
    tagged = tagged[:12] + struct.pack("<QQ", len(tagged), len(with_extra)) + tagged[28:]
    for good in (body + b"tail bytes", extended, wide, large, large + b"x", two + b"trailing", tagged):
        info = layout.probe(good)
        assert info and layout.valid(info, len(good)), good[:4]
        out = np.zeros(len(good), np.uint8)
        for a, n in layout.raw_spans(info, len(good)):
            out[a : a + n] = np.frombuffer(good, np.uint8)[a : a + n]
        for c in range(2):
            at = 0
            for part in layout.iter_channel(good, info, c, 4097):
                layout.write_channel(out, info, c, part, at)
                at += len(part)
            assert at == layout.channel_size(info)
        assert out.tobytes() == good
    prop = two.index(b"PROP")
    bad = [extended[:36] + struct.pack("<H", 3) + extended[38:], large.replace(struct.pack("<Q", 500), struct.pack("<Q", 499), 1), large[:4] + struct.pack("<I", 5) + large[8:], body[:4] + struct.pack("<I", len(body)) + body[8:], one[:28] + one[80:] + one[28:80], two[: len(two) - 9000], two[:16] + two[prop : prop + 8] + two[16:], two.replace(b"\x01\x05\0\0", b"\x02\x05\0\0")]
    assert [layout.probe(b) for b in bad] == [None] * len(bad)
    info = layout.probe(body)
    for n in (0, 1, layout.MOST_READ + 1):
        with pytest.raises(ValueError):
            next(layout.iter_channel(body, info, 0, n))
    with pytest.raises(ValueError):
        layout.write_channel(np.zeros(len(body), np.uint8), info, 0, b"123")


def test_strict_json():
    assert strictjson.dump({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    for bad in ('{"a":1,"a":1}', "[" * 9000, "x", None, '{"a":"' + "x" * 9000 + '"}'):
        with pytest.raises(ValueError):
            strictjson.load(bad)


def test_codec_rules():
    for kind, width in (("pcm", 1), ("pcm", 3), ("raw", 2), ("dsd", 4), ("other", 1), ("raw", True)):
        with pytest.raises(codecs.CodecError):
            codecs.encode(b"1234", kind, width)
    assert codecs.decode(codecs.encode(b"123456", "pcm", 3)[1], "raw", 6) == b"123456"
    for bad in (lambda: codecs.decode(b"12", "raw", 2, 2), lambda: codecs.require("flac"), lambda: codecs.decode(b"12", "raw", True)):
        with pytest.raises(codecs.CodecError):
            bad()
    payload, meta = kernels.canonical_pcm(b"12345678", 4)
    with pytest.raises(ValueError):
        kernels.restore_pcm(payload, meta | {"shift": 32}, 4)


def test_local_component():
    assert local_component("a.b", "part") == "a.b"
    for bad in ("a/b", "..", "con", "", 3):
        with pytest.raises(ValueError, match="part"):
            local_component(bad, "part")


def test_command_line(spark, packed, tmp_path, capsys):
    top, files, _ = packed
    (tmp_path / "work").mkdir()
    assert main(["pack", str(top / "in"), "-o", str(tmp_path / "arc"), "--average", "16384", "--mode", "raw", "--codecs", "stdlib", "--work-dir", str(tmp_path / "work"), "--allow-growth"]) == 0
    assert json.loads(capsys.readouterr().out)["strategy"] == "raw" and not list((tmp_path / "work").iterdir())
    assert main(["inspect", str(tmp_path / "arc")]) == 0 and json.loads(capsys.readouterr().out)["content_verified"] is False
    assert main(["verify", str(tmp_path / "arc")]) == 0 and json.loads(capsys.readouterr().out)["verified"]
    assert main(["unpack", str(tmp_path / "arc"), "-o", str(tmp_path / "back")]) == 0
    assert (tmp_path / "back" / "in" / "a.wav").read_bytes() == files["a.wav"]
    assert main(["verify", str(tmp_path / "none")]) == 2 and "error" in capsys.readouterr().err


def test_report(spark, packed, tmp_path):
    group = report.measure(spark, "all", [str(packed[0] / "in")], str(tmp_path))
    assert group["kept"] and 0 < group["zip_bytes"] and group["archive_bytes"] < group["original_bytes"]
    assert make_lines(report.make_report([group])) == 3


def make_lines(text):
    return len(text.splitlines())


def test_nothing_saved_is_skipped(spark, tmp_path):
    (tmp_path / "f").write_bytes(random.Random(7).randbytes(2000))
    assert archive.pack(spark, [str(tmp_path / "f")], str(tmp_path / "o"), average=1 << 14)["status"] == "skipped_no_net_savings"
    assert not (tmp_path / "o").exists()
