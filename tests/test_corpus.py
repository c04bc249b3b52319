import json

import numpy as np
import pytest

from gneiss.__main__ import main
from gneiss.plans import archive, corpus, report
from gneiss.sources import layout

OPAQUE = {"opaque_float", "opaque_dst", "malformed"}


@pytest.fixture(scope="module")
def small():
    return corpus.groups(frames=4096, stream=40_000)


def test_groups_are_settled_by_the_seed(small):
    assert len(small) == 17 and sum(map(len, small.values())) == 32
    assert corpus.groups(frames=4096, stream=40_000) == small
    assert corpus.groups(1, frames=4096, stream=40_000)["dsd_noise"] != small["dsd_noise"]


def test_layouts_of_groups(small):
    for name, files in small.items():
        for file, data in files.items():
            info = layout.probe(data)
            assert (info is None) == (name in OPAQUE), (name, file)
            if info:
                out = np.zeros(len(data), np.uint8)
                for a, n in layout.raw_spans(info, len(data)):
                    out[a : a + n] = np.frombuffer(data, np.uint8)[a : a + n]
                for c in range(info["channels"]):
                    layout.write_channel(out, info, c, layout.read_channel(data, info, c))
                assert out.tobytes() == data, (name, file)


def test_versions_hold_the_same_channels(small):
    def channels(data):
        info = layout.probe(data)
        return [bytes(layout.read_channel(data, info, c)) for c in range(info["channels"])]

    lsb, msb, dff = (channels(d) for d in small["dsd64_container_versions"].values())
    assert lsb == msb == dff
    one, other = (channels(d) for d in small["dsd64_complement_versions"].values())
    assert [corpus.inverted(c) for c in other[::-1]] == one
    one, other = (channels(d) for d in small["dsd_byte_edit"].values() if d[:4] == b"FRM8")
    assert [c[17:] for c in other] == one
    one, other = (channels(d) for d in small["dsd_bit_shift"].values())
    for x, y in zip(one, other, strict=True):
        x, y = (np.unpackbits(np.frombuffer(c, np.uint8)) for c in (x, y))
        assert (x[:-1] == y[1:]).all()
    lsb, msb = (channels(d) for d in small["dsd_tail_padding"].values())
    assert [len(c) for c in lsb] == [5, 5] and layout.probe(small["dsd_tail_padding"]["lsb.dsf"])["frames"] == 35


def test_modulation_follows_the_signal():
    signal = 0.7 * np.sin(np.arange(80_000) / 900)
    bits = np.unpackbits(np.frombuffer(corpus.sigma_delta(signal), np.uint8)).astype(float) * 2 - 1
    assert np.abs(np.cumsum(bits - signal)).max() <= 2
    assert set(corpus.sigma_delta(np.zeros(64))) <= {0x55, 0xAA}


def test_measured_groups(spark, tmp_path, small):
    chosen = {n: small[n] for n in ("dsd64_container_versions", "dsd_noise", "malformed")}
    found = {g["group"]: g for g in corpus.measured(spark, str(tmp_path / "m"), chosen)}
    assert found["dsd64_container_versions"]["kept"]
    assert found["dsd64_container_versions"]["archive_bytes"] < found["dsd64_container_versions"]["zip_bytes"]
    for n, g in found.items():
        assert (tmp_path / "m" / "measured" / n / "archive").exists() == g["kept"]
    assert report.make_report(list(found.values())).count("\n") == 5


def test_sources_that_change_are_told(spark, tmp_path, small, monkeypatch):
    def changed(spark, name, sources, folder):
        (tmp_path / "m" / "sources" / name / "noise.dsf").write_bytes(b"x")
        return {"group": name, "kept": True}

    monkeypatch.setattr(corpus.report, "measure", changed)
    with pytest.raises(archive.ArchiveError, match="changed"):
        corpus.measured(spark, str(tmp_path / "m"), {"dsd_noise": small["dsd_noise"]})


def test_demo(spark, tmp_path, capsys):
    assert main(["demo", "-o", str(tmp_path / "d")]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["files"] == 5 and found["kept"] and 3 * found["archive_bytes"] < found["original_bytes"]
    assert main(["demo", "-o", str(tmp_path / "d")]) == 2
