"""The LVX data source against files that the tests write, read whole, in parts, cut off and filtered."""

import random
import struct

import pytest

from pointframe.functions.packets import decode_packets
from pointframe.sources import lvx


def _packet(rng, device, kind, stamp, version, protocol=5):
    n = lvx.payload_size(kind, version)
    payload = bytes(rng.randrange(256) for _ in range(n))
    return lvx.PACKET.pack(device, protocol, 1, 0, 0, 0, 0, kind, struct.pack("<q", stamp)) + payload, payload


def _write(path, version, frames, seed=0, spoil=None):
    """A file of two devices; what its packets are: (frame, packet, device, kind, timestamp, payload)."""
    rng, rows = random.Random(seed), []
    out = bytearray(lvx.HEADER.pack(lvx.SIGNATURE, 1, version, 0, 0, lvx.MAGIC) + (struct.pack("<IB", 50, 2) if version else bytes([2])) + bytes(2 * lvx.DEVICE_SIZE[version]))
    for number in range(frames):
        body = b""
        for k in range(rng.randrange(0, 6)):
            device, kind, stamp = rng.randrange(2), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]), 1000 * number + k
            raw, payload = _packet(rng, device, kind, stamp, version, 4 if spoil == (number, k) else 5)
            body += raw
            rows.append((number, k, device, kind, stamp, payload))
        head = (len(out), len(out) + lvx.FRAME[version].size + len(body), number)
        out += lvx.FRAME[version].pack(*head, *([0] if not version else [])) + body
    path.write_bytes(bytes(out))
    return rows


def _read(spark, path, part_bytes):
    return lvx.read_lvx(spark, str(path), part_bytes)


def _plain(df):
    return sorted((r.frame, r.packet, r.device, r.kind, r.timestamp, bytes(r.payload)) for r in df.collect())


@pytest.mark.parametrize("version", [0, 1])
def test_packets_in_parts(spark, tmp_path, version):
    rows = _write(tmp_path / "a.lvx", version, 30, version)
    size = (tmp_path / "a.lvx").stat().st_size
    for part in (size + 1, 5_000, 777):  # parts within frames, too
        df = _read(spark, tmp_path / "a.lvx", part)
        assert _plain(df) == sorted(rows)
    assert len(lvx.Reader(str(tmp_path / "a.lvx"), 5_000).partitions()) == -(-size // 5_000)


def test_folders_filters_and_decoding(spark, tmp_path):
    rows = _write(tmp_path / "a.lvx", 1, 10, 1) + _write(tmp_path / "b.lvx", 1, 10, 2)
    df = _read(spark, tmp_path, 4_000)
    assert _plain(df) == sorted(rows) and {r.path[-5:] for r in df.select("path").distinct().collect()} == {"a.lvx", "b.lvx"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = _plain(_read(spark, tmp_path, 4_000).filter("kind IN (0, 2) AND timestamp >= 3000 AND device = 1"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert got == sorted(r for r in rows if r[3] in (0, 2) and r[4] >= 3000 and r[2] == 1) and got
    points = decode_packets(df.filter("kind = 0").selectExpr("frame * 1000 + packet AS packet_id", "kind", "payload"))
    assert points.count() == 100 * sum(r[3] == 0 for r in rows)


def test_cut_spoilt_and_foreign_files(spark, tmp_path):
    rows = _write(tmp_path / "a.lvx", 1, 12, 3)
    raw = (tmp_path / "a.lvx").read_bytes()
    (tmp_path / "cut.lvx").write_bytes(raw[: len(raw) - 100])  # in the last packet
    last = [r for r in rows if r[0] == max(x[0] for x in rows)]
    whole = sorted(r for r in rows if r is not last[-1]) if raw.endswith(last[-1][5]) else None
    got = _plain(_read(spark, tmp_path / "cut.lvx", 3_000))
    assert got == whole or whole is None and set(got) <= set(rows)
    spoilt = _write(tmp_path / "bad.lvx", 1, 12, 3, spoil=(rows[0][0], 0))  # a protocol that isn't known: the rest of its frame is passed over
    assert _plain(_read(spark, tmp_path / "bad.lvx", 3_000)) == sorted(r for r in spoilt if r[0] != rows[0][0])
    (tmp_path / "none.lvx").write_bytes(b"something else altogether, not a recording at all")
    with pytest.raises(Exception, match="LVX"):
        _read(spark, tmp_path / "none.lvx", 3_000).count()
    with pytest.raises(Exception, match="FileNotFound"):
        _read(spark, tmp_path / "missing.lvx", 3_000).count()
