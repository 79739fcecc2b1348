"""Decoding of raw sensor packets: eight encodings of points, Cartesian or spherical, with one to three echoes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Data type -> (points a packet, echoes, numpy layout of a point); type 6 carries inertial samples, not points.
LAYOUTS = {
    0: (100, 1, [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("r", "u1")]),
    1: (100, 1, [("depth", "<u4"), ("theta", "<u2"), ("phi", "<u2"), ("r", "u1")]),
    2: (96, 1, [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("r", "u1"), ("tag", "u1")]),
    3: (96, 1, [("depth", "<u4"), ("theta", "<u2"), ("phi", "<u2"), ("r", "u1"), ("tag", "u1")]),
    4: (48, 2, [(f"{c}{e}", t) for e in range(2) for c, t in (("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("r", "u1"), ("tag", "u1"))]),
    5: (48, 2, [("theta", "<u2"), ("phi", "<u2")] + [(f"{c}{e}", t) for e in range(2) for c, t in (("depth", "<u4"), ("r", "u1"), ("tag", "u1"))]),
    7: (30, 3, [(f"{c}{e}", t) for e in range(3) for c, t in (("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("r", "u1"), ("tag", "u1"))]),
    8: (30, 3, [("theta", "<u2"), ("phi", "<u2")] + [(f"{c}{e}", t) for e in range(3) for c, t in (("depth", "<u4"), ("r", "u1"), ("tag", "u1"))]),
}
SCHEMA = "packet_id long, pt_idx int, echo int, x double, y double, z double, reflectivity int, tag int, line int"


def decode_packet(kind: int, payload: bytes, lines: int = 1) -> pd.DataFrame:
    """The points of one packet in metres; unknown kinds and bytes that fill no point give none. line is the index modulo lines."""
    cols = ["pt_idx", "echo", "x", "y", "z", "reflectivity", "tag", "line"]
    if kind not in LAYOUTS:
        return pd.DataFrame(columns=cols)
    most, echoes, layout = LAYOUTS[kind]
    dtype = np.dtype(layout)
    n = min(most, len(payload) // dtype.itemsize)
    a = np.frombuffer(payload, dtype=dtype, count=n)
    parts = []
    for e in range(echoes):
        s = str(e) if echoes > 1 else ""
        if "theta" in dtype.names:
            depth = a["depth" + s] / 1000.0
            theta, phi = np.radians(a["theta"] / 100.0), np.radians(a["phi"] / 100.0)
            xyz = depth * np.sin(theta) * np.cos(phi), depth * np.sin(theta) * np.sin(phi), depth * np.cos(theta)
        else:
            xyz = tuple(a[c + s] / 1000.0 for c in "xyz")
        tag = a["tag" + s] if "tag" + s in dtype.names else np.zeros(n, np.uint8)
        parts.append(pd.DataFrame({"pt_idx": np.arange(n), "echo": e, "x": xyz[0], "y": xyz[1], "z": xyz[2], "reflectivity": a["r" + s].astype(int), "tag": tag.astype(int), "line": np.arange(n) % lines}))
    return pd.concat(parts, ignore_index=True).sort_values(["pt_idx", "echo"], kind="stable")[cols] if n else pd.DataFrame(columns=cols)


def decode_packets(df: DataFrame, lines: int = 1) -> DataFrame:
    """Packets (packet_id, kind, payload) as one row for each echo of each point."""

    def run(batches):
        for pdf in batches:
            out = [decode_packet(int(k), bytes(p), lines).assign(packet_id=i) for i, k, p in zip(pdf["packet_id"], pdf["kind"], pdf["payload"], strict=True)]
            out = [o for o in out if len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)[["packet_id", "pt_idx", "echo", "x", "y", "z", "reflectivity", "tag", "line"]]

    return df.select("packet_id", "kind", "payload").mapInPandas(run, SCHEMA)
