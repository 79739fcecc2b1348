"""SQL text for geometry, written apart from the column functions."""


def rotate(m: list[float], v: tuple[str, str, str], t: tuple[float, float, float] = (0, 0, 0)) -> list[str]:
    return [f"({m[3 * i]!r} * {v[0]} + {m[3 * i + 1]!r} * {v[1]} + {m[3 * i + 2]!r} * {v[2]} + {float(t[i])!r})" for i in range(3)]


def voxel(v: str, size: float) -> str:
    q = f"({v} / {float(size)!r})"
    return f"CAST(trunc(CASE WHEN {q} < 0 THEN {q} - 1 ELSE {q} END) AS BIGINT)"


def leaf(v: str, size: float) -> str:
    return f"CAST(floor({v} / {float(size)!r}) AS BIGINT)"
