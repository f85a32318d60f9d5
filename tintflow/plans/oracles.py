"""The plans in SQL, for checks: boxes as a recursive query, k-means and dithering as folds over lists."""

from __future__ import annotations

import numpy as np

from ..functions import FloatBinner, component_ranges
from ..functions.colorspace import LINEAR_TO_LMS, LMS_TO_OKLAB, SRGB_TO_XYZ, WHITE
from ..operators.fidelity import C1, C2, LUMA
from ..operators.histogram import SCALES
from ..operators.sampling import places_sql

SPACES = ("srgb", "lab", "oklab")


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


def _rows(m, names: tuple[str, str, str]) -> list[str]:
    return [" + ".join(f"CAST({float(v)!r} AS DOUBLE) * {n}" for v, n in zip(row, names, strict=True)) for row in m]


def converted(source: str, space: str) -> str:
    """All columns of a source with r, g, b, and c0, c1, c2 in the space."""
    if space == "srgb":
        return f"SELECT *, CAST(r AS DOUBLE) AS c0, CAST(g AS DOUBLE) AS c1, CAST(b AS DOUBLE) AS c2 FROM ({source})"
    linear = f"SELECT *, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM ({source})"
    light = ("lr", "lg", "lb")
    if space == "oklab":
        lms, lab = _rows(LINEAR_TO_LMS, light), _rows(LMS_TO_OKLAB, ("l_", "m_", "s_"))
        return f"SELECT * EXCLUDE (lr, lg, lb, l_, m_, s_), {', '.join(f'{e} AS c{i}' for i, e in enumerate(lab))} FROM (SELECT *, {', '.join(f'cbrt({e}) AS {n}' for e, n in zip(lms, ('l_', 'm_', 's_'), strict=True))} FROM ({linear}))"
    xyz = _rows(SRGB_TO_XYZ, light)
    f = [f"CASE WHEN {n} > pow(6.0 / 29, 3) THEN cbrt({n}) ELSE {n} * (pow(29.0 / 6, 2) / 3) + 4.0 / 29 END AS f{n}" for n in ("x_", "y_", "z_")]
    scaled = f"SELECT *, {', '.join(f'({e}) / {w!r} AS {n}' for e, w, n in zip(xyz, WHITE, ('x_', 'y_', 'z_'), strict=True))} FROM ({linear})"
    return f"SELECT * EXCLUDE (lr, lg, lb, x_, y_, z_, fx_, fy_, fz_), fy_ * 116 - 16 AS c0, (fx_ - fy_) * 500 AS c1, (fy_ - fz_) * 200 AS c2 FROM (SELECT *, {', '.join(f)} FROM ({scaled}))"


def to_srgb(source: str, space: str) -> str:
    """All columns but c0, c1, c2 of a source, and r, g, b of these."""
    if space == "srgb":
        return f"SELECT * EXCLUDE (c0, c1, c2), {', '.join(f'CAST(trunc(least(greatest(c{i}, 0), 255)) AS BIGINT) AS {n}' for i, n in enumerate('rgb'))} FROM ({source})"
    if space == "oklab":
        cubes = [f"pow({e}, 1) * ({e}) * ({e})" for e in _rows(np.linalg.inv(LMS_TO_OKLAB), ("c0", "c1", "c2"))]
        first = f"SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(cubes, ('x_', 'y_', 'z_'), strict=True))} FROM ({source})"
        linear = _rows(np.linalg.inv(LINEAR_TO_LMS), ("x_", "y_", "z_"))
    else:
        back = lambda t, w: f"(CASE WHEN {t} > 6.0 / 29 THEN ({t}) * ({t}) * ({t}) ELSE ({t} - 4.0 / 29) * (3 * pow(6.0 / 29, 2)) END) * {w!r}"
        y = "(c0 + 16) / 116"
        first = f"SELECT *, {back(f'(c1 / 500 + {y})', WHITE[0])} AS x_, {back(f'({y})', WHITE[1])} AS y_, {back(f'({y} - c2 / 200)', WHITE[2])} AS z_ FROM ({source})"
        linear = _rows(np.linalg.inv(SRGB_TO_XYZ), ("x_", "y_", "z_"))
    clamped = f"SELECT *, {', '.join(f'least(greatest({e}, 0.0), 1.0) AS {n}' for e, n in zip(linear, ('p_', 'q_', 's_'), strict=True))} FROM ({first})"
    curve = lambda t: f"CAST(floor((CASE WHEN {t} <= 0.0031308 THEN {t} * 12.92 ELSE pow({t}, 1 / 2.4) * 1.055 - 0.055 END) * 255 + 0.5) AS BIGINT)"
    return f"SELECT * EXCLUDE (c0, c1, c2, x_, y_, z_, p_, q_, s_), {', '.join(f'{curve(t)} AS {n}' for t, n in zip(('p_', 'q_', 's_'), 'rgb', strict=True))} FROM ({clamped})"


def float_bins(space: str) -> str:
    binner = FloatBinner(component_ranges(space))
    return ", ".join(f"CAST(floor(least(greatest(CAST(CAST(CAST(CAST(c{i} AS FLOAT) - CAST({float(low)!r} AS FLOAT) AS FLOAT) AS DOUBLE) / {float(step)!r} AS FLOAT), 0), 31)) AS INTEGER) AS b{i}" for i, (low, step) in enumerate(zip(binner.low, binner.step, strict=True)))


def unique(source: str, space: str) -> str:
    """(r, g, b, n, c0, c1, c2, b0, b1, b2) of the distinct colours."""
    bins = "CAST(r >> 3 AS INTEGER) AS b0, CAST(g >> 3 AS INTEGER) AS b1, CAST(b >> 3 AS INTEGER) AS b2" if space == "srgb" else float_bins(space)
    return f"SELECT *, {bins} FROM ({converted(f'SELECT r, g, b, count(*) AS n FROM ({source}) GROUP BY r, g, b', space)})"


def boxes(source: str, space: str, k: int, bins: int = 32) -> str:
    """(palette_idx, lo0, hi0, ..., c0, c1, c2, n) of at most k boxes, cut one after another."""
    scale = SCALES[space]
    inside = lambda c, x: " AND ".join(f"{c}.b{i} >= {x}.lo{i} AND {c}.b{i} < {x}.hi{i}" for i in range(3))
    bounds = ", ".join(f"lo{i}, hi{i}" for i in range(3))
    whole = " AND ".join(f"hi{i} - lo{i} = 1" for i in range(3))
    square = lambda a, b, c, n: f"({a} * {a} + {b} * {b} + {c} * {c}) / {n}"
    sums = ", ".join(f"sum(c.{v}) AS {v}" for v in ("n", "s0", "s1", "s2", "ss"))
    slabs = " UNION ALL ".join(f"SELECT {a} AS axis, b{a} AS slot, sum(n) AS n, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM inn GROUP BY b{a}" for a in range(3))
    run = ", ".join(f"CAST(sum({v}) OVER (PARTITION BY axis ORDER BY slot) AS DOUBLE) AS {v}u, CAST(sum({v}) OVER (PARTITION BY axis) AS DOUBLE) AS {v}t" for v in ("n", "s0", "s1", "s2"))
    score = f"-({square('s0u', 's1u', 's2u', 'nu')} + {square('(s0t - s0u)', '(s1t - s1u)', '(s2t - s2u)', '(nt - nu)')})"
    low, high = (", ".join(f"CASE WHEN axis = {i} THEN {a} ELSE p.lo{i} END AS lo{i}, CASE WHEN axis = {i} THEN {b} ELSE p.hi{i} END AS hi{i}" for i in range(3)) for a, b in (("{lo}", "pos"), ("pos", "{hi}")))
    low, high = low.replace("{lo}", "lo_"), high.replace("{hi}", "hi_")
    low, high = (x.replace("lo_", f"CASE axis {' '.join(f'WHEN {i} THEN p.lo{i}' for i in range(3))} END").replace("hi_", f"CASE axis {' '.join(f'WHEN {i} THEN p.hi{i}' for i in range(3))} END") for x in (low, high))
    spread = f"CAST(sum(c.ss) AS DOUBLE) / {scale} - {square(*(f'(CAST(sum(c.s{i}) AS DOUBLE) / {scale})' for i in range(3)), 'CAST(sum(c.n) AS DOUBLE)')}"
    mean = "floor(s{i} / n)" if space == "srgb" else f"CAST(CAST(CAST(s{{i}} AS DOUBLE) / {scale} / n AS FLOAT) AS DOUBLE)"
    rounded = lambda e: f"CAST(round_even({e} * {scale}, 0) AS BIGINT)" if scale > 1 else f"CAST({e} AS BIGINT)"
    return f"""
WITH RECURSIVE cells AS MATERIALIZED (SELECT b0, b1, b2, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'CAST(sum(n * {rounded(f"c{i}")}) AS BIGINT) AS s{i}' for i in range(3))}, CAST(sum(n * {rounded('(c0 * c0 + c1 * c1 + c2 * c2)')}) AS BIGINT) AS ss FROM ({unique(source, space)}) GROUP BY b0, b1, b2),
state AS (
  SELECT 1 AS step, 0 AS age, {', '.join(f'0 AS lo{i}, {bins} AS hi{i}' for i in range(3))}, CAST('infinity' AS DOUBLE) AS var WHERE EXISTS (SELECT 1 FROM cells)
  UNION ALL
  (WITH p AS (SELECT * FROM state WHERE var > 0 AND (SELECT count(*) FROM state) < {k} ORDER BY var DESC, age LIMIT 1),
  inn AS (SELECT c.* FROM cells c, p WHERE {inside('c', 'p')}),
  slab AS ({slabs}),
  placed AS (SELECT axis, slot + 1 AS pos, {run} FROM slab),
  best AS (SELECT axis, pos FROM placed WHERE nu < nt ORDER BY {score}, axis, pos LIMIT 1),
  half AS (SELECT 1 AS nth, {low} FROM p, best UNION ALL SELECT 2 AS nth, {high} FROM p, best)
  SELECT s.step + 1, s.age, {', '.join(f's.lo{i}, s.hi{i}' for i in range(3))}, CASE WHEN s.age = p.age THEN 0.0 ELSE s.var END FROM state s, p WHERE s.age <> p.age OR NOT EXISTS (SELECT 1 FROM best)
  UNION ALL
  SELECT any_value(p.step) + 1, (SELECT max(age) FROM state) + h.nth, {', '.join(f'h.{x}' for x in bounds.split(', '))}, CASE WHEN {whole.replace('hi', 'h.hi').replace('lo', 'h.lo')} THEN 0.0 ELSE {spread} END FROM half h, p, cells c WHERE {inside('c', 'h')} GROUP BY h.nth, {', '.join(f'h.{x}' for x in bounds.split(', '))}))
SELECT CAST(row_number() OVER (ORDER BY {bounds}) - 1 AS INTEGER) AS palette_idx, {bounds}, {', '.join(f'{mean.format(i=i)} AS c{i}' for i in range(3))}, n
FROM (SELECT {', '.join(f's.{x}' for x in bounds.split(', '))}, {sums} FROM state s, cells c WHERE s.step = (SELECT max(step) FROM state) AND {inside('c', 's')} GROUP BY {', '.join(f's.{x}' for x in bounds.split(', '))})"""


def _fold(samples: str, start: str, dim: int, batch: int | None) -> str:
    """(palette_idx, v, n) after a fold over samples (ordinal, v); start has palette_idx and v."""
    square = " + ".join(f"(x[{d}] - p[{d}]) * (x[{d}] - p[{d}])" for d in range(1, dim + 1)) if dim <= 3 else f"list_sum(list_transform(range(1, {dim + 1}), lambda d: (x[d] - p[d]) * (x[d] - p[d])))"
    before = "CASE WHEN a.i % " + str(batch) + " = 0 THEN a.c ELSE a.snap END" if batch else "a.c"
    step = f"list_transform([list_transform({before}, lambda p: {square})], lambda d: list_position(d, list_min(d)))[1]"
    moved = "list_transform(range(1, len(p) + 1), lambda d: p[d] + (x[d] - p[d]) * (1 / sqrt(a.n[j] + 1)))"
    new = f"list_transform([{step}], lambda j: {{'i': a.i + 1, 'snap': {before}, 'c': list_transform(a.c, lambda p, k: CASE WHEN k = j THEN {moved} ELSE p END), 'n': list_transform(a.n, lambda m, k: CASE WHEN k = j THEN m + 1 ELSE m END)}})[1]"
    whole = f"WHERE ordinal < (SELECT count(*) FROM s) // {batch} * {batch}" if batch else ""
    return f"""
WITH s AS MATERIALIZED ({samples}),
f AS MATERIALIZED (SELECT list(palette_idx ORDER BY palette_idx) AS ids, list(v ORDER BY palette_idx) AS v FROM ({start})),
done AS MATERIALIZED (SELECT ids, list_reduce(coalesce((SELECT list(v ORDER BY ordinal) FROM s {whole}), []), lambda a, x: {new}, {{'i': CAST(0 AS BIGINT), 'snap': v, 'c': v, 'n': list_transform(v, lambda p: CAST(0 AS BIGINT))}}) AS a FROM f)
SELECT unnest(ids) AS palette_idx, unnest(a.c) AS v, unnest(a.n) AS n FROM done"""


def palette(source: str, space: str, k: int, batch: int | None | str = "boxes", factor: float = 0.5, seed: int = 0) -> str:
    """(palette_idx, c0, c1, c2, n) in the space: boxes alone, or moved by k-means with batches (None: online)."""
    first = boxes(source, space, k)
    if batch == "boxes":
        return f"SELECT palette_idx, c0, c1, c2, CAST(n AS BIGINT) AS n FROM ({first})"
    samples = f"""
WITH u AS MATERIALIZED (SELECT [c0, c1, c2] AS v, CAST(sum(n) OVER (ORDER BY r, g, b) - n AS BIGINT) AS start FROM ({unique(source, space)})),
t AS (SELECT CAST(floor({factor} * (SELECT count(*) FROM u)) AS BIGINT) AS m, (SELECT CAST(sum(n) AS BIGINT) FROM ({unique(source, space)})) AS total),
d AS (SELECT o.ordinal, {places_sql('o.ordinal', 't.total', seed)} AS place FROM t, (SELECT unnest(range((SELECT m FROM t))) AS ordinal) o)
SELECT ordinal, v FROM d ASOF JOIN u ON d.place >= u.start"""
    whole = "trunc(least(greatest(v[{i}], 0), 255))" if space == "srgb" else "v[{i}]"
    return f"SELECT palette_idx, {', '.join(f'{whole.format(i=i + 1)} AS c{i}' for i in range(3))}, CAST(n AS BIGINT) AS n FROM ({_fold(samples, f'SELECT palette_idx, [c0, c1, c2] AS v FROM ({first})', 3, batch)})"


def assigned(source: str, space: str, k: int, batch: int | None | str = "boxes") -> str:
    """(r, g, b, palette_idx, n) of the distinct colours."""
    if batch == "boxes":
        inside = " AND ".join(f"u.b{i} >= x.lo{i} AND u.b{i} < x.hi{i}" for i in range(3))
        return f"SELECT u.r, u.g, u.b, u.n, x.palette_idx FROM ({unique(source, space)}) u JOIN ({boxes(source, space, k)}) x ON {inside}"
    d = " + ".join(f"(u.c{i} - p.c{i}) * (u.c{i} - p.c{i})" for i in range(3))
    return f"SELECT r, g, b, any_value(n) AS n, arg_min(palette_idx, (d, palette_idx)) AS palette_idx FROM (SELECT u.r, u.g, u.b, u.n, p.palette_idx, {d} AS d FROM ({unique(source, space)}) u, ({palette(source, space, k, batch)}) p) GROUP BY r, g, b"


def dithered(source: str, space: str, k: int, width: int, rows_per_band: int, batch: int | None | str = "boxes", diffusion: float = 7 / 8) -> str:
    """(pos, palette_idx) of an image whose source has pos, r, g, b. A row at a time, by a fold over its pixels; all bands side by side."""
    share = diffusion / 16
    near = "list_transform([list_transform(pal, lambda p: (v[1] - p[1]) * (v[1] - p[1]) + (v[2] - p[2]) * (v[2] - p[2]) + (v[3] - p[3]) * (v[3] - p[3]))], lambda d: list_position(d, list_min(d)))[1]"
    add = lambda a, e, f: f"[{', '.join(f'{a}[{i}] + {f}{e}[{i}]' for i in (1, 2, 3))}]"
    # a: carry (from the pixel before), here, behind: what the next row gets at the place before this one, at this one, and at the next.
    pixel = f"""list_transform([list_transform(range(1, 4), lambda d: x.v[d] + (x.err[d] + a.carry[d]))], lambda v: list_transform([{near}], lambda j: list_transform([list_transform(range(1, 4), lambda d: (v[d] - pal[j][d]) * CAST({share!r} AS DOUBLE))], lambda e: {{
      'carry': list_transform(e, lambda q: 7 * q), 'before': {add('a.here', 'e', '5 * ')}, 'here': e, 'out': list_append(a.out, {{'j': j, 'down': {add('a.before', 'e', '3 * ')}}})}})[1])[1])[1]"""
    return f"""
WITH RECURSIVE pals AS MATERIALIZED (SELECT list([c0, c1, c2] ORDER BY palette_idx) AS pal, list(palette_idx ORDER BY palette_idx) AS ids FROM ({palette(source, space, k, batch)})),
px AS MATERIALIZED (SELECT pos // {width} AS y, pos % {width} AS x, [c0, c1, c2] AS v FROM ({converted(source, space)})),
lines AS MATERIALIZED (SELECT y, list(v ORDER BY x) AS forth, list(v ORDER BY x DESC) AS back FROM px GROUP BY y),
bands AS (SELECT DISTINCT y // {rows_per_band} AS band FROM px),
walk AS (
  SELECT band, CAST(-2 AS BIGINT) AS nth, CAST(NULL AS INTEGER[]) AS found, list_transform(range({width}), lambda i: [0.0::DOUBLE, 0.0, 0.0]) AS down FROM bands
  UNION ALL
  SELECT band, nth, list_transform(CASE WHEN nth % 2 <> 0 THEN list_reverse(o) ELSE o END, lambda q: CAST(q.j AS INTEGER)), CASE WHEN y < 0 THEN list_transform(range({width}), lambda i: [0.0::DOUBLE, 0.0, 0.0]) WHEN nth % 2 <> 0 THEN list_reverse(d) ELSE d END FROM (
    SELECT band, nth, y, a.out AS o, list_append(list_transform(a.out[2:], lambda q: q.down), a.before) AS d FROM (
      SELECT w.band, w.nth + 1 AS nth, l.y, list_reduce(list_transform(range(1, {width} + 1), lambda i: {{'v': CASE WHEN (w.nth + 1) % 2 <> 0 THEN l.back[i] ELSE l.forth[i] END, 'err': CASE WHEN (w.nth + 1) % 2 <> 0 THEN list_reverse(w.down)[i] ELSE w.down[i] END}}),
        lambda a, x: {pixel}, {{'carry': [0.0::DOUBLE, 0.0, 0.0], 'before': [0.0::DOUBLE, 0.0, 0.0], 'here': [0.0::DOUBLE, 0.0, 0.0], 'out': []::STRUCT(j BIGINT, down DOUBLE[])[]}}) AS a
      FROM walk w, pals, (SELECT y, forth, back FROM lines UNION ALL SELECT -1, list_transform(range({width}), lambda i: [0.0::DOUBLE, 0.0, 0.0]), list_transform(range({width}), lambda i: [0.0::DOUBLE, 0.0, 0.0])) l
      WHERE w.nth + 1 < {rows_per_band} AND l.y = w.band * {rows_per_band} + w.nth + 1)))
SELECT (band * {rows_per_band} + nth) * {width} + x - 1 AS pos, CAST((SELECT ids FROM pals)[found[x]] AS INTEGER) AS palette_idx FROM walk, (SELECT unnest(range(1, {width} + 1)) AS x) WHERE nth >= 0"""


def dissimilarity(source: str, quantized: str, width: int, window: int = 8, scales: int = 4) -> str:
    """1/s - 1 for the mean structural similarity s of two images with pos, r, g, b."""
    luma = lambda t: " + ".join(f"{t}.{c} * {w}" for c, w in zip("rgb", LUMA, strict=True))
    return f"""
WITH px AS (SELECT p.pos // {width} AS y, p.pos % {width} AS x, {luma('p')} AS a, {luma('q')} AS b FROM ({source}) p JOIN ({quantized}) q USING (pos)),
cell AS (SELECT s, x >> s AS x, y >> s AS y, CAST(sum(a) AS DOUBLE) / count(*) AS a, CAST(sum(b) AS DOUBLE) / count(*) AS b FROM px, (SELECT unnest(range({scales})) AS s) GROUP BY s, x >> s, y >> s),
win AS (SELECT s, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM cell GROUP BY s, x // {window}, y // {window}),
scale AS (SELECT s, avg(((2 * ma * mb + {C1!r}) * (2 * (ab - ma * mb) + {C2!r})) / ((ma * ma + mb * mb + {C1!r}) * (aa - ma * ma + bb - mb * mb + {C2!r}))) AS v FROM win GROUP BY s)
SELECT 1 / avg(v) - 1 AS dssim FROM scale"""


def embeddings_sql(dim: int, batch: int, factor: float = 1.0, seed: int = 0) -> str:
    """The labels' mean vectors moved by samples of the vectors, and how many vectors are nearest to each."""
    start = f"SELECT palette_idx, list(m ORDER BY d) AS v FROM (SELECT label AS palette_idx, d, avg(CAST(embedding[d] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, {dim + 1})) AS d) GROUP BY label, d) GROUP BY palette_idx"
    samples = f"""
WITH u AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT ordinal, {places_sql('ordinal', '(SELECT count(*) FROM embeddings)', seed)} AS idx FROM (SELECT unnest(range((SELECT CAST(floor({factor} * count(*)) AS BIGINT) FROM embeddings))) AS ordinal))
SELECT ordinal, v FROM d JOIN u USING (idx)"""
    moved = _fold(samples, start, dim, batch)
    return f"""
WITH moved AS MATERIALIZED ({moved}),
near AS (SELECT vec_id, arg_min(palette_idx, (dist, palette_idx)) AS palette_idx FROM (SELECT vec_id, palette_idx, list_sum(list_transform(range(1, {dim + 1}), lambda d: (CAST(embedding[d] AS DOUBLE) - v[d]) * (CAST(embedding[d] AS DOUBLE) - v[d]))) AS dist FROM embeddings, moved) GROUP BY vec_id)
SELECT CAST(moved.palette_idx AS INTEGER) AS palette_idx, CAST(moved.n AS BIGINT) AS n, vectors FROM moved LEFT JOIN (SELECT palette_idx, count(*) AS vectors FROM near GROUP BY palette_idx) USING (palette_idx)"""
