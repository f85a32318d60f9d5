"""Properties that palettes, counts, k-means and dithering have."""

from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tintflow.functions import FloatBinner, UIntBinner, component_ranges, default_binner, from_srgb, to_srgb
from tintflow.functions.colorspace import ColorSpace
from tintflow.operators import counts, dither, fidelity, histogram, kmeans, nearest, sampling, wu
from tintflow.plans import ImagePipeline, PalettePipeline, QuantizeMethod
from tintflow.sources import color_slice, empty_pixels, image_bytes, num_colors, pixels_of, quantized_pixels, read_images, truncated, validated, write_image_files
from tintflow.types import IMAGES, PALETTE, AboveMaxLen, PaletteSize, QuantizeOutput


def distinct_colors(n, seed=0):
    """Colours of which no two share a cell of 32 x 32 x 32."""
    cells = np.random.default_rng(seed).permutation(32**3)[:n]
    return [(int(c >> 10) * 8 + 3, int(c >> 5 & 31) * 8 + 1, int(c & 31) * 8 + 6) for c in cells]


def image_of(spark, width, height, image_id=0):
    return spark.createDataFrame([(image_id, width, height)], "image_id long, width long, height long")


def colors_of(palette):
    return sorted((r["r"], r["g"], r["b"]) for r in palette.collect())


def test_palette_size():
    assert int(PaletteSize()) == 256 and int(PaletteSize.clamped(1000)) == 256 and int(PaletteSize.clamped(-1)) == 0
    with pytest.raises(AboveMaxLen, match="above the maximum length of 256"):
        PaletteSize(257)
    with pytest.raises(ValueError):
        PaletteSize(-1)
    assert str(PaletteSize(7)) == "7"


def test_empty(spark):
    px = empty_pixels(spark)
    assert num_colors(px) == 0
    assert counts.unique_color_counts(px).count() == 0
    colors, index = counts.indexed_color_counts(px)
    assert colors.count() == index.count() == 0
    assert PalettePipeline(px).palette().count() == 0
    out = ImagePipeline(px, image_of(spark, 1, 1).limit(0)).indexed_palette()
    assert out.palette.count() == out.indices.count() == 0
    assert QuantizeOutput.empty(spark).palette.count() == 0


def test_no_colors_wanted(spark):
    assert PalettePipeline(color_slice(spark, [(1, 2, 3)])).palette_size(0).palette().count() == 0


def test_bad_pixels(spark):
    with pytest.raises(ValueError):
        color_slice(spark, [(1, 2, 256)])
    bad = spark.createDataFrame([(0, 0, 1, None, 3)], "image_id long, pos long, r long, g long, b long")
    with pytest.raises(Exception, match="whole numbers"):
        validated(bad).collect()


def test_truncated(spark):
    assert truncated(color_slice(spark, [(1, 1, 1)] * 9), 4).count() == 4


def test_index_is_dense_and_ordered(spark):
    values = distinct_colors(200) * 2
    colors, index = counts.indexed_color_counts(color_slice(spark, values))
    got = [tuple(r) for r in colors.orderBy("color_idx").select("r", "g", "b").collect()]
    assert got == sorted(set(values))
    by_pos = {r["pos"]: r["color_idx"] for r in index.collect()}
    assert [got[by_pos[i]] for i in range(len(values))] == values


def test_one_more_of_a_color(spark):
    values = distinct_colors(60)
    before = {tuple(r)[1:4]: r["n"] for r in counts.unique_color_counts(color_slice(spark, values)).collect()}
    after = {tuple(r)[1:4]: r["n"] for r in counts.unique_color_counts(color_slice(spark, [*values, values[5]])).collect()}
    assert {k: after[k] - before[k] for k in before if after[k] != before[k]} == {values[5]: 1}


def test_order_does_not_matter(spark):
    values = distinct_colors(300)
    a = PalettePipeline(color_slice(spark, values)).palette_size(40).palette().collect()
    b = PalettePipeline(color_slice(spark, values[::-1]).repartition(7)).palette_size(40).palette().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_fewer_colors_than_wanted(spark):
    values = distinct_colors(64)
    palette = PalettePipeline(color_slice(spark, values)).palette()
    assert colors_of(palette) == sorted(values)


def test_exact_image_stays(spark):
    values = distinct_colors(256)
    order = np.roll(np.repeat(np.arange(256), 4), 7)
    px = color_slice(spark, [values[i] for i in order])
    out = ImagePipeline(px, image_of(spark, 32, 32)).indexed_palette()
    assert colors_of(out.palette) == sorted(values)
    assert {r["n"] for r in out.palette.collect()} == {4}
    back = quantized_pixels(out.indices, out.palette).orderBy("pos").select("r", "g", "b").collect()
    assert [tuple(r) for r in back] == [values[i] for i in order]


def test_many_images_at_once(spark):
    a, b = distinct_colors(20, 1), distinct_colors(30, 2)
    px = color_slice(spark, a, 1).unionByName(color_slice(spark, b, 2))
    palette = PalettePipeline(px).palette_size(20).palette()
    assert colors_of(palette.where("image_id = 1")) == sorted(a)
    assert palette.where("image_id = 2").count() == 20
    alone = PalettePipeline(color_slice(spark, b, 2)).palette_size(20).palette()
    assert colors_of(alone) == colors_of(palette.where("image_id = 2"))


@pytest.mark.parametrize("space", ["oklab", "lab"])
def test_spaces_keep_separate_colors(spark, space):
    values = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    palette = PalettePipeline(color_slice(spark, values * 3)).colorspace(space).palette()
    assert colors_of(palette) == sorted(values)


@pytest.mark.parametrize("space", list(ColorSpace))
def test_round_trip_and_ranges(spark, space):
    grid = spark.range(0, 1 << 24, 997).select((F.shiftright("id", 16)).alias("r"), (F.shiftright("id", 8) % 256).alias("g"), (F.col("id") % 256).alias("b"))
    c = grid.select("r", "g", "b", *[x.cast("double").alias(f"c{i}") for i, x in enumerate(from_srgb(F.col("r"), F.col("g"), F.col("b"), space))])
    back = c.select("*", *[x.alias(f"{n}2") for x, n in zip(to_srgb(F.col("c0"), F.col("c1"), F.col("c2"), space), "rgb", strict=True)])
    assert back.where("r <> r2 or g <> g2 or b <> b2").count() == 0
    if space is not ColorSpace.SRGB:
        for i, (lo, hi) in enumerate(component_ranges(space)):
            assert c.where((F.col(f"c{i}") < lo - 1e-3) | (F.col(f"c{i}") > hi + 1e-3)).count() == 0


def test_float_binner_saturates(spark):
    row = spark.createDataFrame([(-5.0, float("nan"), 2.0), (0.999, 0.5, 0.0)], "a double, b double, c double")
    got = [tuple(r) for r in row.select(*FloatBinner([(0.0, 1.0)] * 3, 4)(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [(0, 0, 3), (3, 2, 0)]
    with pytest.raises(ValueError):
        UIntBinner(24)
    assert default_binner("srgb").bins == 32


def test_own_binner(spark):
    values = distinct_colors(50)
    halves = wu.palette(color_slice(spark, values), 4, lambda r, g, b: [(c >= 128).cast("int") for c in (r, g, b)], bins=2)
    assert 1 <= halves.count() <= 4 and halves.agg(F.sum("n")).first()[0] == 50


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 7), st.integers(1, 9)), min_size=1, max_size=40), st.integers(1, 20))
def test_boxes_part_the_cells(cells, k):
    b = np.array([c[:3] for c in cells]).T
    n = np.array([c[3] for c in cells])
    grid = wu.Grid(list(b), [n, *(n * x for x in b), (n * (b**2).sum(axis=0)).astype(float)], 8)
    boxes = grid.boxes(k)
    assert len(boxes) <= k and sum(int(grid.sums(x)[0]) for x in boxes) == n.sum()
    assert all(sum(all(lo <= v < hi for v, (lo, hi) in zip(cell, x, strict=True)) for x in boxes) == 1 for cell in b.T)
    for box in boxes:
        inside = np.all([(b[i] >= box[i][0]) & (b[i] < box[i][1]) for i in range(3)], axis=0)
        assert grid.sums(box)[0] == n[inside].sum()


def test_first_cut_is_the_best(spark):
    cells = histogram.moments(color_slice(spark, distinct_colors(120, 4)), UIntBinner(8))
    best = histogram.best_cut(cells, ((0, 8),) * 3).first()
    boxes = wu.find_boxes(cells, 2, 8).orderBy("palette_idx").collect()
    assert boxes[0][f"hi{best['axis']}"] == best["pos"] == boxes[1][f"lo{best['axis']}"]
    assert {r["n"] for r in boxes} == {best["n_upper"], best["n_lower"]} or boxes[0]["n"] == best["n_upper"]


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(3)
    values, entries = [tuple(map(int, x)) for x in rng.integers(0, 256, (300, 3))], rng.integers(0, 256, (60, 3))
    palette = spark.createDataFrame([(0, i, *map(float, e), 0) for i, e in enumerate(entries)], PALETTE)
    px = color_slice(spark, values).withColumns({f"c{i}": F.col(n).cast("double") for i, n in enumerate("rgb")})
    want = [int(np.argmin(((entries - v) ** 2).sum(axis=1))) for v in np.array(values)]
    for limit in (nearest.SENT_ROWS, 0):  # sent to the executors, and joined
        old, nearest.SENT_ROWS = nearest.SENT_ROWS, limit
        try:
            got = [r["palette_idx"] for r in nearest.nearest(px, palette).orderBy("pos").collect()]
        finally:
            nearest.SENT_ROWS = old
        assert got == want


def test_distance_table(spark):
    palette = spark.createDataFrame([(0, i, *map(float, c), 0) for i, c in enumerate(distinct_colors(20))], PALETTE)
    rows = nearest.distance_table(palette).orderBy("i", "rank").collect()
    assert all(r["j"] == r["i"] and r["quarter"] == 0 for r in rows if r["rank"] == 0)
    assert all(a["quarter"] <= b["quarter"] for a, b in zip(rows, rows[1:], strict=False) if a["i"] == b["i"])


def test_first_sample_replaces_a_centroid():
    c, n = kmeans.fold(np.array([[10.0, 0, 0]]), np.array([[0.0, 0, 0], [100, 0, 0]]), None)
    assert c.tolist() == [[10, 0, 0], [100, 0, 0]] and n.tolist() == [1, 0]


def test_whole_batches_only():
    points = np.arange(30.0).reshape(10, 3)
    assert kmeans.fold(points, np.zeros((1, 3)), 4)[1].tolist() == [8]
    assert kmeans.fold(points, np.zeros((1, 3)), 0)[1].tolist() == [0]
    assert kmeans.fold(points, np.zeros((1, 3)), 11)[1].tolist() == [0]
    assert kmeans.fold(points, np.zeros((0, 3)), None)[0].shape == (0, 3)


def test_num_samples():
    assert [kmeans.num_samples(f, 10) for f in (0.5, 0.0, -1.0, float("nan"), 0.99)] == [5, 0, 0, 0, 9]
    assert len(kmeans.Centroids.truncated([[0.0, 0, 0]] * 300)) == 256
    with pytest.raises(AboveMaxLen):
        kmeans.Centroids([[0.0, 0, 0]] * 257)
    with pytest.raises(ValueError):
        kmeans.KmeansOptions(mode="other")


@pytest.mark.parametrize("mode", ["online", "minibatch"])
def test_centroids_that_are_the_colors_stay(spark, mode):
    values = distinct_colors(100)
    px = color_slice(spark, values * 4)
    palette = PalettePipeline(px).palette_size(100).quantize_method(QuantizeMethod.with_kmeans(mode=mode, batch_size=16, sampling_factor=3.0)).palette()
    assert colors_of(palette) == sorted(values)
    assert palette.agg(F.sum("n")).first()[0] == (300 if mode == "online" else 288)


def test_samples_follow_the_weights(spark):
    got = np.bincount(kmeans.draw(np.array([900, 0, 100]), 5000, 3), minlength=3)
    assert got.sum() == 5000 and 4350 < got[0] < 4650 and not got[1]
    whole = kmeans.draw(np.array([900, 0, 100]), 500, 3)
    assert np.concatenate([kmeans.draw(np.array([900, 0, 100]), 200, 3), kmeans.draw(np.array([900, 0, 100]), 500, 3, 200)]).tolist() == whole.tolist()
    assert not len(kmeans.draw(np.zeros(0, np.int64), 9, 1)) and not len(kmeans.draw(np.ones(3, np.int64), 0, 1))
    column = spark.range(500).select(sampling.place_column(F.col("id"), 1000, 3)).collect()
    assert [r[0] for r in column] == sampling.places(np.arange(500), 1000, 3).tolist()
    assert np.bincount(sampling.places(np.arange(100_000), 10, 9)).min() > 9_500


def test_batches_are_folded_one_by_one():
    rng = np.random.default_rng(7)
    points, start = rng.normal(size=(203, 3)), rng.normal(size=(9, 3))
    for batch in (None, 1, 20):
        c, n = start.copy(), np.zeros(9)
        size = batch or 1
        for lo in range(0, len(points) // size * size, size):
            near = [int(np.argmin(((c - x) ** 2).sum(axis=1))) for x in points[lo : lo + size]]
            for x, j in zip(points[lo : lo + size], near, strict=True):
                n[j] += 1
                c[j] += (x - c[j]) / np.sqrt(n[j])
        got = kmeans.Fold(start, batch)
        for lo in range(0, len(points), 37):
            got.add(points[lo : lo + 37])
        assert np.allclose(got.c, c) and got.count.tolist() == n.tolist()


@pytest.mark.parametrize("space", ["srgb", "lab", "oklab"])
def test_palettes_do_not_depend_on_partitions(spark, space):
    rng = np.random.default_rng(2)
    px = color_slice(spark, [tuple(map(int, c)) for c in rng.integers(0, 256, (3000, 3))])
    for method in (QuantizeMethod.wu(), QuantizeMethod.with_kmeans(batch_size=64)):
        out = [sorted(map(tuple, PalettePipeline(px.repartition(n)).colorspace(space).palette_size(20).quantize_method(method).palette().collect())) for n in (1, 7, 13)]
        assert out[0] == out[1] == out[2]


def test_more_centroids_than_allowed(spark):
    vectors = spark.range(10).selectExpr("id", "array(double(id), 0d) AS v")
    many = spark.range(257).selectExpr("int(id) AS palette_idx", "array(double(id), 0d) AS v")
    with pytest.raises(AboveMaxLen):
        nearest.nearest_vectors(vectors, many, "id", "v")
    with pytest.raises(AboveMaxLen):
        kmeans.refine_vectors(vectors, many, "id", "v")


def test_bands_side_by_side():
    rng = np.random.default_rng(1)
    palette = rng.integers(0, 256, (12, 3)).astype(float)
    bands = [rng.integers(0, 256, (h, 9, 3)).astype(float) for h in (5, 6, 6, 3)]
    warm = [False, True, True, True]
    for one, b, w in zip(dither.diffuse_bands(bands, palette, 7 / 8, warm), bands, warm, strict=True):
        assert (one == dither.diffuse(b, palette, 7 / 8, w)).all()


def test_quantized_image_takes_few_jobs(spark):
    rng = np.random.default_rng(3)
    px, im = color_slice(spark, [tuple(map(int, c)) for c in rng.integers(0, 256, (400, 3))]), image_of(spark, 20, 20)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    q = ImagePipeline(px, im, check=False).palette_size(16).colorspace("oklab").quantize_method(QuantizeMethod.with_kmeans(batch_size=32)).quantized_pixels()
    built = len(tracker.getJobIdsForGroup(None)) - before
    assert q.count() == 400 and built <= 14  # a stage of an adaptive plan counts as a job


def test_without_distinct_colors(spark):
    px = color_slice(spark, distinct_colors(40) * 5)
    method = QuantizeMethod.with_kmeans(mode="online", sampling_factor=0.5)
    assert PalettePipeline(px).palette_size(8).quantize_method(method).palette().agg(F.sum("n")).first()[0] == 20
    assert PalettePipeline(px).palette_size(8).quantize_method(method).dedup_pixels(False).palette().agg(F.sum("n")).first()[0] == 100


def test_kmeans_lowers_the_error(spark):
    """In the space that is quantised."""
    rng = np.random.default_rng(5)
    values = [tuple(map(int, np.clip(rng.normal(m, 25, 3), 0, 255))) for m in rng.integers(30, 220, (12, 3))[rng.integers(0, 12, 3600)]]
    px, im = color_slice(spark, values), image_of(spark, 60, 60)
    errors = []
    for method in (QuantizeMethod.wu(), QuantizeMethod.with_kmeans(mode="online", sampling_factor=4.0)):
        q = ImagePipeline(px, im).palette_size(24).quantize_method(method).dither(False).quantized_pixels()
        both = px.join(q.select("pos", *[F.col(c).alias(f"{c}q") for c in "rgb"]), "pos")
        errors.append(both.agg(F.avg((F.col("r") - F.col("rq")) ** 2 + (F.col("g") - F.col("gq")) ** 2 + (F.col("b") - F.col("bq")) ** 2)).first()[0])
    assert errors[1] < errors[0]


def test_dithering_and_kmeans_lower_the_dissimilarity(spark):
    """Of a smooth picture, in the published order: boxes, boxes dithered; and k-means below boxes."""
    y, x = np.mgrid[0:48, 0:64]
    values = [tuple(map(int, v)) for v in np.stack([120 + 100 * np.sin(x / 13), 128 + 1.5 * x - y, 60 + 3 * y], 2).clip(0, 255).reshape(-1, 3)]
    px, im = color_slice(spark, values), image_of(spark, 64, 48)
    pipe = ImagePipeline(px, im).palette_size(12)
    kmeans_ = pipe.quantize_method(QuantizeMethod.with_kmeans(mode="online", sampling_factor=4.0))
    score = lambda p, on: fidelity.dissimilarity(px, p.dither(on).quantized_pixels(), im).first()["dssim"]
    boxes = score(pipe, False)
    assert fidelity.dissimilarity(px, px, im).first()["dssim"] == 0
    assert 0 < score(pipe, True) < boxes and score(kmeans_, False) < boxes


def test_dither_options():
    assert dither.checked_diffusion(0.5) == 0.5 and dither.checked_diffusion(2.0, 7 / 8) == 7 / 8
    with pytest.raises(ValueError):
        dither.checked_diffusion(-0.1)


def test_dither_keeps_the_mean():
    grey = np.full((32, 32, 1), 96.0)
    got = dither.diffuse(grey, np.array([[0.0], [255.0]]), 1.0)
    assert abs(got.mean() * 255 - 96) < 8
    assert (dither.diffuse(grey, np.array([[0.0], [255.0]]), 0.0) == 0).all()


def test_dither_by_hand():
    # 100 -> 0 hands 100 * 7/16 = 43.75 on, and 143.75 -> 255.
    got = dither.diffuse(np.array([[[100.0], [100.0]]]), np.array([[0.0], [255.0]]), 1.0)
    assert got.tolist() == [[0, 1]]
    # What a warm-up row hands down, and nothing of it comes back.
    rows = np.array([[[100.0], [100.0]], [[100.0], [100.0]]])
    assert dither.diffuse(rows, np.array([[0.0], [255.0]]), 1.0, warm_up=True).shape == (1, 2)


def test_first_band_is_as_without_bands(spark):
    rng = np.random.default_rng(8)
    px, im = color_slice(spark, [tuple(map(int, x)) for x in rng.integers(0, 256, (400, 3))]), image_of(spark, 20, 20)
    one = ImagePipeline(px, im).palette_size(8).indexed_palette().indices
    bands = ImagePipeline(px, im).palette_size(8).indexed_palette(rows_per_band=8).indices
    assert bands.count() == 400
    assert sorted(map(tuple, one.where("pos < 160").collect())) == sorted(map(tuple, bands.where("pos < 160").collect()))


def test_wrong_dimensions(spark):
    with pytest.raises(ValueError):
        ImagePipeline(color_slice(spark, [(0, 0, 0)] * 5), image_of(spark, 2, 2))


def test_image_files_round_trip(spark, tmp_path):
    values = distinct_colors(12)
    content = image_bytes(color_slice(spark, values), image_of(spark, 4, 3)).first()["content"]
    (tmp_path / "a.png").write_bytes(bytes(content))
    images = read_images(spark, str(tmp_path))
    assert (images.first()["width"], images.first()["height"]) == (4, 3)
    assert [tuple(r) for r in pixels_of(images).orderBy("pos").select("r", "g", "b").collect()] == values
    pipe = ImagePipeline.from_images(images).palette_size(12)
    assert colors_of(pipe.to_palette_pipeline().palette()) == sorted(values)
    assert pipe.quantized_images("ppm").first()["content"][:2] == b"P6"
    write_image_files(color_slice(spark, values), image_of(spark, 4, 3), str(tmp_path / "out"))
    again = pixels_of(read_images(spark, str(tmp_path / "out")))
    assert [f.name for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")] == ["0.png"]
    assert [tuple(r) for r in again.orderBy("pos").select("r", "g", "b").collect()] == values


def test_image_files_are_made_in_pieces(spark, tmp_path, monkeypatch):
    from tintflow.sources import sinks

    monkeypatch.setattr(sinks, "PIECE", 5, raising=False)
    monkeypatch.setattr(sinks, "CHUNK", 16, raising=False)
    sizes = [(0, 7, 9), (1, 3, 1), (2, 1, 11)]
    values = {i: [tuple(map(int, x)) for x in np.random.default_rng(i).integers(0, 256, (w * h, 3))] for i, w, h in sizes}
    # Positions are an order: there may be gaps, of places too.
    px = reduce(lambda a, b: a.unionByName(b), [color_slice(spark, v, i).withColumn("pos", F.col("pos") * 3 + 1) for i, v in values.items()])
    im = spark.createDataFrame(sizes, IMAGES)
    # No group function is given all pixels of an image.
    assert "FlatMapGroups" not in image_bytes(px, im)._jdf.queryExecution().toString()
    assert max(len(r["data"]) for r in sinks.packed_pixels(px).collect()) <= 3 * 5
    assert {r["image_id"]: bytes(r["content"]) for r in image_bytes(px, im, "ppm").collect()} == {i: b"P6\n%d %d\n255\n" % (w, h) + bytes(sum(values[i], ())) for i, w, h in sizes}
    write_image_files(px, im, str(tmp_path))
    again = pixels_of(read_images(spark, str(tmp_path)).withColumn("image_id", F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("long")))
    assert [tuple(r) for r in again.orderBy("image_id", "pos").collect()] == [(i, pos, *c) for i, v in values.items() for pos, c in enumerate(v)]
    with pytest.raises(Exception, match="an image of 3 x 2 has 3 pixels"):
        write_image_files(px.where("image_id = 1"), spark.createDataFrame([(1, 3, 2)], IMAGES), str(tmp_path / "wrong"))
    assert not list((tmp_path / "wrong").glob("[!.]*")) and not list((tmp_path / "wrong").glob(".1-*"))
    # Without positions, or with one position for all, an image still comes in pieces, and none of its pixels is lost.
    same = color_slice(spark, values[0])
    for pos in (None, 4):
        content = image_bytes(same.withColumn("pos", F.lit(pos).cast("long")), im, "ppm").first()["content"]
        assert sorted(zip(*[iter(bytes(content)[len(b"P6\n7 9\n255\n") :])] * 3, strict=True)) == sorted(values[0])


def test_image_files_are_read_in_pieces(spark, monkeypatch):
    from tintflow.sources import images as reading

    monkeypatch.setattr(reading, "PIECE", 5, raising=False)
    data = {3: bytes(np.random.default_rng(3).integers(0, 256, 33, dtype=np.uint8)), 1: bytes(range(13))}
    images = spark.createDataFrame([(n, n, bytearray(x)) for n, x in data.items()], "image_id long, channels int, data binary")
    seen, plain = [], type(images).mapInArrow

    def mapped(df, *args, **more):
        seen.append(df.select(F.max(F.length("data"))).first()[0])
        return plain(df, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(type(images), "mapInArrow", mapped)
        got = pixels_of(images)
    assert seen == [15]
    grey, color = [(1, i, x, x, x) for i, x in enumerate(data[1])], [(3, i, *data[3][3 * i : 3 * i + 3][::-1]) for i in range(11)]
    assert [tuple(r) for r in got.orderBy("image_id", "pos").collect()] == grey + color


def test_benchmark_folders(spark, tmp_path):
    from tintflow.sources import benchmark_images, load_image_dir

    for size in ("4x3", "2x2"):
        (tmp_path / size).mkdir()
        w, h = map(int, size.split("x"))
        content = image_bytes(color_slice(spark, distinct_colors(w * h)), image_of(spark, w, h)).first()["content"]
        (tmp_path / size / "a.png").write_bytes(bytes(content))
    assert [r["width"] for r in benchmark_images(spark, str(tmp_path)).collect()] == [4, 2]
    assert load_image_dir(spark, str(tmp_path / "2x2")).count() == 1


def test_stream(spark, tmp_path):
    from tintflow.streaming import write_palettes

    values = distinct_colors(30)
    color_slice(spark, values[:15]).write.parquet(str(tmp_path / "in"))
    seen = []
    for part in (values[:15], values[15:]):
        if part != values[:15]:
            color_slice(spark, part).write.mode("append").parquet(str(tmp_path / "in"))
        px = spark.readStream.schema(color_slice(spark, values[:1]).schema).parquet(str(tmp_path / "in"))
        write_palettes(px, 256, lambda p, _: seen.append(sorted((int(r["c0"]), int(r["c1"]), int(r["c2"])) for r in p.collect())), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert seen[0] == sorted(values[:15]) and seen[-1] == sorted(values)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 256
    assert set(e.oracle_sql()) <= set(e.queries())
