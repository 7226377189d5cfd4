"""Numpy kernels: the closed-form scene, and agreement with the relational form."""

import numpy as np
import pytest

from gradelake.pixels import kernels as K


def scene(w=1000, h=1200):
    y, x = np.mgrid[0:h, 0:w]
    rgb = np.empty((h, w, 3), np.uint8)
    rgb[:] = (38, 40, 44)
    rgb[150:934, 200:760] = (228, 198, 64)
    noise = ((31 * x + 17 * y) % 13 - 6)[..., None]
    art = np.array([30, 60, 140]) + noise
    rgb[190:894, 230:710] = art[190:894, 230:710]
    return rgb


def test_outline_of_the_scene():
    quad, sure = K.outline(scene())
    assert sure > 0.6
    assert np.abs(quad - [[200, 150], [759, 150], [759, 933], [200, 933]]).max() < 6


def test_landscape_is_turned():
    rgb, quad, sure = K.oriented_outline(np.ascontiguousarray(np.rot90(scene())))
    assert rgb.shape[0] > rgb.shape[1] and sure > 0.6


def test_blown_out_is_no_card():
    rgb = scene()
    rgb[150:934, 200:760] = 255
    assert K.outline(rgb)[1] <= 0.3


def test_flat_image_has_no_outline():
    assert K.outline(np.full((120, 100, 3), 90, np.uint8))[1] == 0.1


def test_line_among_clutter():
    x = np.arange(0, 31, dtype=float)
    u = np.concatenate([x, np.arange(16) * 3.0])
    v = np.concatenate([2 * x + 5, 200 + (np.arange(16) * 37 % 50)])
    a, b = K.consensus_line(u, v)
    assert a == pytest.approx(2, abs=0.05) and b == pytest.approx(5, abs=0.5)
    assert K.consensus_line(u, v) == (a, b)


def test_warp_and_crop():
    rgb = scene()
    flat = K.warped(rgb, np.array([[200, 150], [759, 150], [759, 933], [200, 933]], float), 560, 784)
    assert (flat == rgb[150:934, 200:760]).all()
    half = K.warped(np.array([[[0, 0, 0], [1, 2, 3]]], np.uint8), np.array([[0, 0], [1, 0], [1, 0], [0, 0]], float), 3, 1)
    assert half[0, 1].tolist() == [0, 1, 2]  # half to even


def test_text_band():
    rgb = np.full((10, 10, 3), 40, np.uint8)
    rgb[:, 5:] = 210
    band = K.text_band(rgb, 0, 0, 1, 1)
    assert band.shape == (30, 30) and band[:, :10].max() < 20 and band[:, 20:].min() > 235


def test_agrees_with_relational(spark, sf):
    from gradelake.plans.vision_queries import _rasters, laplacian_var, sobel

    rasters = {r.image: K.unpacked(r.data, r.width, r.height) for r in _rasters(spark, sf).collect()}
    for query, kernel in ((sobel, K.gradient), (laplacian_var, K.laplacian)):
        for r in query(spark, sf).collect():
            plane = kernel(K.gray_of(rasters[r.image])).astype(float)
            assert (plane.mean(), plane.var()) == pytest.approx((r["mean"], r["variance"]), rel=1e-4, abs=1e-4)
