"""Camera motion and lines on drawn frames whose motion and lines are known."""

import numpy as np
import pandas as pd
import pytest

from touchgrid.operators import camera, images, motion as M


def texture(h=200, w=320, seed=1):
    """A smooth random function of places, so that any view of it can be drawn exactly."""
    rng = np.random.default_rng(seed)
    waves = [(rng.normal(0, 0.12, 2), rng.uniform(0, 6.28), rng.uniform(5, 20)) for _ in range(40)]
    return lambda x, y: np.clip(128 + sum(a * np.sin(k[0] * x + k[1] * y + p) for k, p, a in waves) / 2, 0, 255)


def view(f, affine, h=200, w=320):
    """The frame whose pixel ``affine`` p shows what pixel p shows in the first."""
    y, x = np.mgrid[:h, :w].astype(float)
    back = np.linalg.inv(np.vstack([affine, [0, 0, 1]]))
    return f(back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2])


def rgb(g):
    return np.repeat(np.round(g).astype(np.uint8)[..., None], 3, 2)


def table(spark, *frames):
    return spark.createDataFrame(pd.DataFrame([{"match_id": 0, "frame_idx": i, "image": p.tobytes(), "width": p.shape[1], "height": p.shape[0]} for i, p in enumerate(frames)]))


def turned(scale, degrees, dx, dy):
    c, s = scale * np.cos(np.deg2rad(degrees)), scale * np.sin(np.deg2rad(degrees))
    return np.array([[c, -s, dx], [s, c, dy]])


@pytest.mark.parametrize(("scale", "degrees", "dx", "dy"), [(1, 0, 0, 0), (1, 0, 9, -4), (1.02, 0.5, -3, 2)])
def test_motion_is_the_one_drawn(spark, scale, degrees, dx, dy):
    f, true = texture(), turned(scale, degrees, dx, dy)
    first, second = view(f, np.eye(3)[:2]), view(f, true)
    second[60:120, 100:160] = view(f, turned(1, 0, -25, 13))[60:120, 100:160]  # a person who runs
    got = M.camera_motion(table(spark, rgb(first), rgb(second))).orderBy("frame_idx").collect()
    assert got[0]["affine"] == [1, 0, 0, 0, 1, 0] and got[0]["is_valid"]
    assert got[1]["is_valid"] and got[1]["confidence"] > 0.6
    corners = np.array([[0, 0, 1], [319, 0, 1], [0, 199, 1], [319, 199, 1]], float)
    assert np.abs(corners @ (np.array(got[1]["affine"]).reshape(2, 3) - true).T).max() < 1.0


def test_boxes_and_score_bar_are_no_background():
    m = M.background((100, 160), [(100, 100, 120, 140)])
    assert not m[:8].any() and m[8].all()
    assert not m[42:77, 42:67].any() and m[42:77, 68:].all() and m[78:].all()


def test_flat_frames_stand_still(spark):
    flat = np.full((60, 80, 3), 90, np.uint8)
    got = M.camera_motion(table(spark, flat, flat), table(spark, flat).selectExpr("match_id", "frame_idx", "1 x1", "1 y1", "5 x2", "9 y2")).collect()
    assert all(r["affine"] == [1, 0, 0, 0, 1, 0] and r["is_valid"] for r in got) and len(got) == 2


def test_similarity_leaves_strays_out():
    rng = np.random.default_rng(2)
    src, true = rng.uniform(0, 300, (60, 2)), turned(1.1, 3, 5, -7)
    dst = np.c_[src, np.ones(60)] @ true.T
    dst[:20] += rng.uniform(20, 60, (20, 2))
    got, share = M.similarity(src, dst)
    assert np.allclose(got, true, atol=1e-6) and share == pytest.approx(40 / 60)


def test_lines_of_a_drawn_pitch(spark):
    px = np.full((200, 400, 3), (40, 160, 60), np.uint8)
    px[40:43, 20:380] = px[170:173, 20:380] = 250
    px[40:172, 200:203] = 250
    lines = M.pitch_lines(table(spark, px, np.zeros((50, 60, 3), np.uint8)))
    got = [tuple(r) for r in lines.collect()]
    flat = sorted((y1 + y2) / 2 for _, f, x1, y1, x2, y2 in got if abs(x2 - x1) > 300)
    assert all(f == 0 for _, f, *_ in got) and min(flat) == pytest.approx(41, abs=2) and max(flat) == pytest.approx(171, abs=2)
    assert any(abs(x1 - 201) <= 2 and abs(x2 - 201) <= 2 and abs(y2 - y1) > 100 for _, _, x1, y1, x2, y2 in got)
    r = images.line_bounds(lines, 200).first()
    assert (r["top_y"], r["bottom_y"]) == (pytest.approx(41, abs=2), pytest.approx(171, abs=2))


def test_homography_with_strays():
    rng = np.random.default_rng(3)
    true = np.array([[0.1, 0.01, 3], [-0.02, 0.2, 5], [1e-4, 2e-4, 1]])
    src = rng.uniform(0, 900, (20, 2))
    p = np.c_[src, np.ones(20)] @ true.T
    dst = p[:, :2] / p[:, 2:]
    dst[:6] += rng.uniform(15, 40, (6, 2))
    h, err, ok = camera.fit_homography(src, dst)
    assert ok and np.allclose(h, true, rtol=1e-6, atol=1e-8)
    assert err == pytest.approx(np.linalg.norm(dst[:6] - (p[:, :2] / p[:, 2:])[:6], axis=1).sum() / 20)
