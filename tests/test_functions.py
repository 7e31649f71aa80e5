import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakite.functions import camera, geo, se3
from terrakite.functions import rects as rc
from terrakite.functions.rects import Rect

EXTRINSICS = [0.5164972543716431, -0.021958883851766586, 0.8560072779655457, 0.0, 0.09486261755228043, 0.9949849843978882, -0.03171413019299507, 0.0, -0.8510180115699768, 0.0975833460688591, 0.515990138053894, 0.0, -0.04407598823308945, 0.009304665960371494, -0.17797423899173737, 0.9999998807907104]
FOCAL, CX, CY = 1594.7247314453125, 952.8605346679688, 714.1676025390625


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit(v):
    return F.array(*[F.lit(float(x)) for x in v])


def rigid(seed):
    rng = np.random.default_rng(seed)
    return se3.rigid_np(se3.rotation_np(rng.normal(size=3)), rng.normal(size=3) * 5)


def flat(m):
    return m.ravel(order="F").tolist()


@pytest.mark.parametrize("pos,want", [((52.247041, 10.575830), (0, 0)), ((52.248091, 10.57417), (-113.3742031902, 116.8369533306)), ((52.251011, 10.573568), (-154.4792838235449, 441.75256808963206))])
def test_to_cartesian(spark, pos, want):
    ref = (52.247041, 10.575830)
    got = one(spark, *geo.to_cartesian(*(F.lit(v) for v in (*ref, *pos))))
    assert got == pytest.approx(want, abs=2e-9)
    assert [float(v) for v in geo.to_cartesian_np(*ref, *pos)] == pytest.approx(want, abs=2e-9)


def test_to_cartesian_out_of_range_and_equator(spark):
    assert one(spark, *geo.to_cartesian(*(F.lit(v) for v in (0.0, 0.0, 91.0, 0.0)))) == [0, 0]
    e, n = one(spark, *geo.to_cartesian(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0))))
    assert e == pytest.approx(geo.EQUATOR_M * math.radians(1)) and n == 0


@pytest.mark.parametrize("xy,want", [((0.0, 0.0), (52.247041, 10.575830)), ((-154.48, 441.75), (52.251010999421212, 10.573567988057384)), ((-208.57, 431.07), (52.250915018701789, 10.572775969079652))])
def test_from_cartesian(spark, xy, want):
    got = one(spark, geo.from_cartesian(*(F.lit(v) for v in (52.247041, 10.575830, *xy))))[0]
    assert (got.lat, got.lon) == pytest.approx(want, abs=1e-9)


def test_degree_scaling():
    assert geo.degree_scaling(37.5115669, 139.9316399) == pytest.approx([110971.43615563288, 88403.384964667377, 1], rel=1e-7)


@pytest.mark.parametrize("uvd,want", [((300.0, 600.0, 3.0), (1.8950091973238727, -0.04278100611330371, -2.7840722741000694)), ((368.6075439453125, 612.209228515625, 3.9), (2.5605623834723801, -0.0917997598473122, -3.4213304361981178))])
def test_project_to_world(spark, uvd, want):
    got = one(spark, *camera.project_to_world(lit(EXTRINSICS), F.lit(FOCAL), F.lit(CX), F.lit(CY), *map(F.lit, uvd)))
    assert got == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("xyz,want", [((2.2181900615833667, -0.0514619514589163, -3.2184219466181245), (300, 600)), ((3.0, 0.5, -3.0), (612.209228515625, 368.6075439453125))])
def test_project_to_image(spark, xyz, want):
    assert one(spark, *camera.project_to_image(lit(EXTRINSICS), F.lit(FOCAL), F.lit(CX), F.lit(CY), *map(F.lit, xyz))) == pytest.approx(want, abs=1e-2)


def test_octaves_and_pair_ids(spark):
    code = 255 | (2 << 8) | (77 << 16)
    assert one(spark, *camera.octave_parts(F.lit(code))) == [-1, 2, 77, 2.0]
    assert one(spark, camera.pixel_information(F.lit(0)), camera.pixel_information(F.lit(20))) == pytest.approx([4.0, 0.1])
    assert one(spark, camera.pair_id(F.lit(3), F.lit(2)), camera.pair_id(F.lit(2), F.lit(3))) == [2 * 2147483647 + 3] * 2
    assert one(spark, camera.full_resolution(F.lit(3.0), F.lit(-1)), camera.octave_space(F.lit(3.0), F.lit(1))) == [1.5, 1.5]


def test_rects(spark):
    a, b, apart = Rect.of(0, 0, 4, 4), Rect.of(4, 2, 6, 3), Rect.of(9, 9, 10, 10)
    assert one(spark, rc.intersects(a, b), rc.intersects(a, apart), rc.inside(Rect.of(1, 1, 2, 2), a), rc.inside(a, a)) == [True, False, True, False]
    assert one(spark, rc.overlap(a, b), rc.overlap(a, apart), rc.overlap(a, Rect.of(1, 6, 2, 7)), rc.area(Rect.of(4, 0, 0, 2))) == [0, 25, -2, -8]
    assert one(spark, rc.pretty(Rect.of(1, 2, 3, 4)), *rc.union_box(a, b)) == ["( 1.0, 2.0 ) - ( 3.0, 4.0 )", 0, 0, 6, 4]
    assert one(spark, *Rect.centred(F.lit(5.0), F.lit(6.0), F.lit(2.0), F.lit(4.0))) == [4, 4, 6, 8]


@pytest.mark.parametrize("seed", range(4))
def test_transforms_agree_with_numpy(spark, seed):
    a, b = rigid(seed), rigid(seed + 50)
    la, lb = lit(flat(a)), lit(flat(b))
    got = one(spark, se3.multiply(la, lb), se3.invert_rigid(la), se3.flip_camera(la), se3.unflip_camera(se3.flip_camera(la)), se3.relative_pose(la, lb), se3.transpose(la))
    want = [a @ b, se3.inverse_np(a), se3.flip_np(a), a, b @ se3.inverse_np(a), a.T]
    for g, w in zip(got, want):
        assert np.array(g).reshape(4, 4, order="F") == pytest.approx(w, abs=1e-12)
    q = se3.quaternion_np(a[:3, :3])
    wxyz = one(spark, *se3.quaternion_from_rotation(se3.rotation(la)))
    assert np.array(wxyz) * np.sign(wxyz[0]) == pytest.approx(q, abs=1e-9)
    back = one(spark, se3.compose(se3.rotation_from_quaternion(*map(F.lit, map(float, q * 3))), se3.position(la)))[0]
    assert np.array(back).reshape(4, 4, order="F") == pytest.approx(a, abs=1e-9)
    v = se3.axis_angle_np(a[:3, :3])
    turn = one(spark, se3.compose(se3.rotation_from_axis_angle(*map(F.lit, map(float, v))), se3.position(la)))[0]
    assert np.array(turn).reshape(4, 4, order="F") == pytest.approx(a, abs=1e-9)


def test_valid_transform(spark):
    m = rigid(3)
    skewed, scaled, flipped = m.copy(), m.copy(), m @ np.diag([1, 1, -1, 1])
    skewed[3, 0], scaled[:3, :3] = 1e-3, m[:3, :3] * 1.01
    got = one(spark, *[se3.valid_transform(lit(flat(x))) for x in (m, flipped, skewed, scaled)], se3.valid_transform(F.lit(None).cast("array<double>")), se3.valid_transform(lit([1.0] * 3)))
    assert got == [True, True, False, False, False, False]
    assert [se3.valid_np(x) for x in (m, flipped, skewed, scaled)] == got[:4]
    assert one(spark, se3.nearly_equal(lit([1, 2]), lit([1, 2 + 1e-8])), se3.nearly_equal(lit([1, 2]), lit([1, 2.1]))) == [True, False]


def test_interpolation_and_small_angles():
    a, b = rigid(1), rigid(2)
    assert se3.interpolate_np(a, b, -1) == pytest.approx(a) and se3.interpolate_np(a, b, 2) == pytest.approx(b, abs=1e-9)
    half = se3.interpolate_np(a, b, 0.5)
    assert np.linalg.norm(se3.axis_angle_np(half[:3, :3].T @ b[:3, :3])) == pytest.approx(np.linalg.norm(se3.axis_angle_np(a[:3, :3].T @ b[:3, :3])) / 2)
    assert se3.rotation_np(np.full(3, 1e-12)) == pytest.approx(np.eye(3))
    assert np.abs(se3.axis_angle_np(se3.rotation_np([np.pi, 0, 0]))) == pytest.approx([np.pi, 0, 0], abs=1e-6)
    assert se3.pose_matrix(se3.pose_vector(a)) == pytest.approx(a, abs=1e-9)


def test_sfm_pose(spark):
    got = np.array(one(spark, se3.sfm_pose(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0))))[0]).reshape(4, 4, order="F")
    assert got[:3, 3] == pytest.approx([-1, 2, 3]) and got[:3, :3] == pytest.approx(np.eye(3))


def test_depth_maps():
    w, h = 8, 6
    depth = np.full((h, w), 2.0, np.float32)
    pfm = b"Pf\n8 6\n-1.0\n" + depth[::-1].astype("<f4").tobytes()
    assert camera.read_pfm(pfm) == pytest.approx(depth)
    d, c = camera.saved_depth(np.array([[1.0, 1.0, 1.0]]), np.array([[0.0, 1.0, 2.0]]))
    assert d.tolist() == [[5, 1, 1]] and c.tolist() == [[0, 1, 100]]
    ramp = np.tile(np.arange(w, dtype=float), (h, 1))
    assert camera.sample_bilinear(ramp, [10, 1000], [0, 1000], 16, 12) == pytest.approx([5, 7])
    assert camera.surface_normals(depth, 100.0, np.eye(4), [4, 99], [3, 99], 8, 6) == pytest.approx(np.tile([0, 0, 1.0], (2, 1)))
