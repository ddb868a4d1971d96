import numpy as np
import pytest

from tessera.operators import resample
from tessera.sources import container


def image(w, h, alpha=lambda x, y: 17 * x + 11 * y):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([7 * x + y, x + 5 * y, x ^ y, alpha(x, y) + 0 * x], -1).astype(np.uint8).tobytes()


@pytest.mark.parametrize("profile", sorted(container.LEVELS))
def test_round_trip_of_profiles(profile):
    px = image(32, 24)
    assert container.unpack(container.pack(px, 32, 24, 4, profile))[1] == px


@pytest.mark.parametrize("kind", container.PREDICTORS)
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (9, 1), (5, 4)])
def test_predictors_undo(kind, size):
    plane = np.random.default_rng(3).integers(0, 256, size, dtype=np.uint8)
    res = container.residual(plane, np.pad(plane, ((1, 0), (0, 0)))[:-1], kind)
    assert (container.restore(res, kind) == plane).all()


@pytest.mark.parametrize("kind", container.TRANSFORMS)
def test_transforms_undo(kind):
    planes = list(np.random.default_rng(4).integers(0, 256, (4, 3, 5), dtype=np.uint8))
    back = container.recolour(container.recolour(planes, kind, -1), kind, 1)
    assert all((a == b).all() for a, b in zip(planes, back, strict=True))


@pytest.mark.parametrize(("alpha", "mode", "streams"), [(lambda x, y: 255, "Opaque255", 3), (lambda x, y: 0, "Transparent0", 3), (lambda x, y: x % 2 * 255, "Mask1Bit", 4), (lambda x, y: x + y, "Normal", 4)])
def test_alpha_modes(alpha, mode, streams):
    px = image(9, 3, alpha)
    head, back = container.unpack(container.pack(px, 9, 3, meta=b"m"))
    assert (head["alpha"], len(head["streams"]), head["meta"], back) == (mode, streams, b"m", px)


def test_three_channels_drop_alpha():
    head, back = container.unpack(container.pack(image(3, 2), 3, 2, 3))
    assert head["channels"] == 3 and len(head["streams"]) == 3 and set(back[3::4]) == {255}


def test_bad_files():
    good = container.pack(image(8, 8), 8, 8)
    for bad in (b"", good[:10], good[:-1], b"X" + good[1:], good[:4] + b"\x09" + good[5:], good + b"x"):
        with pytest.raises(ValueError):
            container.parse(bad)
    assert container.parse(good + b"x", strict=False)["width"] == 8


@pytest.mark.parametrize(("row", "dst", "radius", "want"), [([255] * 8, 4, 4, [254] * 4), (range(0, 80, 10), 4, 4, [3, 24, 45, 66]), ([0, 10, 20, 30], 2, 2, [4, 25]), (range(0, 160, 10), 8, 8, [3, 23, 44, 64, 85, 105, 126, 146])])
def test_resample(row, dst, radius, want):
    assert resample.resample(np.array(list(row), dtype=np.uint8), dst, radius * resample.ONE).tolist() == want


def test_taps_and_identity():
    assert [len(t) for t in resample.kernel(8, 4, 4 * resample.ONE)] == [5, 7, 7, 5]
    px = np.frombuffer(image(6, 5), dtype=np.uint8).reshape(5, 6, 4)
    assert (resample.resize_pixels(px, 6, 5, resample.ONE) == px).all()


def test_greedy():
    edge = np.array([[0], [8], [16], [200]])
    # The last largest item comes first; the far item is reached as the lowest unused one.
    assert resample.greedy(edge, edge, [0, 1, 2, 25], [0, 1, 2, 25], [5, 9, 9, 1]) == [2, 1, 0, 3]
    assert resample.greedy(edge[:0], edge[:0], [], [], []) == []


def test_inspect_and_decode_say_what_is_wrong(spark):
    files = spark.createDataFrame([(1, bytearray(container.pack(image(4, 4), 4, 4))), (2, bytearray(b"no")), (3, None)], "image_id long, content binary")
    assert {r["image_id"]: r["error"] for r in container.inspect(files).collect()} == {1: None, 2: "not a container", 3: "not a container"}
    assert {r["image_id"]: r["width"] for r in container.decode(files).collect()} == {1: 4, 2: None, 3: None}


@pytest.mark.parametrize("kind", [None, "Paeth", "Up", "Delta", "None"])
@pytest.mark.parametrize("alpha", ["Normal", "Mask1Bit", "Opaque255", "Transparent0"])
def test_strips_like_the_whole(kind, alpha, monkeypatch):
    rng = np.random.default_rng(5)
    px = np.add.outer(np.arange(37) * 3, np.arange(11) * 7)[..., None].repeat(4, 2).astype(np.uint8) + rng.integers(0, 9, (37, 11, 4), dtype=np.uint8)
    px[..., 3] = {"Normal": px[..., 3], "Mask1Bit": px[..., 3] % 2 * 255, "Opaque255": 255, "Transparent0": 0}[alpha]
    want = container.parse(container.pack(px.tobytes(), 11, 37, predictor=kind))
    monkeypatch.setattr(container, "STRIP", 1)
    most = 0

    def rows(y, end):
        nonlocal most
        most = max(most, end - y) if y or end < 37 else most
        return px[y:end]

    data = container.pack_rows(rows, 11, 37, predictor=kind)
    head = container.parse(data)
    same = ("alpha", "transform", "qval")
    assert [head[k] for k in same] == [want[k] for k in same] and [s["predictor"] for s in head["streams"]] == [s["predictor"] for s in want["streams"]]
    assert container.unpack(data)[1] == px.tobytes() and head["alpha"] == alpha and most == 8
    assert b"".join(p.tobytes() for _, p in container.strips(head, data)) == px.tobytes()
