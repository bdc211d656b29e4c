import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curato.functions import pixels
from curato.operators import duplicates, pictures
from curato.plans import pictures as picture_plans
from curato.sources.pictures import image_metrics, normalise, read_pictures

RNG = np.random.default_rng(4)


def _exif(orientation):
    return b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, orientation, 0) + bytes(4)


def _profile(gamma=2.2, columns=((0.4360, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7139))):
    """A colour profile of one gamma and a matrix."""
    curve = b"curv" + bytes(4) + struct.pack(">IH", 1, round(gamma * 256)) + bytes(2)
    tags = [(n, curve) for n in (b"rTRC", b"gTRC", b"bTRC")] + [(n, b"XYZ " + bytes(4) + struct.pack(">3i", *(round(v * 65536) for v in c))) for n, c in zip((b"rXYZ", b"gXYZ", b"bXYZ"), columns)]
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, data in tags:
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    head = bytearray(128)
    head[16:20], head[36:40] = b"RGB ", b"acsp"
    return bytes(head) + struct.pack(">I", len(tags)) + table + body


def _png(picture, **chunks):
    extra = [(k.encode(), v) for k, v in chunks.items()]
    return pixels.write_png(picture, tuple(extra))


def _decode(png):
    """The pixels of a PNG as the library writes it."""
    width, height, _, kind = struct.unpack(">IIBB", png[16:26])
    at, data = 8, b""
    while at < len(png):
        size, name = struct.unpack(">I4s", png[at : at + 8])
        data += png[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += 12 + size
    n = {0: 1, 2: 3, 6: 4}[kind]
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)[:, 1:].reshape(height, width, n)


def _jpeg(spark, path, picture):
    """Writes a JPEG by the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(picture.shape[1], picture.shape[0], 1)
    for y, line in enumerate(picture.tolist()):
        for x, (r, g, b) in enumerate(line):
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def _by_name(rows):
    return {r.path.rsplit("/", 1)[-1]: r for r in rows.collect()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pictures")
    base = RNG.integers(0, 256, (6, 9, 3), np.uint8)
    for i in range(1, 9):
        (at / f"turned{i}.png").write_bytes(_png(base, eXIf=_exif(i)))
    clear = np.concatenate((base, np.full((6, 9, 1), 255, np.uint8)), axis=2)
    clear[0, :, 3] = 0
    clear[1, :, 3] = 100
    (at / "alpha.png").write_bytes(_png(clear))
    (at / "gray.png").write_bytes(_png(base[:, :, :1]))
    (at / "colour.png").write_bytes(_png(base, iCCP=b"p\0\0" + zlib.compress(_profile(1.8))))
    (at / "odd.png").write_bytes(_png(base, iCCP=b"p\0\0" + zlib.compress(b"no profile")))
    (at / "moving.png").write_bytes(_png(base, acTL=struct.pack(">II", 2, 0)))
    (at / "still.png").write_bytes(_png(base, acTL=struct.pack(">II", 1, 0)))
    (at / "moving.webp").write_bytes(b"RIFF" + struct.pack("<I", 20) + b"WEBPANIM" + struct.pack("<I", 6) + bytes(6))
    (at / "broken.jpg").write_bytes(b"\xff\xd8\xff not a picture")
    smooth = np.add.outer(np.arange(40) * 3, np.arange(24) * 2)[..., None] + np.array([0, 30, 60])
    _jpeg(spark, at / "photo.jpg", smooth.astype(np.uint8))
    jpeg = (at / "photo.jpg").read_bytes()
    notes = b"Exif\0\0" + _exif(6)
    (at / "sideways.jpg").write_bytes(jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(notes) + 2) + notes + jpeg[2:])
    (at / "note.txt").write_bytes(b"x")
    return at, base, clear, smooth


def test_each_orientation_is_turned_upright(spark, folder):
    at, base, _, smooth = folder
    found = _by_name(normalise(read_pictures(spark, [str(at)])))
    right = {1: base, 2: base[:, ::-1], 3: base[::-1, ::-1], 4: base[::-1], 5: base.swapaxes(0, 1), 6: np.rot90(base, -1), 7: np.rot90(base[:, ::-1], -1), 8: np.rot90(base, 1)}
    for i, want in right.items():
        row = found[f"turned{i}.png"]
        assert np.array_equal(_decode(bytes(row.png)), want), i
        assert (row.width, row.height, row.exif_transposed) == (want.shape[1], want.shape[0], i != 1)
        assert row.error is None and row.assumed_srgb and not row.warnings
    photo, turned = _decode(bytes(found["photo.jpg"].png)), _decode(bytes(found["sideways.jpg"].png))
    assert np.array_equal(turned, np.rot90(photo, -1)) and np.abs(photo.astype(int) - smooth).mean() < 4


def test_alpha_profiles_and_rejected_files(spark, folder):
    at, base, clear, _ = folder
    found = _by_name(normalise(read_pictures(spark, [str(at)])))
    assert "note.txt" not in found and len(found) == 18
    laid = _decode(bytes(found["alpha.png"].png))
    assert (laid[0] == 127).all() and np.array_equal(laid[2:], base[2:])
    assert np.abs(laid[1].astype(float) - (base[1] * (100 / 255) + 127 * (155 / 255))).max() <= 0.51
    assert found["alpha.png"].alpha_present and found["alpha.png"].alpha_fraction == pytest.approx(2 / 6) and len(found["alpha.png"].warnings) == 1
    assert np.array_equal(_decode(bytes(found["gray.png"].png)), np.repeat(base[:, :, :1], 3, axis=2))
    assert found["colour.png"].icc_converted_to_srgb and not found["colour.png"].assumed_srgb
    assert found["odd.png"].icc_profile_present and found["odd.png"].assumed_srgb and "profile" in found["odd.png"].warnings[0]
    assert np.array_equal(_decode(bytes(found["odd.png"].png)), base)
    assert {n: r.error for n, r in found.items() if r.error} == {"moving.png": "animated_image", "moving.webp": "animated_image", "broken.jpg": "unreadable"}
    assert all(r.png is None and r.sha256 is None for r in found.values() if r.error)
    metrics = _by_name(image_metrics(read_pictures(spark, [str(at)])))
    assert (metrics["turned5.png"].width, metrics["turned5.png"].height) == (6, 9) and metrics["moving.png"].luminance_mean is None
    assert metrics["alpha.png"].alpha_fraction == pytest.approx(2 / 6) and metrics["moving.png"].error == "animated_image"


def test_profiles_by_a_plain_rule():
    picture = RNG.integers(0, 256, (5, 4, 3), np.uint8)
    plain = ((picture / 255) ** 1.8)
    want = np.where(plain <= 0.0031308, 12.92 * plain, 1.055 * plain ** (1 / 2.4) - 0.055) * 255
    # The primaries of sRGB itself: only the curve changes.
    assert np.abs(pixels.to_srgb(picture, _profile(1.8)).astype(float) - want).max() < 2
    para = b"para" + bytes(4) + struct.pack(">HH5i", 3, 0, *(round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
    assert np.abs(pixels._curve(para) - np.where(np.arange(256) / 255 >= 0.04045, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4, np.arange(256) / 255 / 12.92)).max() < 1e-4
    table = b"curv" + bytes(4) + struct.pack(">I3H", 3, 0, 16384, 65535)
    assert pixels._curve(table)[0] == 0 and pixels._curve(table)[255] == 1 and pixels._curve(table)[128] == pytest.approx(0.25, abs=0.01)
    for bad in (b"", b"x" * 200, _profile()[:150]):
        with pytest.raises(ValueError):
            pixels.to_srgb(picture, bad)


def plain_resize(picture, width, height, kernel, reach):
    """One pixel at a time, across and then down."""

    def line(values, size):
        scale = len(values) / size
        wide, out = max(scale, 1), []
        for i in range(size):
            c = (i + 0.5) * scale
            own = range(max(0, int(c - reach * wide + 0.5)), min(len(values), int(c + reach * wide + 0.5)))
            w = [kernel((j - c + 0.5) / wide) for j in own]
            whole = [int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, (sum(x * int(values[j]) for x, j in zip(whole, own)) + 2**21) >> 22)))
        return out

    across = [line(row, width) for row in picture.tolist()]
    return np.array([line(column, height) for column in zip(*across)]).T


def _cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def test_resizing_equals_a_plain_version():
    sinc = lambda x: np.sinc(x) * np.sinc(x / 3) if abs(x) < 3 else 0.0
    for shape in ((50, 41), (20, 64), (7, 5)):
        picture = RNG.integers(0, 256, shape, np.uint8)
        for kind, kernel, reach in (("bicubic", _cubic, 2), ("lanczos", sinc, 3)):
            want = plain_resize(picture, 32, 16, kernel, reach)
            assert np.array_equal(pixels.resize(picture[..., None], 32, 16, kind)[..., 0], want), (shape, kind)


def plain_descriptor(picture):
    rgb = np.array([[[v / 255 for v in p] for p in row] for row in picture.tolist()])
    shares = [sum(1 for row in rgb for p in row if min(15, int(p[c] * 16)) == b) for c in range(3) for b in range(16)]
    gray = rgb.sum(axis=2) / 3
    across = [np.mean([abs(row[x + 1] - row[x]) for x in range(31)]) for row in gray]
    down = [np.mean([abs(gray[y + 1][x] - gray[y][x]) for y in range(31)]) for x in range(32)]
    single = picture.astype(np.float32) / np.float32(255)
    cut = np.asarray(single.mean(axis=2) * 255, np.uint8)
    layout = plain_resize(cut, 8, 8, _cubic, 2).ravel()
    stats = [*(rgb[:, :, c].mean() for c in range(3)), *(rgb[:, :, c].std() for c in range(3)), gray.mean(), gray.std()]
    found = np.array([*shares, *across, *down, *layout, *stats], float)
    return found / np.linalg.norm(found)


def test_descriptors_equal_a_plain_version():
    many = RNG.integers(0, 256, (5, 32, 32, 3), np.uint8)
    many[1] = 77
    found = pixels.descriptors(many)
    assert found.shape == (5, pixels.DESCRIPTOR)
    for picture, own in zip(many, found):
        assert np.abs(own - plain_descriptor(picture)).max() < 1e-6


def test_hashes_equal_a_plain_transform():
    for picture in RNG.integers(0, 256, (4, 32, 32), np.uint8):
        x = np.arange(32)
        low = np.array([[sum(picture[a, b] * np.cos(np.pi * i * (2 * a + 1) / 64) * np.cos(np.pi * j * (2 * b + 1) / 64) for a in x for b in x) for j in range(8)] for i in range(8)])
        bits = (low > np.median(low)).ravel()
        want = sum(int(b) << (63 - i) for i, b in enumerate(bits))
        assert int(pixels.perceptual_hashes(picture[None])[0]) & (2**64 - 1) == want


def test_hashes_of_a_table_feed_near_pairs(spark, folder):
    at, *_ = folder
    rows = []
    for i in range(12):
        base = np.kron(RNG.integers(0, 256, (8, 8, 3)), np.ones((12, 15, 1))).astype(np.uint8)
        noisy = np.clip(base + RNG.normal(0, 3, base.shape), 0, 255).astype(np.uint8)
        small = pixels.resize(base, 60, 48)
        rows += [(3 * i + j, p.shape[1], p.shape[0], 3, bytearray(p.tobytes()), None) for j, p in enumerate((base, noisy, small))]
    rows += [(100, None, None, None, None, None), (101, 0, 0, 3, bytearray(), 1)]
    table = spark.createDataFrame(rows, "id long, width int, height int, channels int, data binary, orientation int")
    hashed = table.select("id", pictures.perceptual_hash().alias("h"), F.size(pictures.descriptor()).alias("d"), F.size(pictures.tiny_embedding()).alias("e")).cache()
    assert {(r.d, r.e) for r in hashed.where("id < 100").collect()} == {(184, 192)}
    assert hashed.where("h is null").count() == 2
    found = duplicates.cluster_pairs(duplicates.hamming_pairs(hashed.where("h is not null"), "id", "h", 8)).collect()
    assert {(r.node, r.label) for r in found} == {(i, i - i % 3) for i in range(36)}


def test_tiny_embeddings():
    flat, other = np.full((8, 8, 3), 9, np.uint8), RNG.integers(0, 256, (8, 8, 3), np.uint8)
    found = pixels.tiny_embeddings(np.stack((flat, other)))
    assert found[0, 0] == 1 and np.abs(found[0]).sum() == 1
    want = other.reshape(-1) / 255 - (other / 255).mean()
    assert np.abs(found[1] - want / np.linalg.norm(want)).max() < 1e-12


def test_no_pictures(spark, tmp_path):
    (tmp_path / "note.txt").write_bytes(b"x")
    assert normalise(read_pictures(spark, [str(tmp_path)])).count() == 0


def test_embedding_pictures_are_dealt_and_drawn_in_tasks(spark, tmp_path):
    vectors = [[((i * 37 + k * 11) % 41 - 20) / 40 for k in range(64)] for i in range(3)] + [[0.1] * 10, [None] + [0.2] * 63, None]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    made = picture_plans.embedding_pictures(spark, str(tmp_path), 2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # One file is one task's unless its rows are dealt; pixels aren't made one by one in an expression.
    assert "hashpartitioning(vec_id" in plan and "transform(sequence" not in plan
    found = {r.vec_id: bytes(r.data) for r in made.collect()}
    assert sorted(found) == list(range(12))
    for i, vector in enumerate(vectors):
        for copy in (0, 1):
            for at, pixel in enumerate(found[2 * i + copy]):
                c, x, y = at % 3, at // 3 % 32, at // 96
                a, b = y // 4, x // 4
                place = (a * 8 + b, 63 - a * 8 - b, b * 8 + a)[c]
                v = vector[place] if vector and place < len(vector) else None
                want = 255 if v is None else max(0, min(255, math.floor(127.5 + 400 * float(np.float32(v))) + (x * (c + 2) + y * 3) % 32 - 16 + copy * (x % 3) * 4))
                assert pixel == want
