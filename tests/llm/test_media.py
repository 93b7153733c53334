"""The media column: an outside decoder, plain transforms, and batches."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gazetta.llm import media


def payload(n, seed=1):
    r = random.Random(seed)
    return media.padded("".join(r.choice(["the ", "word", "  ", " " * 40, "é", "\n", "Zz9", "中文"]) for _ in range(n)).encode())


def plain_tensor(image):
    """One block after the other: dequantise, inverse transform by its sum, repeat chroma, convert."""
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    planes = []
    for part in image.components.values():
        plane = np.zeros((part.high * 8, part.wide * 8))
        for k, values in enumerate(part.values):
            block = np.zeros(64)
            block[media.zigzag()] = values * image.quantisers[part.table]
            y, x = divmod(k, part.wide)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = c.T @ block.reshape(8, 8) @ c
        planes.append(plane)
    out = np.zeros((image.height, image.width, 3))
    for y in range(image.height):
        for x in range(image.width):
            lum, cb, cr = planes[0][y, x] + 128, planes[1][y // 2, x // 2], planes[2][y // 2, x // 2]
            out[y, x] = lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def test_tensor_and_feature_by_plain_sums():
    image = media.read(media.write(payload(700)))
    want = plain_tensor(image)
    rgb = np.concatenate(list(media.strips(image)))
    assert (rgb == want).all() and rgb.shape == (image.height, image.width, 3)
    flat = want.reshape(-1, 3).astype(float)
    mean = [sum(flat[:, k]) / len(flat) for k in range(3)]
    spread = [np.sqrt(sum((flat[:, k] - mean[k]) ** 2) / len(flat)) for k in range(3)]
    said = media.feature_of(rgb).replace("mean", "").replace("std", "").split()
    assert said[0] == f"{image.width}x{image.height}"
    assert np.allclose([float(x) for x in said[1:]], [*mean, *spread], atol=6e-4)


def agrees_with_the_jvm(spark, data):
    """The JVM's own JPEG reader; its chroma is interpolated, so luma is compared, where nothing is clipped."""
    ours = np.concatenate(list(media.strips(media.read(data)))).astype(float)
    jvm = spark.sparkContext._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    wide, high = picture.getWidth(), picture.getHeight()
    assert (high, wide) == ours.shape[:2]
    buffer = picture.getRGB(0, 0, wide, high, None, 0, wide)
    values = np.array(list(buffer), np.int64).reshape(high, wide)
    theirs = np.stack([values >> 16 & 255, values >> 8 & 255, values & 255], axis=2).astype(float)
    free = ((ours > 0) & (ours < 255) & (theirs > 0) & (theirs < 255)).all(2)
    weights = np.array([0.299, 0.587, 0.114])
    assert free.mean() > 0.5 and np.abs(ours @ weights - theirs @ weights)[free].max() < 4


@pytest.mark.parametrize("n", [0, 40, 3000])
def test_an_outside_decoder_reads_the_files(spark, n):
    agrees_with_the_jvm(spark, media.write(payload(n)))


@pytest.mark.parametrize(("wide", "high"), [(83, 61), (16, 16), (7, 120)])
def test_files_of_an_outside_encoder(spark, wide, high):
    """Its tables differ between scans; flat parts make end-of-band runs, noise large numbers, and it refines twice."""
    r = np.random.default_rng(wide)
    y, x = np.mgrid[:high, :wide]
    gray = 60 + x + y / 2
    gray[high // 2 :] = 128
    gray[:, wide // 2 : wide // 2 + 9] += r.integers(-50, 50, (high, len(range(wide)[wide // 2 : wide // 2 + 9])))
    pixels = np.clip(np.stack([gray, gray * 0.9, gray * 0.8 + 20], axis=2), 20, 235).astype(np.uint8)
    rows = b"".join(row.tobytes() + b"\0" * (-3 * wide % 4) for row in pixels[::-1])
    bmp = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, wide, high, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    jvm = spark.sparkContext._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(bmp)))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    stream.close()
    data = bytes(out.toByteArray())
    _, scans = media._parse(data)
    assert len(scans) > 6 and any(h[-1] >> 4 and h[-3] for h, _, _, _ in scans)
    agrees_with_the_jvm(spark, data)


def test_tables_and_scans_are_real():
    dc, ac, _ = media._tables()
    assert len(ac.codes) == 16 * 7 + 2 and len(dc.codes) > 8 and len({n for n, _ in ac.codes}) > 4
    _, scans = media._parse(media.write(payload(3000)))
    assert [(h[-3], h[-2], h[-1]) for h, _, _, _ in scans] == [(0, 0, 1), (0, 0, 16), *[(1, 15, 1), (16, 48, 1)] * 3, *[(1, 48, 16)] * 3]
    assert any(b"\xff\xd0" in data for _, data, _, _ in scans)
    means = media.read(media.write(payload(3000))).components[1].values[:, 0]
    assert len(np.unique(means)) > 20
    assert len(media.write(payload(4000))) < 1.2 * len(payload(4000))


def test_batches_change_nothing():
    some = [payload(n, n) for n in (0, 1, 7, 300, 2500, 2, 90)]
    files = media.write_all(some)
    assert files == [media.write(p) for p in some]
    assert [media.payload_of(i) for i in media.read_all(files)] == some
    raw = random.Random(4).randbytes(576 * 40)
    assert media.payload_of(media.read(media.write(raw))) == raw
    assert media.payload_of(media.read(media.write(b" " * 5760))) == b" " * 5760


def test_damaged_files_are_errors():
    data = bytearray(media.write(payload(400)))
    at = data.index(b"\xff\xda") + 14
    data[at + 3] ^= 0x55
    with pytest.raises(ValueError):
        media.payload_of(media.read(bytes(data)))


def test_media_columns(spark):
    texts = [(1, "the quick é"), (2, None), (3, ""), (4, "x" * 30_000), (5, "the quick é")]
    stored = media.to_media(spark.createDataFrame(texts, "doc_id long, text string").repartition(2))
    found = media.from_media(stored.unionByName(spark.createDataFrame([(9, 0, None)], "doc_id long, n_bytes long, media binary"))).collect()
    by = {r.doc_id: r for r in found}
    assert by[9].rgb is None and by[9].payload is None and by[2][1:] == by[3][1:] and by[1][1:] == by[5][1:]
    for i, t in texts:
        assert bytes(by[i].payload) == media.padded((t or "").encode()) and len(by[i].rgb) == by[i].height * by[i].width * 3
        assert bytes(by[i].rgb) == media.tensor(bytes(by[i].media)).tobytes()
    digest = {r.doc_id: r for r in media.media_digest(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        p, r = media.padded((t or "").encode()), digest[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(bytes(by[i].media)).hexdigest() and r.media_bytes == len(by[i].media)
        assert r.rgb_sha256 == hashlib.sha256(bytes(by[i].rgb)).hexdigest() and r.feature == by[i].feature
