"""The JPEG operator against another encoder and decoder (Java's), and as columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygraph.llm import media
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def java(spark):
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    if jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").hasNext() is not True:
        pytest.skip("this Java has no image codecs")
    return jvm


def java_decode(jvm, data):
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    w, h = image.getWidth(), image.getHeight()
    if image.getRaster().getNumBands() == 1:  # samples as stored; getRGB would apply a gray profile
        gray = np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)], np.int64)
        return np.stack([gray] * 3, -1)
    rgb = np.array([[image.getRGB(x, y) for x in range(w)] for y in range(h)], np.int64) & 0xFFFFFF
    return np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], -1)


def java_encode(jvm, rgb, gray, quality):
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = rgb[y, x].tolist()
            image.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def scene(h, w):
    """A smooth scene with an edge in brightness."""
    y, x = np.mgrid[:h, :w]
    out = np.stack([60 + 2 * x, 90 + 1.5 * y, 160 - x - 0.5 * y], -1)
    out[y > x] *= 0.6
    return np.clip(out, 0, 255).astype(np.int64)


@pytest.mark.parametrize("gray, quality", [(True, 0.95), (True, 0.5), (False, 0.95), (False, 0.6)])
@pytest.mark.parametrize("shape", [(16, 16), (37, 29), (8, 64)])
def test_files_of_another_encoder(java, gray, quality, shape):
    data = java_encode(java, scene(*shape), gray, quality)
    assert b"\xff\xc2" in data  # progressive
    (mine,) = media.decode([data])
    theirs = java_decode(java, data)
    assert mine.shape == theirs.shape == (*shape, 3)
    off = np.abs(mine.astype(int) - theirs)
    assert off.max() <= 2 if gray else off.mean() < 2.5  # chroma is repeated here and interpolated there


def test_own_files_in_another_decoder(java):
    rng = np.random.default_rng(3)
    flat = np.full(64 * 24, 128)
    flat[::64] += rng.integers(-60, 60, 24)  # DC alone: flat blocks
    (data,) = media.encode([flat.astype(np.uint8).tobytes()])
    (mine,) = media.decode([data])
    theirs = java_decode(java, data)
    assert mine.shape == theirs.shape and np.abs(mine.astype(int) - theirs).mean() < 2.5


def test_media_and_tensor_columns(spark, docs):
    stored = media.media(docs.withColumn("media", F.lit("a column of this name")))
    rows = {r.doc_id: r for r in stored.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} and stored.columns == ["doc_id", "n_bytes", "media"]
    want = {r.doc_id: r for r in media.digests(docs).collect()}
    for i, r in rows.items():
        assert hashlib.sha256(r.media).hexdigest() == want[i].media_sha256 and r.n_bytes == len((TEXTS[i] or "").encode())
        assert media._decode([bytes(r.media)])[0][1].rstrip(b"\0") == (TEXTS[i] or "").encode().rstrip(b"\0")
    null = spark.createDataFrame([(99, None)], "doc_id long, media binary")
    out = {r.doc_id: r for r in media.tensors(stored.select("doc_id", "media").unionByName(null)).collect()}
    assert set(out) == set(rows)
    for i, r in out.items():
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert media.feature(rgb) == want[i].feature
    with pytest.raises(Exception):
        media.tensors(spark.createDataFrame([(1, bytearray(b"damaged"))], "doc_id long, media binary")).collect()
