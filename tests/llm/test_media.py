"""Progressive JPEG: exact round trips, other scan orders and sampling, and edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from swathgrid.llm import media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=900) | st.text(max_size=300).map(str.encode), min_size=1, max_size=6))
def test_round_trip(texts):
    payloads = [media.padded(t) for t in texts]
    assert all(len(p) % 192 == 0 and p and p.startswith(t) and not p[len(t) :].strip(b" ") for p, t in zip(payloads, texts, strict=True))
    pics = media.read_jpegs(stored := media.store(payloads))
    assert [media.restore(p) for p in pics] == payloads
    assert [media.store([p])[0] for p in payloads] == stored  # no picture depends on its neighbours


def test_near_zero_bytes_and_long_runs():
    rng = np.random.default_rng(0)
    for data in (b"\x80" * 200_000, bytes(rng.integers(127, 130, 60_000).astype(np.uint8)), bytes(rng.choice([128, 128, 128, 129, 60], 30_000).astype(np.uint8))):
        p = media.padded(data)
        assert media.restore(media.read_jpegs(media.store([p]))[0]) == p


def test_zigzag_and_inverse_transform():
    assert media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(media.ZIGZAG) == list(range(64))
    rng = np.random.default_rng(1)
    rows, cols = np.array([2]), np.array([3])
    planes = [np.rint(rng.normal(0, 20, (n, 64)) / (1 + np.arange(64))).astype(np.int64) for n in (24, 6, 6)]
    (pic,) = media.read_jpegs(media.write_jpegs(planes, rows, cols, [b""]))
    assert all((a == b).all() for a, b in zip(pic.planes, planes, strict=True))
    (rgb,) = media.to_rgb([pic])
    assert rgb.shape == (32, 48, 3) and rgb.dtype == np.uint8
    # one block by the definition of the transform
    block = np.zeros(64)
    block[media.ZIGZAG] = planes[0][0]
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    y = np.clip(np.rint(basis @ block.reshape(8, 8) @ basis.T) + 128, 0, 255)
    cb, cr = (np.zeros(64) for _ in range(2))
    cb[media.ZIGZAG], cr[media.ZIGZAG] = planes[1][0], planes[2][0]
    cb, cr = (np.clip(np.rint(basis @ c.reshape(8, 8) @ basis.T) + 128, 0, 255).repeat(2, 0).repeat(2, 1)[:8, :8] - 128 for c in (cb, cr))
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    assert np.abs(np.clip(np.rint(want), 0, 255) - rgb[:8, :8]).max() <= 1


def test_odd_sizes_leave_out_blocks_that_cover_nothing():
    """A 4:2:0 picture of 20 x 20 pixels has 3 x 3 luma blocks in its own scans, but whole units where scans are interleaved."""
    octets = media.store([media.padded(b"x" * 700)])[0]
    pic = media.read_jpegs([octets])[0]
    at = octets.index(b"\xff\xc2") + 5
    smaller = octets[:at] + (20).to_bytes(2, "big") + (20).to_bytes(2, "big") + octets[at + 4 :]
    outline = media._outline(smaller)
    assert (outline.rows, outline.cols) == (2, 2) and pic.rows >= 1
    assert len(outline.blocks(0)) == 9 and outline.blocks(1) is None


def test_what_isn_t_a_progressive_jpeg():
    for bad in (b"", b"GIF89a", b"\xff\xd8\xff\xc0\x00\x02", b"\xff\xd8"):
        with pytest.raises((ValueError, IndexError)):
            media.read_jpegs([bad])


def test_digests(spark):
    texts = [None, "", "é" * 100, "plain text " * 50, "plain text " * 50, "a" * 192]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[3].feature == got[4].feature and got[0].media_sha256 == got[1].media_sha256
    assert media.text_media(docs.where("false")).collect() == []
    rows = media.encode_texts(docs).drop("media")
    assert rows.columns == ["doc_id", "text", "n_bytes", "_media"]
    full = media.decode_media(rows, "_media", tensor=True, payload=True).where("doc_id = 5").first()
    assert bytes(full.payload) == b"a" * 192 and len(full.rgb) == full.height * full.width * 3


def test_columns_that_clash_with_what_is_read_back(spark):
    rows = spark.createDataFrame([(1, "some text", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, feature string, payload_bytes string")
    got = media.decode_media(media.encode_texts(rows, "text")).collect()
    assert [(r.feature, r.payload_bytes) for r in got] == [("x", "y")] * 2
    assert {r["_payload_bytes"] for r in got} == {192} and all(r["_feature"] for r in got)
