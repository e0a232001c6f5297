import hashlib
import io

import numpy as np
import pytest

from rulewright.llm import media


def test_formats_decode():
    image = np.arange(24, dtype=np.uint8).reshape(4, 6) * 10
    assert (media.decode(media.encode_pgm(image))[:, :, 0] == image).all()
    assert media.decode(b"P2 # c\n2 2\n255\n0 10\n20 30")[:, :, 0].tolist() == [[0, 10], [20, 30]]
    assert media.decode(b"P1\n3 1\n1 0 1")[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000]))[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P6\n1 1\n255\n" + bytes([1, 2, 3])).tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 2\n65535\n" + bytes([255, 255, 0, 0]))[:, :, 0].tolist() == [[255], [0]]
    assert media.decode(b"P3\n1 1\n100\n100 50 0").tolist() == [[[255, 128, 0]]]
    row = bytes([3, 2, 1, 6, 5, 4, 0, 0])
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert media.decode(head + row + bytes(8))[1].tolist() == [[1, 2, 3], [4, 5, 6]]
    for bad in (b"", b"P", b"P5\n9 9\n255\n", b"GIF89a", b"BM", b"P5 x"):
        try:
            media.decode(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_area_resize_is_the_mean_of_the_area():
    rng = np.random.default_rng(1)
    for h, w, th, tw in ((7, 5, 3, 2), (4, 4, 2, 2), (2, 3, 5, 7), (1, 64, 8, 9)):
        image = rng.integers(0, 256, (h, w, 1)).astype(np.uint8)
        fine = np.repeat(np.repeat(image[:, :, 0], th, axis=0), tw, axis=1).astype(float)  # every target pixel covers h x w of these
        want = np.floor(fine.reshape(th, h, tw, w).mean(axis=(1, 3)) + 0.5 + 1e-9)
        assert (media.area_resize(image, th, tw)[:, :, 0] == want).all()


def test_npy_is_numpys():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (np.load(io.BytesIO(media.write_npy(x))) == x).all() and (media.read_npy(media.write_npy(x)) == x).all()


def test_payload_round_trip(docs, corpus, odd, none):
    rows = {r.id: r for r in media.describe_media(media.store_payload(docs)).collect()}
    for i, text in corpus:
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert bytes(rows[i].samples) == padded and rows[i].n_bytes == len(data)
        assert rows[i].width == 64 and media.read_npy(bytes(rows[i].tile)).shape == (32, 32, 1) and len(rows[i].dhash) == 16
    assert hashlib.sha256(rows[30].media).digest() == hashlib.sha256(rows[31].media).digest() and rows[30].dhash == rows[31].dhash
    assert len(media.store_payload(odd).collect()) == 5 and media.store_payload(none).collect() == []


def test_bad_images_are_null(spark):
    df = spark.createDataFrame([(1, b"P5\n1 1\n255\n\x07", "w"), (2, b"nope", "w"), (3, None, None)], "id int, media binary, width string")
    rows = {r.id: r for r in media.describe_media(df).collect()}
    assert rows[1].width == 1 and rows[2].dhash is None and rows[3].tile is None


def test_samples_out_of_range_are_refused():
    for bad in (b"P2\n2 1\n100\n5 101", b"P5\n2 1\n100\n\x05\x65", b"P1\n2 1\n1 7", b"P2\n1 1\n9\n-1", b"P5\n1 1\n300\n\x01\x2d"):
        with pytest.raises(ValueError):
            media.decode(bad)


def bitmap(bits, height, rows, palette=b"", compression=0, width=2):
    start = 54 + len(palette)
    n = lambda x, k=4: x.to_bytes(k, "little", signed=x < 0)
    return b"BM" + n(0) + n(0) + n(start) + n(40) + n(width) + n(height) + n(1, 2) + n(bits, 2) + n(compression) + bytes(20) + palette + rows


def test_bitmaps_of_all_depths():
    colours = b"".join(bytes([i, 2 * i % 256, 3 * i % 256, 0]) for i in range(256))
    of = lambda i: [3 * i % 256, 2 * i % 256, i]
    assert media.decode(bitmap(1, -1, bytes([0b01000000, 0, 0, 0]), colours[:8])).tolist() == [[of(0), of(1)]]
    assert media.decode(bitmap(4, -1, bytes([0x5A, 0, 0, 0]), colours[:64])).tolist() == [[of(5), of(10)]]
    assert media.decode(bitmap(8, -1, bytes([200, 7, 0, 0]), colours)).tolist() == [[of(200), of(7)]]
    assert media.decode(bitmap(32, -1, bytes([1, 2, 3, 9, 4, 5, 6, 9]))).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    assert media.decode(bitmap(32, -1, bytes([1, 2, 3, 9, 4, 5, 6, 9]), bytes([0, 0, 255, 0, 0, 255, 0, 0, 255, 0, 0, 0]), 3)).tolist() == [[[3, 2, 1], [6, 5, 4]]]
    top_down, bottom_up = (media.decode(bitmap(24, h, bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0]))) for h in (-2, 2))
    assert (top_down == bottom_up[::-1]).all() and top_down[0].tolist() == [[3, 2, 1], [6, 5, 4]]
    with pytest.raises(ValueError):  # other masks than those of blue, green and red
        media.decode(bitmap(32, -1, bytes(8), bytes([255, 0, 0, 0, 0, 255, 0, 0, 0, 0, 255, 0]), 3))


def test_bands_make_no_difference():
    image = np.random.default_rng(2).integers(0, 256, (97, 64, 1)).astype(np.uint8)
    assert all((media.area_resize(image, 8, 9, n) == media.area_resize(image, 8, 9)).all() for n in (1, 3000, 20_000))
