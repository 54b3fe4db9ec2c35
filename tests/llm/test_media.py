import hashlib
import zlib

import numpy as np
import pytest

from lumenscan.llm import media


def brute_resize(p, h, w):
    """Means over rational areas, by refining every pixel h by w times."""
    fine = np.repeat(np.repeat(p.astype(float), h, 0), w, 1)
    return fine.reshape(h, p.shape[0], w, p.shape[1]).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (1, 64), (3, 5), (8, 9), (17, 64), (40, 31)])
def test_resize_and_hash_against_brute_force(shape):
    p = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    small = brute_resize(p, 8, 9)
    assert np.allclose(media.area_resize(p, 8, 9), small)
    bits = "".join("1" if d > 1e-9 else "0" for d in (small[:, :-1] - small[:, 1:]).reshape(-1))
    assert media.difference_hash(p) == int(bits, 2)


def test_formats_round_trip():
    p = np.random.default_rng(2).integers(0, 256, (7, 13)).astype(np.uint8)
    for f in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(f(p)) == p).all()
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n9\n3 9\n").tolist() == [[3, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert sum(len(media.from_npy(t)) for _, _, t in media.tiles(p, 3, 13)) == 7
    for bad in (b"", b"P5\n0 0\n255\n", b"P5\n2 2\n255\nx", b"GIF89a", b"BM"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_documents(edges, edge_rows, empty):
    found = {}
    for r in media.digest_texts(edges).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(edge_rows)
    for i, text, *_ in edge_rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = found[i][0]
        stored = media.store_payload(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert found[1][0]["feature"] == found[2][0]["feature"]
    assert media.digest_texts(empty).count() == 0


def test_features_of_bad_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.zeros((2, 2), np.uint8)))), (2, None), (3, bytearray(b"x"))], "doc_id long, media binary")
    found = {r["doc_id"]: r for r in media.features(df).collect()}
    assert found[1]["height"] == 2 and found[2]["feature"] is None and found[3]["error"]
