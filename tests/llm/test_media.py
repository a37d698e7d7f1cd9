import hashlib
import tarfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_images_are_lossless(text):
    text = text.encode("utf-8", "ignore").decode()
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
    assert media.from_png(media.to_png(payload)) == payload
    assert media.read_header(media.to_png(payload)[: media.HEADER]) == (64, len(payload) // 64, 8, 0)


def test_damage_is_seen():
    image = bytearray(media.to_png(media.payload_of("some text")))
    image[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))
    with pytest.raises(ValueError, match="PNG"):
        media.read_header(b"x" * 33)


def test_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in media.query(spark, "/root/testdata/sf0.001").collect()}
    for r in documents.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        image, have = media.to_png(payload), got[r["doc_id"]]
        assert (have["n_bytes"], have["payload_bytes"], have["payload_sha256"], have["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (have["media_bytes"], have["media_sha256"], have["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature_of(payload))
        assert (have["width"], have["height"]) == (64, len(payload) // 64)


def test_shards_are_tar_files_with_addressed_members(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/shards"
    stored = media.store(documents, folder).collect()
    members = {}
    for path in (tmp_path / "shards").iterdir():
        with tarfile.open(path) as tar:
            for m in tar:
                data = tar.extractfile(m).read()
                assert m.name == hashlib.sha256(data).hexdigest() + ".png"
                members[path.name, m.offset_data, m.size] = m.name[:-4]
    assert all(members[r["shard"], r["offset"], r["length"]] == r["digest"] for r in stored)
    head = media.headers(media.contents(media.store(documents, folder)), folder)
    assert head.count() == len({r["digest"] for r in stored}) and {r["width"] for r in head.collect()} == {64}


def test_shards_roll_over(tmp_path):
    w = media.ShardWriter(f"file://{tmp_path}/s", limit=2000)
    places = [w.put(bytes([i]) * 600) for i in range(5)] + [w.put(bytes([0]) * 600)]
    w.close()
    assert places[0] == places[5] and len({p[1] for p in places}) == 3
    for digest, shard, offset, length in places:
        assert hashlib.sha256((tmp_path / "s" / shard).read_bytes()[offset : offset + length]).hexdigest() == digest


def test_edges(spark, odd, empty, tmp_path):
    rows = media.media_columns(odd, f"file://{tmp_path}/a").collect()
    assert len(rows) == odd.count()
    assert {(r["n_bytes"], r["payload_bytes"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 64)}
    assert len({tuple(r)[1:8] for r in rows if r["doc_id"] == 4}) == 1
    assert media.media_columns(empty, f"file://{tmp_path}/b").count() == 0


def plain_samples(image: bytes) -> bytes:
    """The samples of a grey-scale image of 8 bits without filters, by the format's rules."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, width, height = 8, b"", 0, 0
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(data)
    lines = [raw[k * (width + 1) : (k + 1) * (width + 1)] for k in range(height)]
    assert all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


def plain_feature(payload: bytes) -> str:
    import math
    import statistics
    from collections import Counter

    n, count = len(payload), Counter(payload)
    bits = -sum(k / n * math.log2(k / n) for k in count.values())
    return f"64x{n // 64};mean={statistics.fmean(payload):.4f};dev={statistics.pstdev(payload):.4f};bits={abs(bits):.4f};high={sum(b > 127 for b in payload) / n:.4f}"


def test_whole_table_against_the_tar_files(spark, documents):
    """Every row's digest, shard, offset and length lead to a member that a tar library reads too; features are computed anew from it."""
    folder = media.new_folder(spark, "media")
    got = {r["doc_id"]: r for r in media.media_columns(documents, folder).collect()}
    members, path = {}, folder.removeprefix("file:")
    for name in {r["shard"] for r in got.values()}:
        with tarfile.open(f"{path}/{name}") as tar:
            members.update({(name, m.offset_data): (m.name, tar.extractfile(m).read()) for m in tar})
    for r in documents.collect():
        have = got[r["doc_id"]]
        name, image = members[have["shard"], have["offset"]]
        payload = plain_samples(image)
        assert payload == (r["text"] or "").encode().ljust(len(payload), b"\0") and len(payload) - len((r["text"] or "").encode()) <= 64
        assert name == f"{have['digest']}.png" and have["media_sha256"] == have["digest"] == hashlib.sha256(image).hexdigest() and have["media_bytes"] == have["length"] == len(image)
        assert have["feature"] == plain_feature(payload)


def test_frequent_contents_are_dealt_to_several_tasks(spark, tmp_path):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    told = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/a", share=10)
    got = told.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert len({tuple(r)[1:] for r in got if r["doc_id"] % 3}) == 1 and len({r["digest"] for r in got}) == 1001


def test_a_task_remembers_a_bounded_number_of_contents(tmp_path):
    w = media.ShardWriter(f"file://{tmp_path}/s", known=3)
    places = [w.put(bytes([i]) * 100) for i in (0, 1, 2, 0, 3, 0, 1)]
    w.close()
    assert len(w.known) == 3 and places[0] == places[3] == places[5] and places[1] != places[6] and places[1][0] == places[6][0]
