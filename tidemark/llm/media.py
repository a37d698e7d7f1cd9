"""Media columns: content-addressed payloads in tar shards.

A payload becomes a grey-scale PNG of 64 samples a row, 8 bits each (lossless).  Every task appends the
images of its rows to tar shards in the shared folder; a member's name is the SHA-256 of its bytes, and a
task stores each content once (again only after ``known`` other contents).  A row carries digest, shard, offset and length of the member's data.
Where several tasks stored the same content, every row points at one of the copies (the least shard name);
the others are unused bytes, at most one for each task that met the content.  That costs less disk
than moving all payloads between tasks to bring equal ones together.

Contents of very many rows are described once and then dealt to several tasks with their share of the rows, so that no task
gets all rows of a digest.

Metadata columns (width, height, bit depth, colour type) come from range reads of the first 33 bytes of a
member, features from a range read of the whole member.

A shard's name is new for each attempt of a task and the rows are checkpointed before they are used, so a
repeated task leaves an unused shard behind but never a dangling reference.

Edge cases: a null text counts as empty, whose payload is 64 zero bytes.  Equal texts have equal values in
every column of the query.  An empty table gives no rows and no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialise, new_folder, prepare, read

#: Samples a row of an image, and the unit to which a payload is padded.
WIDTH = 64
#: Bytes of the PNG that a header-only read takes: signature and IHDR chunk.
HEADER = 33
#: A task starts a new shard beyond this many bytes.
SHARD_BYTES = 256 << 20
#: Contents whose places a task remembers; digests of more than one in SHARE rows are dealt to several tasks (there are fewer than SHARE of them).
KNOWN, SHARE = 1 << 16, 1000

# Fixed values of the PNG format: its signature, and 8-bit grey scale without interlace.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY8 = bytes([8, 0, 0, 0, 0])


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A payload, whose length is a multiple of WIDTH, as an image; its rows have filter 0."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = _chunk(b"IHDR", struct.pack(">II", WIDTH, len(rows)) + GREY8)
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type out of the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made, checked against its checksums."""
    width, height, depth, colour = read_header(image)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an image of this store")
    at, data = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean, deviation, entropy in bits and the share of bytes above 127, of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / len(payload)
    mean = int((counts * np.arange(256)).sum()) / len(payload)
    dev = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.4f};dev={dev:.4f};bits={abs(entropy):.4f};high={int(counts[128:].sum()) / len(payload):.4f}"


def _open(folder: str):
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class ShardWriter:
    """Appends members to tar shards of a folder and says where each one's data begins."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES, known: int = KNOWN):
        self.fs, self.base = _open(folder)
        self.limit, self.most, self.sink, self.at = limit, known, None, 0
        self.known: dict[str, tuple[str, int, int]] = {}

    def put(self, data: bytes) -> tuple[str, str, int, int]:
        """Digest, shard, offset and length."""
        digest = hashlib.sha256(data).hexdigest()
        if digest in self.known:
            self.known[digest] = self.known.pop(digest)  # the latest met
        else:
            while len(self.known) >= self.most:
                del self.known[next(iter(self.known))]
            if self.sink is None or self.at > self.limit:
                self.close()
                self.fs.create_dir(self.base, recursive=True)
                self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
                self.sink = self.fs.open_output_stream(f"{self.base}/{self.name}")
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.sink.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
            self.known[digest] = self.name, self.at + len(head), len(data)
            self.at += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        return digest, *self.known[digest]

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(bytes(2 * tarfile.BLOCKSIZE))
            self.sink.close()
            self.sink = None


def _store(df: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """store(), with digests as bytes, which take half the room between tasks."""
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    fields = ["n_bytes", "digest", "shard", "offset", "length"]
    types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder)
        try:
            for batch in batches:
                rows = []
                for text in batch.column(1).to_pylist():
                    digest, *place = shards.put(to_png(payload_of(text)))
                    rows.append((len((text or "").encode()), bytes.fromhex(digest), *place))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *fields])
        finally:
            shards.close()

    put = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    return materialise(put)


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every payload; one row a document: id, n_bytes, digest, shard, offset, length. Materialised."""
    return _store(df, folder, id_col, text_col).select(F.col(f"`{id_col}`"), "n_bytes", F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length")


def contents(stored: DataFrame) -> DataFrame:
    """One row a digest: the location that all its rows use."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return stored.groupBy("digest").agg(place).select("digest", "place.*")


def frequent(stored: DataFrame, share: int = SHARE) -> list[tuple]:
    """(digest, tasks to deal it to) of the digests of more than one in share rows; fewer than share of them.

    Candidates come from a sketch of bounded size that misses no frequent one; only they are counted.
    """
    n = stored.count()
    candidates = stored.freqItems(["digest"], 1 / share).first()[0] if n else []
    if not candidates:
        return []
    counts = stored.filter(F.col("digest").isin(candidates)).groupBy("digest").count().collect()
    return [(r["digest"], -(-r["count"] * share // n)) for r in counts if r["count"] * share > n]


def _ranges(found: DataFrame, folder: str, schema: str, take) -> DataFrame:
    """Contents, their places and what take(file, offset, length, digest) tells; ranges of a shard are read in the order of their offsets."""

    def make():
        files = {}
        filesystem, base = _open(folder)

        def work(digests, shards, offsets, lengths):
            out = []
            for digest, shard, offset, length in zip(digests, shards, offsets, lengths, strict=True):
                if shard not in files:
                    for f in files.values():
                        f.close()
                    files.clear()
                    files[shard] = filesystem.open_input_file(f"{base}/{shard}")
                out.append((digest, shard, offset, length, *take(files[shard], offset, length, digest)))
            return tuple(map(list, zip(*out, strict=True)))

        return work

    # Ranges of (shard, offset): a shard that holds most of the contents is read by several tasks.
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return map_columns(placed, ["digest", "shard", "offset", "length"], f"digest {dict(found.dtypes)['digest']}, shard string, offset long, length long, {schema}", make)


def headers(found: DataFrame, folder: str) -> DataFrame:
    """Metadata columns by header-only range reads: digest and place, width, height, bit_depth, colour_type."""

    def take(file, offset, length, digest):
        return read_header(file.read_at(min(HEADER, length), offset))

    return _ranges(found, folder, "width long, height long, bit_depth int, colour_type int", take)


def features(found: DataFrame, folder: str) -> DataFrame:
    """Reads every content back once: digest and place, its header's metadata, the payload's digest (as bytes) and the feature.

    What is read must have the digest it is stored by.
    """

    def take(file, offset, length, digest):
        width, height, _, _ = read_header(file.read_at(min(HEADER, length), offset))
        image = file.read_at(length, offset)
        own = hashlib.sha256(image)
        if digest not in (own.digest(), own.hexdigest()):
            raise ValueError("a stored content isn't what was written")
        payload = from_png(image)
        return width, height, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), feature_of(payload)

    return _ranges(found, folder, "width long, height long, payload_bytes long, payload_digest binary, tail_crc32 long, feature string", take)


def media_columns(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """Stores, reads back and describes every row's payload; see the module's text."""
    stored = _store(df, folder, id_col, text_col)
    found = contents(stored)
    told = features(found, folder)
    rows = stored.select(F.col(f"`{id_col}`"), "n_bytes", "digest")
    keys = ["digest"]
    if often := frequent(stored, share):
        # A frequent digest's description is repeated, in all at most twice as often as share; its rows take turns.
        ways = F.broadcast(df.sparkSession.createDataFrame(often, "digest binary, ways int"))
        told = told.join(ways, "digest", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
        rows = rows.withColumn("place", F.monotonically_increasing_id()).join(ways, "digest", "left")
        rows = rows.withColumn("way", F.coalesce(F.pmod("place", "ways"), F.lit(0)).cast("int")).drop("place", "ways")
        keys.append("way")
    hexadecimal = lambda c: F.lower(F.hex(c))
    return rows.join(told, keys).select(
        F.col(f"`{id_col}`"), "n_bytes", "payload_bytes", hexadecimal("payload_digest").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexadecimal("digest").alias("media_sha256"), "feature",
        hexadecimal("digest").alias("digest"), "shard", "offset", "length", "width", "height",
    )


def query(spark, sf_dir: str) -> DataFrame:
    told = media_columns(read(spark, sf_dir, "documents"), new_folder(spark, "media"))
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height")
