"""Telephony audio columns: mu-law, A-law and IMA ADPCM payloads, and resampled PCM.

A payload of bytes is stored losslessly as the coded samples of a WAV file
(mu-law and A-law: a byte is a sample; ADPCM: a block of 64 bytes is the unit).
Reading parses the container, expands mu-law and A-law by lookup tables and
decodes ADPCM nibble by nibble over all blocks of a batch at once, and the PCM
at 8 kHz is resampled to 16 kHz by linear interpolation.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, utf8

UNIT = 64
RATE = 8000
#: WAV format tags.  Fixed values.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
CODECS = ("mulaw", "alaw", "adpcm")
#: IMA ADPCM step sizes and index changes.  Fixed values of the format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 0x84) << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    low, exponent = (a & 15) << 4, a >> 4 & 7
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
#: By step index and nibble: the difference that the nibble stands for, and the next index.
DIFF = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)) for n in range(16)] for s in STEPS.tolist()], dtype=np.int32)
NEXT = np.array([[min(88, max(0, i + CHANGES[n & 7])) for n in range(16)] for i in range(89)], dtype=np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (rows of ``UNIT`` bytes) to PCM: a header sample, then two samples a byte, low nibble first."""
    n = len(blocks)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), n), dtype=np.int16)
    out[0] = value
    diff, follow = DIFF.ravel(), NEXT.ravel()
    for k, byte in enumerate(data):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            at = index * 16 + nibble
            value = np.minimum(np.maximum(value + diff[at], -32768), 32767)
            index = follow[at]
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``UNIT``."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")


def codec_of(payload: bytes) -> str:
    """The codec that a payload is stored with; equal payloads have the same."""
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def wav(payload: bytes, codec: str) -> bytes:
    """A mono WAV file whose data chunk is ``payload``."""
    adpcm = codec == "adpcm"
    per_block = 1 + 2 * (UNIT - 4)
    samples = len(payload) // UNIT * per_block if adpcm else len(payload)
    extra = struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * UNIT // per_block if adpcm else RATE, UNIT if adpcm else 1, 4 if adpcm else 8) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a WAV file; ValueError if it isn't one of ours."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag = int.from_bytes(media[at + 8 : at + 10], "little")
            codec = next((c for c, t in TAGS.items() if t == tag), None)
        elif name == b"data" and codec:
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no supported format or no data")


def decode(stored: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM at 8 kHz of each (codec, payload); one pass for each codec over all its payloads."""
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(stored)
    for codec in CODECS:
        own = [i for i, (c, _) in enumerate(stored) if c == codec]
        if not own:
            continue
        data = np.frombuffer(b"".join(stored[i][1] for i in own), dtype=np.uint8)
        pcm = adpcm_decode(data.reshape(-1, UNIT)).ravel() if codec == "adpcm" else TABLES[codec][data]
        scale = (1 + 2 * (UNIT - 4)) / UNIT if codec == "adpcm" else 1
        sizes = [round(len(stored[i][1]) * scale) for i in own]
        for i, part in zip(own, np.split(pcm, np.cumsum(sizes)[:-1])):
            out[i] = part
    return out


def resample(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; ``ends``: one past the last sample of each signal."""
    after = np.empty_like(pcm)
    after[:-1] = pcm[1:]
    after[ends - 1] = pcm[ends - 1]
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, codec string, n_samples long, mean_size long, peak int, crossings long, pcm binary"


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its text stored as telephony audio.

    doc_id; n_bytes, the UTF-8 bytes of the text (null: empty); media, the WAV
    file; payload, the padded bytes as read back from it; codec; of the decoded
    signal n_samples, mean absolute value, peak and zero crossings; pcm, 16-bit
    samples at 16 kHz.  Equal texts give equal values.  An empty text is 64 zero
    bytes; others are stored whole, however long.  Repeated rows and rows without
    an id are kept as they are, an empty table gives an empty result, and other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            texts = utf8(batch.column("text"))
            media = [wav(p, codec_of(p)) for p in map(pad, texts)]
            stored = [read_wav(m) for m in media]
            signals = decode(stored)
            sizes = np.array([len(s) for s in signals])
            ends = np.cumsum(sizes)
            pcm = np.concatenate(signals)
            starts = ends - sizes
            wide = np.abs(pcm.astype(np.int32))
            turn = np.zeros(len(pcm), dtype=np.int64)
            turn[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
            turn[starts] = 0
            loud = resample(pcm, ends).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([p for _, p in stored], pa.binary()),
                    pa.array(media, pa.binary()),
                    pa.array([c for c, _ in stored], pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(wide, starts, dtype=np.int64) // sizes, pa.int64()),
                    pa.array(np.maximum.reduceat(wide, starts), pa.int32()),
                    pa.array(np.add.reduceat(turn, starts), pa.int64()),
                    pa.array([loud[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "payload", "media", "codec", "n_samples", "mean_size", "peak", "crossings", "pcm"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(map_batches, run, SCHEMA)


def media_digest(docs: DataFrame) -> DataFrame:
    """Sizes, digests and the feature of :func:`audio`."""
    feature = F.concat_ws(":", "codec", "n_samples", "mean_size", "peak", "crossings", F.hex(F.crc32("pcm")))
    return audio(docs).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, length(payload) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
