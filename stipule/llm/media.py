"""Telephony audio: companded and ADPCM payloads in WAV, decoded to resampled PCM.

Mu-law and A-law bytes are expanded through 256-entry lookup tables built from
the companding rule.  IMA ADPCM is decoded sample by sample, but over all blocks
of a batch at once: the only Python loop runs over the samples of one block.
Decoded samples are resampled to ``PCM_RATE`` and stored as 16-bit PCM WAV.

Defined results: a null text is an empty one; a payload is padded with bytes 255
to a positive multiple of ``BLOCK``; equal payloads give equal files and
features; a null id passes through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stipule.llm.common import arrow_map, table, text_bytes

# WAV format tags, sample rates, and the IMA step and index tables.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
TAGS = {"pcm": PCM, "alaw": ALAW, "mulaw": MULAW, "adpcm": ADPCM}
RATE, PCM_RATE = 8000, 16000
BLOCK = 576
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Blocks decoded together: bounds the decoded samples held at once to about 5 MB.
BLOCKS_AT_ONCE = 2048


def _mulaw() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 85
    level, part = code >> 4 & 7, (code & 15) << 4
    size = np.where(level == 0, part + 8, part + 264 << np.maximum(level - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _ima() -> tuple[np.ndarray, np.ndarray]:
    step, nibble = IMA_STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    moved = np.clip(np.arange(89)[:, None] + IMA_INDEX[nibble & 7], 0, 88)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), moved.astype(np.int32).ravel()


MULAW_PCM, ALAW_PCM = _mulaw(), _alaw()
IMA_CHANGE, IMA_NEXT = _ima()


class Audio(NamedTuple):
    """What a WAV file holds."""

    codec: str
    rate: int
    block: int
    data: bytes


def wav(data: bytes, codec: str, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file around encoded bytes, which it keeps unchanged."""
    tag = TAGS[codec]
    align, bits = (block, 4) if codec == "adpcm" else (2, 16) if codec == "pcm" else (1, 8)
    per_block = (block - 4) * 2 + 1
    byte_rate = rate * block // per_block if codec == "adpcm" else rate * align
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, byte_rate, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if codec != "pcm":
        samples = len(data) // block * per_block if codec == "adpcm" else len(data)
        chunks += b"fact" + struct.pack("<II", 4, samples)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(stored: bytes) -> Audio:
    """Parse a mono WAV file; unknown chunks are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        found.setdefault(kind, stored[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    names = {v: k for k, v in TAGS.items()}
    if tag not in names or b"data" not in found:
        raise ValueError(f"WAV format {tag} is not supported")
    return Audio(names[tag], rate, align if names[tag] == "adpcm" else 0, found[b"data"])


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Decode IMA ADPCM: one row a block of bytes, one row of samples each.

    A header index beyond the step table counts as the last step.
    """
    held = np.ascontiguousarray(blocks.T)
    value = (held[0].astype(np.int32) | held[1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(held[2], 88).astype(np.int32)
    out = np.empty(((len(held) - 4) * 2 + 1, held.shape[1]), np.int16)
    out[0] = value
    at = 1
    for row in held[4:]:
        for nibble in (row & 15, row >> 4):
            code = index * 16 + nibble
            value = np.clip(value + IMA_CHANGE[code], -32768, 32767)
            index = IMA_NEXT[code]
            out[at] = value
            at += 1
    return out.T


def decode(audio: Audio) -> np.ndarray:
    """16-bit samples of a file's audio; a cut last ADPCM block is completed with zeros."""
    data = np.frombuffer(audio.data, np.uint8)
    if audio.codec == "mulaw":
        return MULAW_PCM[data]
    if audio.codec == "alaw":
        return ALAW_PCM[data]
    if audio.codec == "pcm":
        return np.frombuffer(audio.data[: len(audio.data) // 2 * 2], "<i2").astype(np.int16)
    blocks = np.pad(data, (0, -len(data) % audio.block)).reshape(-1, audio.block)
    parts = [adpcm_blocks(blocks[k : k + BLOCKS_AT_ONCE]).ravel() for k in range(0, len(blocks), BLOCKS_AT_ONCE)]
    return np.concatenate([*parts, np.empty(0, np.int16)])


def resample(pcm: np.ndarray, rate: int, to: int = PCM_RATE) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    n = len(pcm) * to // rate
    if not n:
        return np.empty(0, np.int16)
    wide, place = pcm.astype(np.int32), np.arange(n, dtype=np.int64) * rate
    at, part = place // to, (place % to).astype(np.int32)
    after = wide[np.minimum(at + 1, len(wide) - 1)]
    return ((wide[at] * (to - part) + after * part) // to).astype(np.int16) if to < 32768 else ((wide[at].astype(np.int64) * (to - part) + after.astype(np.int64) * part) // to).astype(np.int16)


def doubled(pcm: np.ndarray) -> np.ndarray:
    """``resample`` to twice the rate, without index arrays."""
    out, wide = np.empty(2 * len(pcm), np.int16), pcm.astype(np.int32)
    out[::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) // 2
    out[-1:] = pcm[-1:]
    return out


def to_rate(pcm: np.ndarray, rate: int, to: int = PCM_RATE) -> np.ndarray:
    """Resample by the cheapest way that gives :func:`resample`'s samples."""
    return pcm if rate == to else doubled(pcm) if rate * 2 == to else resample(pcm, rate, to)


def stats(pcm: np.ndarray) -> str:
    """Samples, peak, sum of magnitudes and zero crossings."""
    size, sign = np.abs(pcm.astype(np.int32)), pcm < 0
    return f"{len(pcm)}/{int(size.max(initial=0))}/{int(size.sum(dtype=np.int64))}/{int(np.count_nonzero(sign[1:] != sign[:-1]))}"


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``block``."""
    return data.ljust(max(block, -(-len(data) // block) * block), b"\xff")


def _features(payloads: list[bytes]) -> list[str]:
    """For each payload: its samples read as each codec, and a checksum of its resampled PCM."""
    out = [[] for _ in payloads]
    for k, data in enumerate(payloads):
        codes = np.frombuffer(data, np.uint8)
        pcm = to_rate(MULAW_PCM[codes], RATE)
        out[k] += [f"mulaw={stats(pcm)}", f"crc={zlib.crc32(pcm)}", f"alaw={stats(ALAW_PCM[codes])}"]
    # ADPCM of all payloads together: sums of its blocks are added up for each payload.
    owner = np.repeat(np.arange(len(payloads)), [len(p) // BLOCK for p in payloads])
    blocks = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    peak, total = np.zeros(len(payloads), np.int64), np.zeros(len(payloads), np.int64)
    for k in range(0, len(blocks), BLOCKS_AT_ONCE):
        size = np.abs(adpcm_blocks(blocks[k : k + BLOCKS_AT_ONCE]).astype(np.int32))
        who = owner[k : k + BLOCKS_AT_ONCE]
        np.maximum.at(peak, who, size.max(axis=1))
        np.add.at(total, who, size.sum(axis=1, dtype=np.int64))
    return ["|".join([*parts, f"adpcm={p}/{t}"]) for parts, p, t in zip(out, peak, total, strict=True)]


OUTPUTS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long",
    "media_sha256": "string", "feature": "string", "pcm_bytes": "long", "pcm_sha256": "string", "media": "binary", "pcm": "binary",
}
DIGESTS = tuple(k for k in OUTPUTS if k not in ("media", "pcm"))


def audio_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = tuple(OUTPUTS)) -> DataFrame:
    """Store each text's bytes as a mu-law WAV, read it back, decode and describe it.

    ``media`` is the stored file and ``pcm`` the resampled 16-bit WAV, which
    ``pcm_bytes`` and ``pcm_sha256`` describe; ask for
    fewer ``outputs`` where only digests or features are needed.
    """
    want = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [text_bytes(t) for t in batch.column(1).to_pylist()]
            media = [wav(padded(b), "mulaw") for b in raw]
            held = [read_wav(m) for m in media]
            cols = {
                "n_bytes": [len(b) for b in raw],
                "payload_bytes": [len(a.data) for a in held],
                "payload_sha256": [hashlib.sha256(a.data).hexdigest() for a in held],
                "tail_crc32": [zlib.crc32(a.data[-32:]) for a in held],
                "media_bytes": [len(m) for m in media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
            }
            if "feature" in want:
                cols["feature"] = _features([a.data for a in held])
            if "media" in want:
                cols["media"] = media
            if {"pcm", "pcm_bytes", "pcm_sha256"} & set(want):
                pcm = [wav(to_rate(decode(a), a.rate).astype("<i2", copy=False).tobytes(), "pcm", PCM_RATE) for a in held]
                cols |= {"pcm": pcm, "pcm_bytes": [len(p) for p in pcm], "pcm_sha256": [hashlib.sha256(p).hexdigest() for p in pcm]}
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], kinds[OUTPUTS[c]]) for c in want)], names=[id_col, *want])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in want)
    return arrow_map(df, [id_col, text_col], run, schema)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every whole text stored as telephony audio."""
    return audio_column(table(spark, sf_dir, "documents"), outputs=DIGESTS)
