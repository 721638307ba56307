"""bcrypt for many rows at once, in numpy: making and comparing password hashes.

Rows of one cost go through the key schedule side by side: each step is one
array operation over all of them, so a row costs what its share of a batch does
(README: seconds a row). The cipher's tables are the first bits of pi's fraction
and are computed, not listed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The alphabet of hashes, the text that is enciphered, and the form of a hash.
ALPHABET = "./ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
MAGIC = b"OrpheanBeholderScryDoubt"
FORM = re.compile(r"\$2[aby]\$([0-9]{2})\$([./A-Za-z0-9]{22})([./A-Za-z0-9]{31})")
KEY_BYTES, ROUNDS = 72, 16
#: Rows that go through side by side: their boxes take 4 KB each.
BATCH = 1024
_WORDS = ROUNDS + 2 + 4 * 256


@functools.cache
def pi_words() -> np.ndarray:
    """The first words of pi's fraction, 32 bits each, by Machin's formula."""
    bits = 32 * _WORDS + 64

    def arctan(n: int) -> int:
        """of 1 / n, in units of 2 ** -bits"""
        term = total = (1 << bits) // n
        k, sign = 3, -1
        while term:
            term //= n * n
            total += sign * (term // k)
            k, sign = k + 2, -sign
        return total

    fraction = (16 * arctan(5) - 4 * arctan(239)) - (3 << bits)
    return np.array([(fraction >> (bits - 32 * (i + 1))) & 0xFFFFFFFF for i in range(_WORDS)], np.uint32)


def decode64(text: str) -> bytes:
    bits = "".join(f"{ALPHABET.index(c):06b}" for c in text)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) // 8 * 8, 8))


def encode64(data: bytes) -> str:
    bits = "".join(f"{b:08b}" for b in data)
    return "".join(ALPHABET[int(bits[i : i + 6].ljust(6, "0"), 2)] for i in range(0, len(bits), 6))


class Boxes:
    """Keys and boxes of n rows."""

    def __init__(self, n: int):
        start = pi_words()
        self.keys = np.repeat(start[: ROUNDS + 2, None], n, 1)
        self.boxes = np.repeat(start[None, ROUNDS + 2 :], n, 0)
        # byte 3 of a word is looked up in the first box, byte 0 in the last
        self.at = np.arange(n)[:, None] * 1024 + np.array([768, 512, 256, 0])

    def encipher(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = self.boxes.reshape(-1)
        for i in range(ROUNDS):
            left = left ^ self.keys[i]
            found = flat.take(self.at + left.view(np.uint8).reshape(-1, 4))
            mixed = ((found[:, 3] + found[:, 2]) ^ found[:, 1]) + found[:, 0]
            left, right = right ^ mixed, left
        left, right = right, left
        return left ^ self.keys[ROUNDS + 1], right ^ self.keys[ROUNDS]

    def schedule(self, key: np.ndarray, salt: np.ndarray | None = None) -> None:
        """key: 18 words of each row; salt: 4 words of each, or none."""
        self.keys ^= key
        left = right = np.zeros(self.keys.shape[1], np.uint32)
        for k in range(0, _WORDS, 2):
            if salt is not None:
                left, right = left ^ salt[k % 4], right ^ salt[k % 4 + 1]
            left, right = self.encipher(left, right)
            if k < ROUNDS + 2:
                self.keys[k], self.keys[k + 1] = left, right
            else:
                self.boxes[:, k - ROUNDS - 2], self.boxes[:, k - ROUNDS - 1] = left, right


def _words(rows: list[bytes], n: int) -> np.ndarray:
    """n big-endian words of each row, its bytes repeated as often as it takes."""
    return np.stack([np.frombuffer((r * (4 * n // len(r) + 1))[: 4 * n], ">u4").astype(np.uint32) for r in rows], 1)


def digests(passwords: list[bytes], salts: list[bytes], cost: int) -> list[bytes]:
    """The 23 bytes of each row's hash."""
    out: list[bytes] = []
    for i in range(0, len(passwords), BATCH):
        keys = [(p + b"\0")[:KEY_BYTES] for p in passwords[i : i + BATCH]]
        n, key, salt = len(keys), _words(keys, ROUNDS + 2), _words(salts[i : i + BATCH], 4)
        long_salt = np.concatenate([salt] * 5)[: ROUNDS + 2]
        b = Boxes(n)
        b.schedule(key, salt)
        for _ in range(1 << cost):
            b.schedule(key)
            b.schedule(long_salt)
        text = np.repeat(np.frombuffer(MAGIC, ">u4").astype(np.uint32)[:, None], n, 1)
        for k in (0, 2, 4):
            for _ in range(64):
                text[k], text[k + 1] = b.encipher(text[k], text[k + 1])
        out += [t.astype(">u4").tobytes()[:23] for t in text.T]
    return out


def _compared(passwords: list[str | None], hashes: list[str | None]) -> np.ndarray:
    """Which passwords a hash is of; null ones and what is no hash match nothing."""
    same, by_cost = np.zeros(len(passwords), bool), {}
    for i, (p, h) in enumerate(zip(passwords, hashes, strict=True)):
        m = FORM.fullmatch(h or "")
        if p is not None and m and 4 <= int(m[1]) <= 31:
            by_cost.setdefault(int(m[1]), []).append((i, p.encode(), decode64(m[2])[:16], m[3]))
    for cost, rows in by_cost.items():
        for (i, _, _, want), got in zip(rows, digests([r[1] for r in rows], [r[2] for r in rows], cost), strict=True):
            same[i] = encode64(got) == want
    return same


def matches(df: DataFrame, password: str, hashed: str, out: str = "matches") -> DataFrame:
    """The rows with ``out``: whether the password is the one of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(out, pa.array(_compared(b.column(password).to_pylist(), b.column(hashed).to_pylist())))

    return df.mapInArrow(run, f"{_ddl(df)}, `{out}` boolean")


def hashes(df: DataFrame, password: str, salt: Column, cost: int = 10, out: str = "hash") -> DataFrame:
    """The rows with ``out``: the password's hash under a salt of 16 bytes (a random one for real use); null for a null password."""
    salted = df.withColumn("_salt", salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, salts = b.column(password).to_pylist(), b.column("_salt").to_pylist()
            on = [i for i, (w, s) in enumerate(zip(words, salts, strict=True)) if w is not None and s is not None and len(s) == 16]
            made: list[str | None] = [None] * len(words)
            for i, d in zip(on, digests([words[i].encode() for i in on], [salts[i] for i in on], cost) if on else [], strict=True):
                made[i] = f"$2b${cost:02d}${encode64(salts[i])}{encode64(d)}"
            yield b.drop_columns(["_salt"]).append_column(out, pa.array(made, pa.string()))

    if not 4 <= cost <= 31:
        raise ValueError("cost must be 4 to 31")
    return salted.mapInArrow(run, f"{_ddl(df)}, `{out}` string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def random_salt() -> Column:
    """16 bytes a row, of the digest of two fresh ids."""
    return F.unhex(F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 32))
