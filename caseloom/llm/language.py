"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; all that is no letter counts as a blank.  Grams of
1 to 3 characters are hashed into 2**15 columns for each length, into fewer
where many languages would make the matrix larger than ``MATRIX_BYTES``; a
text's log-probabilities are the sums of the matrix rows that its grams point at
(a sparse row times the dense matrix).

Training reads at most ``PER_CLASS`` documents of each language and
``TRAIN_BYTES`` bytes, shared evenly by the languages (the fixed bounds of the
sample); every language is learnt, and priors come from all rows.  Null texts and texts
without a letter are ``und`` with score 0, and so is all if nothing is labelled.
Equal texts get equal answers; ties go to the more frequent language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import bytes_of, lean, small_batches, spans_of
from caseloom.llm.training import held_out, learnt, sample_ids, sample_texts

ORDERS = 3
BITS = 15
PER_CLASS = 1500
TRAIN_BYTES = 24 << 20
MATRIX_BYTES = 96 << 20
LEAST_BITS = 4
#: Numbers (characters x languages, rows x languages) that a step of scoring holds.
CELLS = 1 << 20
ALPHA = 0.05
_MUL = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the basic plane: what a character counts as, and whether it is a letter."""
    if not _TABLES:
        letter = np.array([chr(i).isalpha() for i in range(1 << 16)])
        low = np.full(1 << 16, 32, np.uint32)
        for i in np.flatnonzero(letter):
            c = chr(i).lower()
            low[i] = ord(c) if len(c) == 1 else i
        _TABLES.extend((low, letter))
    return _TABLES[0], _TABLES[1]


def bits_for(n_languages: int) -> int:
    """Bits of the column of a gram, so that the matrix stays under ``MATRIX_BYTES``; where the least don't do, an error."""
    bits = BITS
    while (ORDERS << bits) * 4 * n_languages > MATRIX_BYTES:
        if bits == LEAST_BITS:
            raise ValueError(f"{n_languages} languages: a matrix of so many takes over {MATRIX_BYTES} bytes")
        bits -= 1
    return bits


def grams(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length, the column of the gram that starts at each character; row starts; letters in each row.

    A gram that would leave its row points at the empty column past the others.
    """
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[off]
    low, letter = _tables()
    small = text < (1 << 16)
    if small.all():
        c, is_letter = low[text], letter[text]
    else:
        c = text.copy()
        c[small] = low[text[small]]
        is_letter = np.zeros(len(text), bool)
        is_letter[small] = letter[text[small]]
        rest = np.flatnonzero(~small)
        is_letter[rest] = [chr(x).isalpha() for x in text[rest].tolist()]
        c[rest[~is_letter[rest]]] = 32
    seen = np.zeros(len(text) + 1, np.int64)
    np.cumsum(is_letter, out=seen[1:])
    out = []
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        m = len(c) - n
        if m <= 0:
            out.append(np.full(len(c), ORDERS << bits, np.int32))
            continue
        h[:m] = (h[:m] + c[n:] + np.uint32(1)) * _MUL[n]
        x = h ^ (h >> np.uint32(15))
        col = ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32) + np.int32(n << bits)
        for back in range(1, n + 1):
            gone = at[1:] - back
            col[gone[gone >= at[:-1]]] = ORDERS << bits
        out.append(col)
    return out, at, np.diff(seen[at])


@dataclass
class Bayes:
    languages: list[str]
    matrix: np.ndarray  # (ORDERS << bits) + 1, languages: log-probabilities; the last row is 0
    prior: np.ndarray
    bits: int = BITS

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``languages`` (-1: und) and posterior of each row."""
        n = len(off) - 1
        best, score = np.full(n, -1), np.zeros(n)
        if not self.languages:
            return best, score
        wide = len(self.languages)
        # a row costs its bytes and its totals
        for i, j in spans_of(off + np.arange(n + 1) * 8 * wide, 1 << 20):
            cols, at, letters = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], self.bits)
            total = np.tile(self.prior, (j - i, 1))
            full = np.flatnonzero(np.diff(at))
            for col in cols:
                for a, b in zip(*_pieces(full, at, max(1024, CELLS // wide)), strict=True):  # long rows in pieces of bounded size
                    total[a[0]] += np.add.reduceat(self.matrix[col[b[0] : b[1]]], a[1], axis=0, dtype=np.float64)
            k = total.argmax(1)
            p = np.exp(total - total.max(1, keepdims=True))
            ok = letters > 0
            best[i:j][ok] = k[ok]
            score[i:j][ok] = (1 / p.sum(1))[ok]
        return best, score


def _pieces(full: np.ndarray, at: np.ndarray, size: int) -> tuple[list, list]:
    """Groups of rows with about ``size`` characters, with the row starts inside each; a longer row is read in parts."""
    rows, spans = [], []
    i = 0
    while i < len(full):
        j = i
        while j < len(full) and (j == i or at[full[j] + 1] - at[full[i]] <= size):
            j += 1
        a, b = int(at[full[i]]), int(at[full[j - 1] + 1])
        if j == i + 1 and b - a > size:
            for s in range(a, b, size):
                rows.append((full[i:j], np.zeros(1, np.int64)))
                spans.append((s, min(b, s + size)))
        else:
            rows.append((full[i:j], at[full[i:j]] - a))
            spans.append((a, b))
        i = j
    return rows, spans


def train(rows: list[tuple[int, str, str]], counts: dict[str, int]) -> Bayes:
    texts: dict[str, list[bytes]] = {}
    for _, t, y in rows:
        texts.setdefault(y, []).append(t.encode())
    languages = [x for x in counts if x in texts]
    bits = bits_for(len(languages))
    n = (ORDERS << bits) + 1
    matrix = np.zeros((n, len(languages)), np.float32)
    for k, lang in enumerate(languages):
        seen = np.zeros(n, np.int64)
        for raw in texts[lang]:
            for col in grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), bits)[0]:
                seen += np.bincount(col, minlength=n)
        for o in range(ORDERS):
            part = seen[o << bits : (o + 1) << bits] + ALPHA
            matrix[o << bits : (o + 1) << bits, k] = np.log(part / part.sum())
    prior = np.log(np.array([counts[x] for x in languages], float) / max(1, sum(counts[x] for x in languages))) if languages else np.zeros(0)
    return Bayes(languages, matrix, prior, bits)


def fit(docs: DataFrame) -> Bayes:
    """Learns from text and non-null lang of documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("label")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked, counts = sample_ids(rows.select("doc_id", "label"), PER_CLASS)
    return train(learnt(sample_texts(rows, picked, TRAIN_BYTES), counts, "a language"), counts)


def language(docs: DataFrame, model: Bayes | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = shared.value
        names = np.array([*bayes.languages, "und"], object)
        for b in batches:
            k, p = bayes.predict(*bytes_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[k], pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
