"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct word shingles (64-bit hashes; A-Z folded); equal sets are one class. The sketch
of a set has ``BINS`` coordinates. In round i every element is thrown into a random bin with a random value; a bin
keeps the least value of the first round that reaches it, and the sketch is done when every bin is filled. From round
``BINS`` on, round i throws all elements into bin i - BINS, so after 2 BINS rounds at the latest none is empty. A
set of n elements needs about BINS log(BINS) / n rounds, one or two for an ordinary document, instead of the
BINS hashes an element of plain MinHash; still, each coordinate of two sets agrees with the probability of their
Jaccard similarity, and the number that agree is as concentrated about it as in independent draws.

Bands of ``ROWS`` coordinates are the keys by which classes meet (``cells``): a pair at a similarity of 0.85 shares
none of the bands with a probability of about 1e-9. Where they meet, pairs with fewer than ``AGREE`` of their coordinates in common
are passed over (at 0.85 with a probability below 1e-14); every other pair is confirmed on the full sets, or
stands inside one component already.

Cases: a null or empty text, or one without a word, has size 0 and links with nothing; fewer words than a shingle
has are one shingle; repeated rows are copies; a null doc_id counts after all others and is kept where its
component has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.cells import linked
from wardspark.llm.common import mix64

ROWS, BANDS = 5, 36
BINS = ROWS * BANDS
AGREE = 0.6
AT_ONCE = 1 << 18              # throws of one step
_TURN = np.uint64(0x9E3779B97F4A7C15)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS coordinates for each (non-empty) set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    best = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    done, step = 0, 1
    while done < 2 * BINS and len(elements):
        for i in range(0, len(elements), AT_ONCE):
            x, own = elements[i:i + AT_ONCE, None], owner[i:i + AT_ONCE, None]
            turn = np.arange(done, min(done + step, 2 * BINS), dtype=np.uint64)
            h = mix64(x + (turn + np.uint64(1)) * _TURN)
            bin_ = np.where(turn < BINS, h % np.uint64(BINS), turn % np.uint64(BINS)).astype(np.int64)
            # the round leads, so a later one never takes a filled bin
            value = (turn << np.uint64(48)) | (mix64(h) >> np.uint64(16))
            np.minimum.at(best, (own * BINS + bin_).ravel(), value.ravel())
        done += step
        open_ = (best.reshape(-1, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_[owner]
        elements, owner = elements[keep], owner[keep]
        step = max(1, min(64, AT_ONCE // max(1, len(elements)), done))
    return best.reshape(-1, BINS)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    part = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * _TURN), part.shape[:2])
    for r in range(ROWS):
        key = mix64(key * _TURN + part[:, :, r])
    return key


def _describe():
    """In a task: sets -> (a byte of each coordinate, keys of the bands)."""
    def tell(sets):
        if not sets:
            return []
        s = sketches(sets)
        small = (mix64(s) >> np.uint64(56)).astype(np.uint8)
        return [(m.tobytes(), k) for m, k in zip(small, bands(s))]
    return tell


def _survivors(marks, sizes, side, lone, percent):
    """Pairs (i, j, share of coordinates that agree) that may reach the threshold."""
    m = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(len(marks), BINS)
    at, found = np.arange(len(m)), []
    for i in at if lone else np.flatnonzero(side == 0):
        j = np.flatnonzero((at > i if lone else side == 1) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        same = (m[j] == m[i]).sum(axis=1)
        ok = same >= AGREE * BINS
        found.append((np.full(ok.sum(), i), j[ok], same[ok] / BINS))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """-> (doc_id, n_shingles, component_id, kept): documents whose sets of ``k``-word shingles have a Jaccard similarity of
    ``percent`` are linked; the one with a component's smallest doc_id is kept. The bands are made for 85 or more."""
    if percent < 85:
        raise ValueError("the bands are made for thresholds of 85 or more")
    found = linked(docs, k, percent, _describe, _survivors, "fss")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
