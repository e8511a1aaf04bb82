"""Quality rules by compression bands.

Noise compresses too badly and repetition too well. The zstandard ratio (compressed bytes by bytes) of the whole text
must lie in a band that depends on its length, and so must those of its chunks: a text with more than a tenth of its bytes in
chunks outside their bands goes too, even when its mean looks right, as that of prose with a stretch of noise does. Table bars, symbol tails and padding compress to almost
nothing, so they dilute a text: its ratio falls below that of the same text without ASCII punctuation and with single
spaces. The quotient of the two ratios, near 1 in prose whatever its vocabulary, has a lower limit as well.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .common import filter_rows, map_slices, words_of

#: Upper ends of length classes in bytes, and each class's greatest ratio and least dilution. The limits lie about 0.01
#: outside the range of the good documents (labelled 1, base rules passed; ratios of 83,352 of check_l, dilutions of 3,243
#: of sf0.1) and of all their chunks, partial last ones included, which alone give the limits below 200 bytes.
LENGTH_ENDS = (25, 50, 100, 141, 200, 282, 400, 565, 800, 1131, 1600, 2262, 3200, 4525, 6400, 9050, 12800)
MOST_RATIO = (99.0, 1.45, 1.20, 1.00, 0.87, 0.81, 0.78, 0.75, 0.71, 0.66, 0.62, 0.585, 0.555, 0.525, 0.51, 0.49, 0.475, 0.465)
LEAST_DILUTION = (0.0, 0.97, 0.97, 0.97, 0.97, 0.97, 0.97, 0.97, 0.97, 0.98, 0.98, 0.98, 0.98, 0.98, 0.98, 0.98, 0.98, 0.98)
#: Least ratios: about three quarters of the least good one, as clean texts of few syllables compress below all of them.
LEAST_RATIO = (0.0, 0.90, 0.62, 0.56, 0.52, 0.48, 0.43, 0.41, 0.39, 0.37, 0.36, 0.35, 0.34, 0.33, 0.32, 0.32, 0.31, 0.30)
#: Chunks, the share of a text's bytes that may lie in bad ones, and what a text is stripped of to measure its dilution.
CHUNK_BYTES = 4096
BAD_CHUNKS = 0.1
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    window = ids[:n]
    for step in range(1, width):
        if len(seen) ** 2 >= 2**62:
            raise ValueError("a text has too many distinct words")
        window = window * len(seen) + ids[step : step + n]
        window = np.unique(window, return_inverse=True)[1] if step < width - 1 and len(seen) ** 3 >= 2**62 else window
    _, where, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(len(words), bool)
    for step in range(width):
        covered[step : step + n] |= twice
    return int(covered.sum())


def measured(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bool, float]:
    """Whether a text or chunk lies within the limits of its length, and its ratio."""
    kind = bisect_left(LENGTH_ENDS, len(raw))
    ratio = len(packer.compress(raw)) / len(raw)
    if not LEAST_RATIO[kind] <= ratio <= MOST_RATIO[kind]:
        return False, ratio
    bare = b" ".join(raw.translate(None, PUNCTUATION).split())
    least = LEAST_DILUTION[kind]
    return not least or bool(bare) and ratio * len(bare) >= least * len(packer.compress(bare)), ratio


def in_bands(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """The method's verdict on a text, its ratio and the share of its bytes that lie in chunks outside their limits."""
    if not raw:
        return False, 0.0, 0.0
    good, ratio = measured(raw, packer)
    if len(raw) <= CHUNK_BYTES:
        return good, ratio, float(not good)
    chunks = (raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES))
    share = sum(len(c) for c in chunks if not measured(c, packer)[0]) / len(raw)
    return good and share <= BAD_CHUNKS, ratio, share


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """All columns but doc_id for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len((text or "")) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    good, ratio, share = in_bands(raw, packer)
    return len(words), chars, sum(raw.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines)), repeated, failed, good and not failed, ratio, share


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, the base rules' verdict and ``kept``.

    Null and empty texts have no words and fail, a null id is kept. Repeated rows are judged each by itself, alike. A ratio on
    a limit is within it. A text of any length is read whole, in chunks of which the last may be short. An empty table gives
    an empty result. Other columns of ``docs`` are not read and cannot clash. No shuffle; a task holds a slice of rows.
    """

    def run(ids: list, texts: list) -> Iterator[tuple]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for i, text in zip(ids, texts):
            yield i, *judge(text, packer)

    return map_slices(docs.select(id_col, text_col), run, COLUMNS)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, repeated ones each, with all columns unchanged, whatever their names.

    Null and empty texts go, long texts are judged whole. An empty table gives an empty result.
    """

    def keep(texts: list) -> list[bool]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return [judge(t, packer)[6] for t in texts]

    return filter_rows(docs, text_col, keep)


__all__ = ["assess", "keep_good", "repeated_words", "words_of"]
