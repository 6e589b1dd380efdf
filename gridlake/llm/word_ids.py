"""Token ids of whole texts from the ids of their distinct words, gathered over Arrow string columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes taken together; one text is never cut.
SLICE_BYTES = 4 << 20

Blobs = Callable[[list[str]], list[bytes]]


def parts(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive rows of about so many bytes; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def gather(texts: pa.Array, later: Blobs, first: Blobs | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts cut at single spaces: each distinct word's ids are asked for once.

    later and first give the ids of words, as bytes of unsigned 32-bit numbers; first, where given, of the words that
    begin a text. The ids of text i are ids[offsets[i] : offsets[i + 1]].
    """
    cut = pc.split_pattern(texts, " ")
    word_at = cut.offsets.to_numpy().astype(np.int64)
    word_at -= word_at[0]
    coded = cut.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blobs = later(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    if first is not None:
        begun = cut.flatten().take(pa.array(word_at[:-1])).dictionary_encode()
        codes[word_at[:-1]] = len(blobs) + begun.indices.to_numpy(zero_copy_only=False)
        blobs = blobs + first(begun.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    pool, begins = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(sizes) - sizes
    taken = sizes[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
    small = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((begins[codes] - ends[:-1]).astype(small), taken)
    at += np.arange(ends[-1], dtype=small)
    ids = pool[at]
    return ids, ends[word_at]
