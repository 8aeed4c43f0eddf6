"""Fill-in-the-middle: texts cut at token ranks found by succinct rank and select.

A token is a run of ASCII letters or any other single code point.  The bytes of many texts lie
end to end, and a packed bitvector marks those that begin a token; a directory holds the number
of marks before each block of ``BLOCK`` words of 64 bits.  Rank adds a block's entry and the popcounts of its
words up to a place; select finds the block in the directory, then the word, then the bit.  The
ranks at a text's two ends give its number of tokens n, and two selects give the bytes of its cuts.  A
second bitvector marks the bytes that begin a code point, and its ranks give lengths in characters.

Each text draws its two cuts, its form and its order from the SHA-256 of ``1:`` and its id, so a
rerun on any cluster cuts alike.  ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle; a
text that is empty or holds a mark stays plain, as does a tenth of the rest.

Scale: one Arrow pass without a shuffle; a task holds the bits of about ``PIECE`` bytes of texts
or of one longer text (a quarter of its bytes, and some copies of it while it is cut).

Defined cases: a null text is empty and plain; a null id is the empty string in the draw;
rows that repeat are cut alike, one by one; extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits to an entry of the directory.
BLOCK = 8
PIECE = 1 << 22
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Marks:
    """A packed bitvector with a popcount directory: rank and select over many places at once."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits)
        words = np.zeros((len(packed) // 8 // BLOCK + 1) * BLOCK, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.byteswap() if sys.byteorder == "little" else words
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK)
        self.directory = np.concatenate([[0], np.cumsum(counts.sum(axis=1, dtype=np.int64))])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of marks before each place."""
        word, bit = np.divmod(np.asarray(at, np.int64), 64)
        block, nth = np.divmod(word, BLOCK)
        inside = self.words.reshape(-1, BLOCK)[block]
        before = np.where(np.arange(BLOCK) < nth[:, None], np.bitwise_count(inside), 0).sum(axis=1, dtype=np.int64)
        # A shift by 64 is undefined, so it is done in two.
        top = (self.words[word] >> np.uint64(1)) >> (63 - bit).astype(np.uint64)
        return self.directory[block] + before + np.bitwise_count(top)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of each mark, counted from 0; ``rank`` is below ``total``."""
        rank = np.asarray(rank, np.int64)
        block = np.searchsorted(self.directory, rank, side="right") - 1
        left = rank - self.directory[block]
        upto = np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]), axis=1, dtype=np.int64)
        nth = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(nth > 0, np.take_along_axis(upto, np.maximum(nth - 1, 0)[:, None], axis=1)[:, 0], 0)
        word, bit = self.words[block * BLOCK + nth], np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the last place with no more than ``left`` marks before it
            fits = np.bitwise_count(word >> (64 - bit - half).astype(np.uint64)) <= left
            bit += np.where(fits, half, 0)
        return (block * BLOCK + nth) * 64 + bit


def token_marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a token, and which a code point; ``starts`` are the places where texts begin."""
    letter, point = _LETTER[data], (data & 0xC0) != 0x80
    token = point.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[starts[starts < len(data)]] = True
    return token, point


def _draws(doc_id: Column) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def _cut(data: np.ndarray, edges: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, the places of both cuts, and the characters before and between them, of the texts ``data[edges[i]:edges[i + 1]]``."""
    tokens, points = (Marks(x) for x in token_marks(data, edges[:-1]))
    first = tokens.rank(edges)
    n = np.diff(first)
    ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = []
    for k in ranks.T:
        inside = k < n
        at = edges[1:].copy()  # after the last token: the text's end
        at[inside] = tokens.select((first[:-1] + k)[inside])
        cuts.append(at)
    before, one, two = points.rank(edges[:-1]), points.rank(cuts[0]), points.rank(cuts[1])
    return n, cuts[0], cuts[1], one - before, two - one


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, side="right")) - 1)
        yield at, stop
        at = stop


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row a document.

    Of 100 draws those of ``plain_from`` or more leave a text plain; of the rest those below ``spm_below`` put the suffix first.
    """
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _draws(F.col(id_col)).alias("draws")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in _slices(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)):
                batch = whole.slice(a, b - a)
                texts = [x.as_py() for x in batch.column(1).cast(pa.large_binary())]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
                h = batch.column(2).flatten().to_numpy().reshape(-1, 4)
                n, one, two, prefix, middle = _cut(np.frombuffer(b"".join(texts), np.uint8), edges, h)
                forms, outputs = [], []
                for i, t in enumerate(texts):
                    if not t or h[i, 2] % 100 >= plain_from or any(m in t for m in marks):
                        forms.append("plain")
                        outputs.append(t)
                        continue
                    p, q = one[i] - edges[i], two[i] - edges[i]
                    forms.append("spm" if h[i, 3] % 100 < spm_below else "psm")
                    parts = (marks[0], t[:p], marks[1], t[q:]) if forms[-1] == "psm" else (marks[1], t[q:], marks[0], t[:p])
                    outputs.append(b"".join((*parts, marks[2], t[p:q])))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(forms), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; no mark can arise where parts meet, so the split is exact."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix_first = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    suffix_first = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", prefix_first).otherwise(suffix_first)
