"""Token counts under a piece model (BPE with byte fallback), by rank-synchronous merging of ragged arrays.

The model's text form puts a blank before the text and no piece has a blank after another character, so a text falls into
pre-tokens (blanks, then characters other than blanks) that merge independently.  The pre-tokens of a block that the worker has not counted yet are held
end to end in arrays and merged together: every round applies each sequence's lowest-rank pair.  What survives is counted;
a character without a piece counts its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.arrays import SliceCache
from mailposture.llm.blocks import pieces, tidy
from mailposture.llm.merging import PairTable, merge_all

BLANK = "▁"
CACHE_ENTRIES = 500_000


class PieceCounter:
    """Counter of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = {
            model.id_to_piece(k): k
            for k in range(size)
            if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))
        }
        for name in names:
            if BLANK in name.lstrip(BLANK):
                raise ValueError(f"piece {name!r} has a blank after another character; pre-tokens would not be independent")
        # equal scores are equal ranks: such ties go to the leftmost pair
        scores = -np.array([model.get_score(k) for k in range(size)])
        ranks = np.unique(scores, return_inverse=True)[1]
        pairs = [(a, b, k) for name, k in names.items() for i in range(1, len(name)) if (a := names.get(name[:i])) is not None and (b := names.get(name[i:])) is not None]
        # a pair may also join characters that have no piece of their own; they get symbols above the pieces
        self.chars = {name: k for name, k in names.items() if len(name) == 1}
        self.extra: dict[str, int] = {}
        for name, k in names.items():
            for i in range(1, len(name)):
                a, b = name[:i], name[i:]
                lone = [c for c in (a, b) if len(c) == 1 and c not in names]
                if lone and all(c in names or len(c) == 1 for c in (a, b)):
                    for c in lone:
                        self.extra.setdefault(c, size + len(self.extra))
                    symbol = lambda c: names.get(c, self.extra.get(c))
                    pairs.append((symbol(a), symbol(b), k))
        self.size = size
        left, right, merged = map(np.array, zip(*pairs))
        self.table = PairTable(left, right, merged, ranks)
        self.cache = SliceCache(self._learn, CACHE_ENTRIES)
        top = 0x110000
        self.symbol = np.arange(top, dtype=np.int64) + size + len(self.extra)  # unknown characters: symbols that merge with nothing
        self.bytes_of = np.ones(top + size + len(self.extra), np.int64)
        points = np.arange(top)
        self.bytes_of[size + len(self.extra) :] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        for c, k in [*self.chars.items(), *self.extra.items()]:
            self.symbol[ord(c)] = k
        for c, k in self.extra.items():
            self.bytes_of[k] = len(c.encode())

    def _learn(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of tokens of each distinct pre-token."""
        joined = b"".join(slices)
        raw = np.frombuffer(joined, np.uint8)
        points = np.frombuffer(joined.decode().replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, slices), np.int64, len(slices)))
        lengths = np.diff(np.append(0, np.cumsum((raw & 0xC0) != 0x80)[ends - 1]))
        left, sizes = merge_all(self.symbol[points], lengths, self.table)
        cost = np.append(0, np.cumsum(self.bytes_of[left]))
        ends = np.cumsum(sizes)
        return cost[ends] - cost[ends - sizes], np.ones(len(slices), np.int64)

    def count(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text; the texts stand end to end and each begins with the blank that the model adds."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(len(offsets) - 1, np.int64)
        starts = np.zeros(len(raw), bool)
        starts[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(starts)
        sums = np.append(0, np.cumsum(self.cache.values(data, at)[0]))
        return np.diff(sums[np.searchsorted(at, offsets)])


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@tidy
def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = counter(path)
    mark = BLANK.encode()
    for batch in batches:
        size, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        begun: set[int] = set()
        for block in pieces(batch.column(1)):
            view, bounds = block.data, block.offsets.tolist()
            parts = []
            for row, a, b in zip(block.rows.tolist(), bounds, bounds[1:]):
                if b > a:
                    size[row] += b - a
                    text = view[a:b].replace(mark, b" ")
                    parts.append(text if row in begun else b" " + text)
                    begun.add(row)
                else:
                    parts.append(b"")
            offsets = np.append(0, np.cumsum([len(p) for p in parts]))
            np.add.at(tokens, block.rows, model.count(b"".join(parts), offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every text under the piece model at ``path``.

    Without begin and end tokens; strings of special tokens are ordinary text.  Null and empty texts have 0 bytes and 0 tokens.
    Rows repeat as they do in the input; other columns are not looked at.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: _counted(b, path), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
