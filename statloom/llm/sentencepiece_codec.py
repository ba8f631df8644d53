"""SentencePiece BPE encoding and decoding in numpy, by merge rounds over distinct words.

A text is cut before each run of spaces; no piece of such a vocabulary goes
across that cut (checked when the model is read), so each distinct segment is
encoded once for a slice of a few megabytes. All segments' symbols lie in one flat
array. A round finds the best rank of a pair in each segment (a segmented
minimum), merges the leftmost occurrences of it that don't overlap, all at
once, and compacts the array, until no pair is left. Where a merge made at
once with another would have opened a better pair, only the first is made.

Empty and null texts give the begin and end ids alone. Very long texts are
whole. Other columns are passed on, but for those that a result of the same name replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared
from .textbatch import flat, slices, spans

NO_RANK = np.int32(2**31 - 1)
SLICE = 2 << 20
UNKNOWN = 1 << 22  # a code point without a piece is the symbol UNKNOWN + code point


class Codec:
    """A BPE model with byte fallback, an identity normaliser and a dummy prefix; its size is bounded by its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        texts = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = np.zeros(256, np.int64)
        pieces: list[bytes] = []
        for i, text in enumerate(texts):
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                pieces.append(bytes([int(text[3:5], 16)]))
                special.add(i)
            else:
                pieces.append(b"" if i in special else text.replace("▁", " ").encode())
        ids = {text: i for i, text in enumerate(texts) if i not in special}
        if any("▁" in text.lstrip("▁") for text in ids):
            raise ValueError("a piece goes across a word's start")
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        single = sorted((ord(text), i) for text, i in ids.items() if len(text) == 1)
        self.points, self.point_ids = (np.array(x, np.int64) for x in zip(*single, strict=True))

        def symbol(text: str) -> int | None:
            return ids.get(text, UNKNOWN + ord(text) if len(text) == 1 else None)

        pairs = []
        for text, i in ids.items():
            for k in range(1, len(text)):
                left, right = symbol(text[:k]), symbol(text[k:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, rank[i]))
        self.pair_keys, ranks = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        self.pair_ranks, self.by_rank = ranks.astype(np.int32), np.array(order, np.int64)
        self.piece_ends = np.cumsum([0, *map(len, pieces)])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def segments(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments of code points (a space as U+2581), and where each segment's begin, with the end."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_ids[at], UNKNOWN + points)
        word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.ranks(symbols[:-1], symbols[1:]), NO_RANK)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            going = best < NO_RANK
            if not going.all():
                keep = np.repeat(going, sizes)
                done.append((word[~keep], symbols[~keep]))
                symbols, word, rank = symbols[keep], word[keep], rank[keep]
                best, sizes = best[going], sizes[going]
                if not len(symbols):
                    break
            symbols, word, rank = self._round(symbols, word, rank, best, sizes)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbols = self._bytes(word[order], symbols[order])
        return symbols, np.searchsorted(word, np.arange(len(bounds)))

    def _round(self, symbols, word, rank, best, sizes):
        least = np.repeat(best, sizes)
        place = np.arange(len(rank))
        hit = rank == least
        # alternate ones of a run of overlapping occurrences, from the left
        run = np.maximum.accumulate(np.where(hit, -1, place))
        take = hit & ((place - run) % 2 == 1)
        while True:
            at = np.flatnonzero(take)
            new = symbols.copy()
            new[at] = self.by_rank[rank[at]]
            stay = np.ones(len(rank), bool)
            stay[at + 1] = False
            now, kept_word, kept_rank, kept_least, changed = new[stay], word[stay], rank[stay], least[stay], take[stay]
            fresh = changed.copy()
            fresh[:-1] |= changed[1:]
            look = np.flatnonzero(fresh[:-1])
            kept_rank[look] = np.where(kept_word[look] == kept_word[look + 1], self.ranks(now[look], now[look + 1]), NO_RANK)
            if len(now) and fresh[-1]:
                kept_rank[-1] = NO_RANK
            better = look[kept_rank[look] < kept_least[look]]
            if not len(better):
                return now, kept_word, kept_rank
            count = np.bincount(word[at], minlength=word[-1] + 1)
            redo = np.zeros(word[-1] + 1, bool)
            redo[kept_word[better]] = True
            redo &= count > 1
            if not redo.any():
                return now, kept_word, kept_rank
            first = np.zeros(len(rank), bool)
            first[at[np.unique(word[at], return_index=True)[1]]] = True
            take = take & (first | ~redo[word])

    def _bytes(self, word: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece become the ids of their bytes."""
        bad = symbols >= UNKNOWN
        if not bad.any():
            return word, symbols
        points = symbols[bad] - UNKNOWN
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        text = np.frombuffer("".join(map(chr, points)).encode(), np.uint8)
        counts = np.ones(len(symbols), np.int64)
        counts[bad] = sizes
        out = np.repeat(symbols, counts)
        out[np.repeat(bad, counts)] = self.byte_ids[text]
        return np.repeat(word, counts), out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids with begin and end ids, and where each text's begin, with the end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        if pc.any(pc.match_substring(texts, "▁")).as_py():
            texts = pc.replace_substring(texts, "▁", " ")
        data, ends = flat(texts)
        full = np.diff(ends) > 0
        # the dummy prefix: a space before each text that isn't empty
        starts = ends[:-1] + np.cumsum(full) - full
        bounds = np.r_[starts, len(data) + full.sum()]
        buffer = np.full(bounds[-1], 32, np.uint8)
        own = np.ones(len(buffer), bool)
        own[starts[full]] = False
        buffer[own] = data
        blank = buffer == 32
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        cut[starts[full]] = True
        cuts = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(
            pa.large_binary(), len(cuts), [None, pa.py_buffer(np.r_[cuts, len(buffer)].astype(np.int64)), pa.py_buffer(buffer)]
        ).dictionary_encode()
        codes, distinct = segments.indices.to_numpy(zero_copy_only=False), segments.dictionary
        doc_cuts = np.searchsorted(cuts, bounds)
        joined = b"".join(distinct.to_pylist()).decode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        head = np.frombuffer(distinct.cast(pa.large_binary()).buffers()[2] or b"", np.uint8)
        limits = np.frombuffer(
            distinct.cast(pa.large_binary()).buffers()[1], np.int64
        )[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
        leads = np.r_[0, np.cumsum((head[: limits[-1]] & 0xC0) != 0x80)]
        points[points == 32] = 0x2581
        ids, at = self.segments(points, leads[limits])
        sizes = np.diff(at)[codes]
        body = ids[spans(at[codes], sizes)]
        total = np.r_[0, np.cumsum(sizes)][doc_cuts]
        out_ends = total + 2 * np.arange(n + 1)
        out = np.empty(out_ends[-1], np.int64)
        inner = np.ones(len(out), bool)
        inner[out_ends[:-1]] = inner[out_ends[1:] - 1] = False
        out[out_ends[:-1]], out[out_ends[1:] - 1] = self.bos, self.eos
        out[inner] = body
        return out, out_ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of each text, and where each text's begin, with the end. One leading space, the dummy prefix, goes."""
        sizes = np.diff(self.piece_ends)[ids]
        data = self.piece_bytes[spans(self.piece_ends[ids], sizes)]
        bounds = np.r_[0, np.cumsum(sizes)][ends]
        first = bounds[:-1][np.diff(bounds) > 0]
        keep = np.ones(len(data), bool)
        keep[first[data[first] == 32]] = False
        return data[keep], np.r_[0, np.cumsum(keep)][bounds]


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (array of int)."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * keep_ids
    others = shared.others(docs, (f.name for f in new), *[text][keep_ids:])
    schema = T.StructType([docs.schema[c] for c in others] + new)
    codec = Codec(path)  # bounded by the vocabulary, so the task's closure carries it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            ids, ends = codec.encode(batch[text])
            data, bounds = codec.decode(ids, ends)
            raw, plain = memoryview(ids.astype("<u4")).cast("B"), memoryview(data)
            cols = [batch[c] for c in others]
            cols.append(pa.array(np.diff(ends), pa.int64()))
            cols.append(
                pa.array(
                    [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)],
                    pa.string(),
                )
            )
            cols.append(
                pa.array(
                    [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
                    pa.string(),
                )
            )
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*{c: None for c in [*others, text]}).mapInArrow(run, schema)
