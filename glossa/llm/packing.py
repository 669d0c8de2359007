"""Vector best-fit packing of tokenised documents into sequences.

Tokens are counted once, by a map over the documents; only pieces' lengths are packed. Pieces are dealt at random into
groups of about ``GROUP`` and each group is packed on its own, longest first: a bin has capacities for
tokens, documents and attention cost (the sum of squared lengths), a piece goes into a bin that has room for it under every
capacity, chosen by the smallest weighted residual norm (the tightest fit) or the largest weighted dot product.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm._arrays import filled, slices, words
from glossa.llm._common import checkpoint

LENGTH = 2048
#: Pieces per group; a group leaves at most a few bins unfilled.
GROUP = 12_000
#: Letters that are as NFC has them and have simple lower-case forms, then ASCII punctuation but no apostrophe.
PLAIN_WORD = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"
#: Weights of the residual tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 1e-3, 1e-3)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """Token ids of many texts.

    The tokenizer never looks across white space, so each different word is encoded once. A word of Latin-1 letters with
    ASCII punctuation after it, as most are, is two pre-tokens; those of letters are normalised here and
    encoded many at a time, their last ids marked by the vocabulary's word end. All else goes through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _letters(self, unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(unique[i : i + 200]) for i in range(0, len(unique), 200)]
        ids = [np.array(e.ids, np.uint32) for e in self.letters.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(unique):  # a vocabulary without word ends
            return self._whole(unique)
        return flat, np.diff(ends, prepend=0)

    def _whole(self, unique: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.whole.encode_batch(unique, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 offsets."""
        index, offsets, unique = words(texts, lower=False)
        match = pc.extract_regex(unique, PLAIN_WORD)
        plain = match.is_valid().to_numpy(zero_copy_only=False)
        core, tail = (match.filter(match.is_valid()).field(i).dictionary_encode() for i in (0, 1))
        low = pc.utf8_lower(core.dictionary).dictionary_encode()
        units = [self._letters(low.dictionary.to_pylist()), self._whole(tail.dictionary.to_pylist()), self._whole(unique.filter(pa.array(~plain)).to_pylist())]
        flat = np.concatenate([u[0] for u in units])
        size = np.concatenate([u[1] for u in units])
        start = np.cumsum(size) - size
        base = np.cumsum([0, *(len(u[1]) for u in units)])
        # each different word is two units; of a word that is not plain the second is empty
        pair = np.empty((len(unique), 2), np.int64)
        pair[plain, 0] = low.indices.to_numpy()[core.indices.to_numpy()]
        pair[plain, 1] = base[1] + tail.indices.to_numpy()
        pair[~plain, 0] = base[2] + np.arange(int((~plain).sum()))
        pair[~plain, 1] = len(size)
        size, start = np.append(size, 0), np.append(start, 0)
        of_words = flat[_spans(start[pair.ravel()], size[pair.ravel()])]
        size = size[pair].sum(1)
        start = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[index])])
        return of_words[_spans(start[index], size[index])], ends[offsets]


def cut_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: each document's ids, then id 0, in pieces of ``length`` at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, serial = WordIds(tokenizer_path), 0
        for batch in slices(batches, most=3 << 20):
            ids, offsets = ids_of(filled(batch.column("text")))
            n = len(offsets) - 1
            sizes = np.diff(offsets) + 1
            closed = np.zeros(len(ids) + n, "<u4")
            closed[np.arange(len(ids)) + np.repeat(np.arange(n), sizes - 1)] = ids
            firsts = np.cumsum(sizes) - sizes
            count = -(-sizes // length)
            row = np.repeat(np.arange(n), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(length, sizes[row] - start)
            at = firsts[row] + start
            view = memoryview(closed).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, size, crc, serial + np.arange(len(row))))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )
            serial += len(row)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, salt long"
    )


def best_fit(
    lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; pieces are taken longest first, ties in the given order."""
    caps = np.array(capacity, float)
    n = len(lengths)
    which, place = np.empty(n, np.int64), np.empty(n, np.int64)
    room, number, opened = np.empty((3, n + 1)), np.empty(n + 1, np.int64), 0
    used = 0  # columns in use; filled bins are thrown out now and then
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    scale = np.array(weights) / caps**2
    for step, i in enumerate(order):
        if step % 256 == 255:
            live = np.flatnonzero((room[0, :used] >= least) & (room[1, :used] >= 1) & (room[2, :used] >= least * least))
            room[:, : len(live)], number[: len(live)], used = room[:, live], number[live], len(live)
        need = np.array([lengths[i], 1, lengths[i] ** 2], float)
        r = room[:, :used]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= 1) & (r[2] >= need[2]))
        if len(fits):
            r = r[:, fits]
            score = scale @ (r - need[:, None]) ** 2 if rule == "norm" else -((scale * need) @ r)
            b = fits[int(np.argmin(score))]
        else:
            b = used
            room[:, b], number[b] = caps, opened
            used, opened = used + 1, opened + 1
        which[i], place[i] = number[b], int(caps[0] - room[0, b])
        room[:, b] -= need
    return which, place


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    max_docs: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer (special tokens' strings are ordinary text), then id 0; a null or empty text is that
    id alone. Only documents over ``length`` are cut. ``max_docs`` and ``max_attention`` bound a sequence's
    pieces and the sum of their squared lengths (a piece that alone exceeds the latter has a sequence of its own); None:
    no bound beyond the length. Pieces in a sequence lie without gaps from offset 0. Repeated rows are packed
    each; an empty table gives an empty result; other columns are ignored. Long texts count whole.
    """
    pieces = checkpoint(cut_pieces(docs, tokenizer_path, length, doc_id, text))
    groups = max(1, -(-pieces.count() // GROUP))
    capacity = (length, max_docs or length, max(max_attention or 0, 0) or length * length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "salt"], ignore_index=True)
        size = pdf["length"].to_numpy()
        own = (size == length) | (size**2 >= capacity[2])
        bins, offset = np.empty(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        rest = np.flatnonzero(~own)
        bins[rest], offset[rest] = best_fit(size[rest], capacity, rule=rule)
        bins[own] = np.arange(own.sum()) + (bins[rest].max() + 1 if len(rest) else 0)
        return pdf.assign(sequence_id=pdf["g"].astype("int64") * (1 << 32) + bins, offset=offset).drop(columns=["salt", "g"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInPandas(
        run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
