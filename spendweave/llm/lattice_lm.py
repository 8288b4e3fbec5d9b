"""Language-model scores of texts: the probability of a text over all its segmentations into subwords.

The vocabulary is that of a public subword tokenizer; its scores are minus a piece's rank, read as Zipf
weights ``1 / (rank + 1)``. They weight all segmentations of the training texts' words, and the expected
counts of pieces over the words, each as often as it occurs, summed by Spark, give the pieces' probabilities
(``EM_STEPS`` times). Every byte is a piece too, so each text has a segmentation. A word's probability is the sum over
all segmentations, by the forward recursion in log space; a text's is the product of its words and one end, each token
being an end or not as often as in training: that is ``score``. ``mixed_score`` adds one more arc to each lattice, over the whole
word: ``(c - DISCOUNT) / N`` for a word seen c times, and what the discounts leave weights the subword segmentations.
Words meet by a shuffle of the distinct words of blocks (``blocks.py``), so each word of the corpus is
counted and scored once, and one shuffle brings both to the texts.

Defined results: A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D. A null or empty
text is one end. A null id is held out. Without training rows all counts are 0, the pieces keep the weights
of their ranks, and the end costs nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.blocks import bucket_words, codes_of, lower_words, pack, to_blocks, unpack, with_values, words_of
from spendweave.llm.common import stored
from spendweave.llm.kernels import mix

PIECES = public_tokenizers.path("piece_bpe_32k.model")
EM_STEPS = 2
#: Taken from each seen word's count for the subword segmentations.
DISCOUNT = 0.5
PARTS = 10
#: Words with more bytes go one by one through the recursion, and so do those of a length that few others have.
LONG_BYTES = 256
START = "▁".encode()
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _hash_table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of pieces and their numbers."""
    powers = [pow(_BASE, k, 1 << 64) for k in range(max(map(len, pieces)))]
    found = np.array([sum((b + 1) * p for b, p in zip(piece, powers, strict=False)) + len(piece) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 for piece in pieces], np.uint64)
    order = np.argsort(mix(found))
    return mix(found)[order], order


def read_pieces(path: str = PIECES) -> tuple[list[bytes], np.ndarray]:
    """(pieces, Zipf weights): the vocabulary's ordinary pieces, then all bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [(model.id_to_piece(i).encode(), -model.get_score(i)) for i in range(model.vocab_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    own = [(p, r) for p, r in own if len(p) > 1]
    last = 1 + max(r for _, r in own)
    return [p for p, _ in own] + [bytes([b]) for b in range(256)], np.array([1 / (r + 1) for _, r in own] + [1 / last] * 256)


class _Lattice:
    """Forward and backward recursions: over many words of one length at once, or over the arcs of one word."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.table, self.order = _hash_table(pieces)
        self.log_p = log_p
        self.maybe = np.zeros(1 << 20, bool)  # the first 20 bits of the pieces' hashes
        self.maybe[(self.table >> np.uint64(44)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in pieces})

    def _arcs(self, data: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers (or -1) by start and length for words as rows of bytes."""
        n = data.shape[1]
        arcs = {}
        powers, inverses = (np.array([pow(base, k, 1 << 64) for k in range(n)], np.uint64) for base in (_BASE, _BASE_INVERSE))
        sums = np.zeros((n + 1, len(data)), np.uint64)
        np.cumsum((data.T.astype(np.uint64) + np.uint64(1)) * powers[:, None], axis=0, out=sums[1:])
        for i in range(n):
            for size in self.lengths:
                if size <= n - i:
                    hashed = mix((sums[i + size] - sums[i]) * inverses[i] + np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
                    some = np.flatnonzero(self.maybe[(hashed >> np.uint64(44)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(self.table, hashed[some]), len(self.table) - 1)
                    hit = self.table[at] == hashed[some]
                    if hit.any():
                        found = np.full(len(data), -1)
                        found[some[hit]] = self.order[at[hit]]
                        arcs[i, size] = found
        return arcs

    def _log(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, self.log_p[number], -np.inf)

    def _forward(self, data: np.ndarray, arcs: dict) -> np.ndarray:
        ahead = np.full((data.shape[1] + 1, len(data)), -np.inf)
        ahead[0] = 0
        for i in range(data.shape[1]):
            for size in self.lengths:
                if (i, size) in arcs:
                    ahead[i + size] = np.logaddexp(ahead[i + size], ahead[i] + self._log(arcs[i, size]))
        return ahead

    def _word_arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, piece numbers) of one word's arcs in order of their ends."""
        data = np.frombuffer(START + word, np.uint8).astype(np.uint64) + np.uint64(1)
        total, found = np.zeros(len(data), np.uint64), []
        for size in range(1, min(self.lengths[-1], len(data)) + 1):
            total = total[:len(data) - size + 1] + data[size - 1:] * np.uint64(pow(_BASE, size - 1, 1 << 64))
            if size in self.lengths:
                hashed = mix(total + np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
                some = np.flatnonzero(self.maybe[(hashed >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.table, hashed[some]), len(self.table) - 1)
                hit = self.table[at] == hashed[some]
                found.append((some[hit], some[hit] + size, self.order[at[hit]]))
        starts, ends, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], numbers[order]

    @staticmethod
    def _sums(n: int, sources: np.ndarray, targets: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log sums over all paths to each of the places 0 to n from place 0, along arcs in order of their targets."""
        cuts, sources, logs = np.searchsorted(targets, np.arange(n + 2)).tolist(), sources.tolist(), logs.tolist()
        sums = [0.0] + [-math.inf] * n
        for place in range(1, n + 1):
            paths = [sums[sources[k]] + logs[k] for k in range(cuts[place], cuts[place + 1])]
            most = max(paths, default=-math.inf)
            if most > -math.inf:
                sums[place] = most + math.log(sum([math.exp(p - most) for p in paths]))
        return np.array(sums)

    @staticmethod
    def _by_length(words: list[bytes], rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(words' places, their bytes as rows), or without bytes the places of words to take one by one."""
        lengths = np.array([len(w) for w in words], np.int64) + len(START)
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            if n > LONG_BYTES or len(same) < n:
                yield same, None
                continue
            step = max(1, min(rows, 400_000 // n))
            for k in range(0, len(same), step):
                some = same[k:k + step]
                yield some, np.frombuffer(b"".join([START + words[i] for i in some]), np.uint8).reshape(len(some), n)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the sum over all segmentations."""
        out = np.zeros(len(words))
        with np.errstate(over="ignore", invalid="ignore"):
            for some, data in self._by_length(words):
                if data is None:
                    for w in some.tolist():
                        starts, ends, numbers = self._word_arcs(words[w])
                        out[w] = self._sums(len(START) + len(words[w]), starts, ends, self.log_p[numbers])[-1]
                else:
                    out[some] = self._forward(data, self._arcs(data))[-1]
        return out

    def _word_uses(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers, how often the word's segmentations use them)."""
        n = len(START) + len(word)
        starts, ends, numbers = self._word_arcs(word)
        logs = self.log_p[numbers]
        ahead = self._sums(n, starts, ends, logs)
        back_to = np.argsort(-starts, kind="stable")  # from the other end
        back = self._sums(n, n - ends[back_to], n - starts[back_to], logs[back_to])[::-1]
        return numbers, np.exp(ahead[starts] + logs + back[ends] - ahead[-1])

    def expected_counts(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often segmentations of the words, each so many times, use each piece."""
        out = np.zeros(len(self.log_p))
        with np.errstate(over="ignore", invalid="ignore"):
            for some, data in self._by_length(words):
                if data is None:
                    for w in some.tolist():
                        numbers, uses = self._word_uses(words[w])
                        np.add.at(out, numbers, uses * counts[w])
                    continue
                arcs = self._arcs(data)
                ahead = self._forward(data, arcs)
                back = np.full_like(ahead, -np.inf)
                back[-1] = 0
                for i in range(data.shape[1] - 1, -1, -1):
                    for size in self.lengths:
                        if (i, size) in arcs:
                            number = arcs[i, size]
                            arc = self._log(number) + back[i + size]
                            back[i] = np.logaddexp(back[i], arc)
                            use = np.exp(ahead[i] + arc - ahead[-1]) * counts[some]
                            real = number >= 0
                            out += np.bincount(number[real], weights=use[real], minlength=len(out))
        return out


def _train_rows(ids: pa.Array) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % PARTS != 0 for i in ids.to_pylist()], np.float64)


def _counted(rows: list[dict]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(distinct words, training counts, each row's words as numbers) of a bucket's rows."""
    number: dict[bytes, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in words_of(r["words"], r["size"])], np.int64) for r in rows]
    counts = np.zeros(len(number), np.int64)
    for r, c in zip(rows, codes, strict=True):
        counts[c] += unpack(r["marks"], r["n"])
    return list(number), counts, codes


def _vocabulary(blocks: DataFrame) -> DataFrame:
    """(words, counts) of training words, some thousands in a row."""

    def count(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, _codes = _counted([r for b in batches for r in b.to_pylist()])
        known = np.flatnonzero(counts)
        for k in range(0, len(known), 20_000):
            some = known[k:k + 20_000]
            blob = b"\xff".join([words[i] for i in some])
            yield pa.RecordBatch.from_arrays([
                pa.array([blob], pa.binary()), pa.array([counts[some].tobytes()], pa.binary()), pa.array([len(some)], pa.int64()), pa.array([int(counts[some].sum())], pa.int64())],
                names=["words", "counts", "n", "total"])

    return stored(bucket_words(blocks).groupBy("bucket").applyInArrow(count, "words binary, counts binary, n long, total long"), "lm-vocabulary")


def _fit(vocabulary: DataFrame, pieces: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Natural logs of the pieces' probabilities after EM from the vocabulary's weights."""
    log_p = np.log(weights / weights.sum())
    context = vocabulary.sparkSession.sparkContext
    for _ in range(EM_STEPS):
        state = context.broadcast((pieces, log_p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = _Lattice(*state.value), np.zeros(len(state.value[0]))
            for batch in batches:
                for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total += lattice.expected_counts(words.split(b"\xff"), np.frombuffer(counts, np.int64).astype(float))
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["piece", "uses"])

        uses = np.full(len(pieces), 0.1)
        summed = vocabulary.select("words", "counts").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        for row in summed.collect():  # a row for each piece of the vocabulary
            uses[row["piece"]] += row["uses"]
        log_p = np.log(uses / uses.sum())
        state.destroy()
    return log_p


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = PIECES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every row."""
    pieces, weights = read_pieces(path)
    blocks = stored(to_blocks(docs, id_col, text_col, lower_words, _train_rows), "lm-blocks")
    vocabulary = _vocabulary(blocks)
    own = F.crc32(F.col(id_col).cast("string").cast("binary")) % PARTS
    ends = docs.where(own != 0).count()
    sums = vocabulary.agg(F.sum("total"), F.sum("n")).first()
    n_train, distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    log_p = _fit(vocabulary, pieces, weights)
    state = docs.sparkSession.sparkContext.broadcast((pieces, log_p))
    seen = sums[1] or 0
    log_rest = float(np.log(DISCOUNT * seen / n_train)) if seen else 0.0
    log_end = float(np.log10(ends / n_train)) if ends else 0.0
    log_word = float(np.log10((n_train - ends) / n_train)) if n_train > ends else 0.0
    floor = float(np.log10(n_train + 0.1 * (distinct + 1)))

    def score_words(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        words, counts, codes = _counted(rows)
        pieces, log_p = state.value
        subwords = _Lattice(pieces, log_p).log_probabilities(words)
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - DISCOUNT, 0) / max(1, n_train))
        mixed = np.logaddexp(whole, subwords + log_rest) / np.log(10)
        scores = subwords / np.log(10) + log_word
        for r, c in zip(rows, codes, strict=True):
            yield pa.RecordBatch.from_arrays([
                pa.array([r["bucket"]], pa.int32()), pa.array([r["block"]], pa.int64()), *[pa.array([x[c].tobytes()], pa.binary()) for x in (counts, scores, mixed)]],
                names=["bucket", "block", "known", "scores", "mixed"])

    scored = bucket_words(blocks).groupBy("bucket").applyInArrow(score_words, "bucket int, block long, known binary, scores binary, mixed binary")
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, t) for c, t in (
        ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
        ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("mixed_score", T.DoubleType()))]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts = batch.column("ids")[k].values, batch.column("counts")[k].values.to_numpy(zero_copy_only=False)
                n = batch.column("n_codes")[k].as_py()
                ends_at = np.concatenate(([0], np.cumsum(counts)))
                known, base, score, mixed = np.zeros((4, len(counts)))
                if n:
                    found = batch.column("found")[k].as_py()
                    c = np.concatenate([np.frombuffer(f["known"], np.int64) for f in found])
                    s, m = (np.concatenate([np.frombuffer(f[name]) for f in found]) for name in ("scores", "mixed"))
                    codes = codes_of(batch.column("codes")[k].as_py(), n)
                    for out, values in ((known, (c > 0).astype(float)), (base, np.log10(c + 0.1)), (score, s), (mixed, m)):
                        some = counts > 0
                        out[some] = np.add.reduceat(values[codes], ends_at[:-1][some])
                tokens = counts.astype(np.int64) + 1
                train = _train_rows(ids)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(train == 0), pa.array(tokens), pa.array(known.astype(np.int64) + (ends > 0)), pa.array(np.full(len(tokens), n_train)),
                    pa.array(base + np.log10(ends + 0.1) - tokens * floor), pa.array(score + log_end), pa.array(mixed + log_end)], names=schema.names)

    return with_values(blocks, scored).mapInArrow(add_up, schema)
