"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised whole; only those longer than a sequence are cut.  Since
a piece's fit depends on its length alone, the sweep works on runs: all pieces
of one length are one run, all sequences with the same gap and filling are one
run.  Supersteps go through the lengths in falling order.  In a superstep each
run of pieces meets its successor, the smallest gap that holds it; conflicts
between equal pieces are resolved by their rank, the r-th piece taking the r-th
place; gaps are updated, and the rest of the run meets the next gap or opens new
sequences.  Runs number at most a few per length, whatever the number of
documents, so the sweep itself runs on bounded counts; ranking the pieces and
reading their places from the plan is distributed.

A rank is the number of earlier pieces of the same length: pieces of one length
are dealt to blocks by a hash, blocks get a running base, and rows are numbered
within a block only, so a length that a third of all rows share is not sorted in
one task.

Defined cases: a null text is empty, thus one closing id; repeated rows are
packed each; an empty table gives no rows.  Only the id and the text are read.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import column_of, cut, documents, kept, over_texts

#: Words that a worker's table of encoded words may hold before it is emptied.
TABLE = 1_200_000
#: Marks that may close a word.
MARKS = b".,;:!?"


#: Words that are given to the tokenizer as one text.
TOGETHER = 200


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, by a tokenizer that drops white space.

    Such a tokenizer never joins characters across ASCII white space, so each word
    between white space is encoded once and remembered.  It must also lower-case, and
    match marks apart from letters and digits, as the one for word ends does.  Words of
    letters alone are normalised here and encoded many at a time by its model, without
    its patterns; each ends with its only token that has the mark of a word's end, and
    where the numbers differ the words are encoded singly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.ascii, self.letters = (Tokenizer.from_file(path) for _ in range(3))
        blanks, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ascii.normalizer = self.letters.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = blanks  # ASCII letters stand for themselves as bytes
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([blanks, as_bytes])
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as native 32-bit little-endian words")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.table: dict[bytes, bytes] = {}

    def _learn(self, wanted: list[bytes]) -> None:
        """Put the words in the table."""
        single: list[bytes] = []
        plain: list[tuple[bytes, str]] = []
        other: list[tuple[bytes, str]] = []
        for word in wanted:
            text = word.decode("utf-8")
            if text.isascii():
                plain.append((word, text.lower())) if text.isalpha() else single.append(word)
            else:
                small = unicodedata.normalize("NFC", text).lower()
                # a capital sigma is lower-cased by its place
                other.append((word, small)) if text.isalpha() and small.isalpha() and "\u03a3" not in text else single.append(word)
        for tokenizer, words in ((self.ascii, plain), (self.letters, other)):
            groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)] if self.closes.any() else []
            single += [] if groups else [x for x, _ in words]
            for group, made in zip(groups, tokenizer.encode_batch_fast([" ".join([y for _, y in x]) for x in groups], add_special_tokens=False), strict=True):
                ids = np.array(made.ids, "<u4")
                stops = np.flatnonzero(self.closes[ids]) + 1
                if len(stops) != len(group) or stops[-1] != len(ids):
                    single += [x for x, _ in group]
                    continue
                blob, a = ids.tobytes(), 0
                for (word, _), b in zip(group, (4 * stops).tolist(), strict=True):
                    self.table[word] = blob[a:b]
                    a = b
        for word, made in zip(single, self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in single], add_special_tokens=False), strict=True):
            self.table[word] = array("I", made.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        table = self.table
        if len(table) > TABLE:
            table.clear()
        new = set().union(*split).difference(table)
        # a word's closing marks are matched apart from a letter or digit before them, and case does not count
        parts = []
        for word in new:
            small = word.lower()
            stem = small.rstrip(MARKS)
            parts.append((word, stem, small[len(stem) :]) if stem and stem[-1:].isalnum() else (word, small, b""))
        self._learn([x for x in {x for _, stem, marks in parts for x in (stem, marks)} if x and x not in table])
        for word, stem, marks in parts:
            table[word] = table[stem] + table[marks] if marks else table[stem]
        return [b"".join(map(table.__getitem__, ws)) for ws in split]


def _encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return kept(("words", path), lambda: WordEncoder(path))


def token_pieces(docs: DataFrame, path: str, limit: int, close_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and its closing id, cut only beyond the limit."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        texts = [x or b"" for x in column_of(batch, "text").cast(pa.large_binary()).to_pylist()]
        close = np.array([close_id], "<u4").tobytes()
        rows, made = [], []
        for row, ids in enumerate(_encoder(path).encode(texts)):
            ids += close
            for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                part = ids[4 * start : 4 * (start + limit)]
                rows.append(row)
                made.append((piece, start, len(part) // 4, zlib.crc32(part)))
        columns = np.array(made, np.int64).reshape(-1, 4)
        return pa.record_batch(
            [column_of(batch, "doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in (1, 2, 3))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return over_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long", keeps=True)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces, given how many there are of each length.

    A row (length, first, stop, base, each, used) puts the pieces of this length
    with ranks first <= r < stop at sequence base + (r - first) // each, offset
    used + (r - first) % each * length.
    """
    plan = []
    gaps: list[int] = []  # the gaps that some run has, rising
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    opened = 0

    def keep(gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = gap // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - gap))
                keep(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < number:
                plan.append((length, rank, rank + left, first + full, each, capacity - gap))
                keep(gap - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            keep(gap, first + full, number - full)
    return plan


def best_fit(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """The pieces (column length, 1 to capacity) with sequence_id and offset; order breaks ties among equal lengths."""
    spark = pieces.sparkSession
    pieces = cut(pieces)
    blocks = max(64, pieces.count() // 1_000_000)
    dealt = pieces.withColumn("block_", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = cut(dealt.groupBy("length", "block_").agg(F.count("*").alias("n_")))
    base = sizes.select("length", "block_", (F.sum("n_").over(Window.partitionBy("length").orderBy("block_")) - F.col("n_")).alias("base_"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n_").alias("n")).collect()}  # at most one row per length
    plan = np.array(sweep(counts, capacity), np.int64).reshape(-1, 6)
    named = spark.createDataFrame(pa.table({k: plan[:, i] for i, k in enumerate(("length", "first_", "stop_", "seq_", "each_", "used_"))}))
    within = F.row_number().over(Window.partitionBy("length", "block_").orderBy(*order)) - 1
    ranked = dealt.withColumn("rank_", within).join(base, ["length", "block_"]).withColumn("rank_", F.col("rank_") + F.col("base_"))
    placed = ranked.join(named, (ranked["length"] == named["length"]) & (ranked["rank_"] >= named["first_"]) & (ranked["rank_"] < named["stop_"])).drop(named["length"])
    step = F.col("rank_") - F.col("first_")
    return placed.select(*pieces.columns, (F.col("seq_") + F.floor(step / F.col("each_"))).alias("sequence_id"), (F.col("used_") + step % F.col("each_") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, close_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces."""
    return best_fit(token_pieces(docs, path, capacity, close_id), capacity, ["doc_id", "piece", "ids_crc32"])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
