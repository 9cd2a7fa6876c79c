"""Token counts of sections by offset mapping.

A document is encoded once as a whole.  Its byte-level tokens tile the text, so
running sums of their byte lengths give every token's byte span, and counting
the bytes that begin a character turns these into character spans.  The spans
are interval-joined to the sections by binary search.  A token that crosses a
boundary is allocated by an explicit rule:

* "start": to the section that holds its first character (the default);
* "largest": to the section that holds most of its bytes, the earlier on a tie;
* "split": in parts in proportion to its bytes in each section.

With every rule a document's section counts sum to its number of tokens.

Sections are the lines of a text: each holds the characters up to and with its
line feed; a text that ends in one has no further, empty section.  Defined
cases: a null or empty text has one section 0 of no characters and no tokens.
Repeated rows are counted each.  Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import read_ranks
from .shared import column_of, documents, kept, over_texts

RULES = ("start", "largest", "split")


def _encoder(path: str, pattern: str):
    """The encoding and its tokens' lengths in bytes, once per worker process."""
    return kept(("sections", path, pattern), lambda: _made(path, pattern))


def _made(path: str, pattern: str):
    import tiktoken

    ranks = read_ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_at: np.ndarray, section_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of the tokens beginning there cross its end.

    token_at and section_at are the n + 1 rising offsets of tokens and of sections over the same bytes.
    """
    n = len(section_at) - 1
    first = np.searchsorted(section_at, token_at[:-1], "right") - 1
    final = np.searchsorted(section_at, token_at[1:], "left") - 1
    crossing = np.bincount(first[final > first], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(first[final == first], minlength=n).astype(float)
    for k in np.flatnonzero(final > first):
        inner = np.clip(section_at[first[k] : final[k] + 2], token_at[k], token_at[k + 1])
        share = np.diff(inner)
        if rule == "largest":
            counts[first[k] + int(np.argmax(share))] += 1
        else:
            counts[first[k] : final[k] + 1] += share / share.sum()
    return counts, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """doc_id, section, start_char, n_chars, n_tokens, n_crossing of every line of every text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        encoding, lengths = _encoder(path, pattern)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
        feeds = np.flatnonzero(raw == 10) + 1
        parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for row, text in enumerate(column_of(batch, "text").to_pylist()):
            a, b = int(at[row]), int(at[row + 1])
            ends = feeds[np.searchsorted(feeds, a, "right") : np.searchsorted(feeds, b, "right")]
            bounds = np.unique(np.concatenate([[a], ends, [b]])) if b > a else np.array([a, a])
            if b > a:
                token_at = np.concatenate([[0], np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())])]) + a
                counts, crossing = attribute(token_at, bounds, rule)
            else:
                counts, crossing = np.zeros(1), np.zeros(1, np.int64)
            n = len(bounds) - 1
            for k, x in enumerate((np.full(n, row), np.arange(n), chars[bounds[:-1]] - chars[a], np.diff(chars[bounds]), counts, crossing)):
                parts[k].append(x)
        rows, section, start, size, counts, crossing = map(np.concatenate, parts)
        return pa.record_batch(
            [column_of(batch, "doc_id").take(pa.array(rows)), *(pa.array(x.astype(np.int64)) for x in (section, start, size)), pa.array(counts) if rule == "split" else pa.array(counts.astype(np.int64)), pa.array(crossing.astype(np.int64))],
            names=["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"],
        )

    return over_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, f"doc_id long, section long, start_char long, n_chars long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long", keeps=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
