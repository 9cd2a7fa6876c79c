"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string, at most one token can end each prefix's encoding: the
encoding of the prefix s[:i] is that of s[:i - |t|] followed by t, where t is the
one token for which the last token before it and t stay two tokens when encoded
together.  :class:`PrefixEncoder` keeps that last token per prefix, so appending
bytes extends the table, and an edit re-encodes only from the first changed byte
on.  All tokens that end at a byte come from one automaton over the vocabulary,
longest first.  Two tokens "stay two" if no merge ever joins bytes of both; this
is followed back through the merges that made each of them, and remembered per
pair.

Whole texts are cut where a non-space character precedes white space; the split
pattern never matches across such a place, so units repeat and are looked up in
a bounded table per worker, as 32-bit ids.  Ids are decoded a slice at a time by
one gather over the bytes of all tokens.

Defined cases: a null or empty text has no tokens; its digests are those of the
empty string.  Texts keep every byte, invalid pieces cannot occur in a string
column.  Repeated rows are encoded each.  A text of any length is encoded whole; a
slice is one such text at least, and memory follows its size.  Only doc_id and
text are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import column_of, documents, kept, over_texts

#: The characters that the split pattern's \s stands for: Unicode's White_Space property (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
#: Pieces of more bytes are encoded one by one.
LONG = 64
#: Entries that a worker's tables may hold before they are emptied: of pairs, and of units.
TABLE, UNITS = 300_000, 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 token, blank, rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PrefixEncoder:
    """BPE encoding of one byte string at a time, by each prefix's last token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        if self.longest > 255:
            raise ValueError("a token has more than 255 bytes")
        #: Bytes are held as the characters of the same numbers; a value is the token and, in its lowest byte, its length.
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), rank << 8 | len(token))
        if ranks:
            self.ends.make_automaton()
        self._stay: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._widths: np.ndarray | None = None

    def merged(self, piece: bytes) -> list[int]:
        """Encoding by the definition: merge the adjacent pair of lowest rank, leftmost first, until none merges."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None of a single byte, and of a token that its own bytes do not lead to."""
        if token not in self._halves:
            piece, found = self.tokens[token], None
            if len(piece) > 1:
                parts = [piece[i : i + 1] for i in range(len(piece))]
                while len(parts) > 2:
                    rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if rank == 1 << 60:
                        break
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if len(parts) == 2:
                    found = self.ranks[parts[0]], self.ranks[parts[1]]
            self._halves[token] = found
        return self._halves[token]

    def is_own(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as this token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def stays(self, a: int, b: int) -> bool:
        """Whether token a followed by token b is encoded as these two."""
        known = self._stay.get(a << 32 | b)
        if known is None:
            if len(self._stay) > TABLE:
                self._stay.clear()
            known = self._stay[a << 32 | b] = self.is_own(a) and self.is_own(b) and not self._joins(a, b)
        return known

    def _joins(self, a: int, b: int) -> bool:
        """Whether some merge joins bytes of both tokens.

        The pieces beside the boundary are at first the whole tokens; the merge made
        last, which is the one of higher rank, is taken back time and again.  Pieces
        that stand side by side at some time merge if their rank is below that of every
        merge taken back, the left one going first among equal ranks.
        """
        ranks, tokens = self.ranks, self.tokens
        until, later = 1 << 60, False
        while True:
            rank = ranks.get(tokens[a] + tokens[b], 1 << 60)
            if rank < until or rank == until < 1 << 60 and later:
                return True
            left = a if len(tokens[a]) > 1 else -1
            right = b if len(tokens[b]) > 1 else -1
            if left < 0 and right < 0:
                return False
            # of two equal ranks the leftmost is merged first, so the right one was made last
            if left > right:
                until, later, a = left, False, self.halves(a)[1]
            else:
                until, later, b = right, True, self.halves(b)[0]

    def extend(self, piece: bytes, last: list[int], known: int) -> list[int]:
        """last[i] is the last token of piece[:i + 1]; entries below known stand, the others are found."""
        del last[known:]
        stays, at = self.stays, known
        # a token that ends beyond the known part begins less than the longest token before its end
        begin = max(0, known - self.longest)
        for end, value in self.ends.iter(piece[begin:].decode("latin-1")) if piece else ():
            end, token, size = end + begin, value >> 8, value & 255
            if end == at:  # the longest token that fits has not come yet; no other fits
                start = end - size
                if self.is_own(token) if start < 0 else stays(last[start], token):
                    last.append(token)
                    at += 1
            elif end > at:
                raise ValueError("a byte has no token of its own")
        if at < len(piece):
            raise ValueError("a byte has no token of its own")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The token ids of the string whose prefixes end in these tokens."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern; a match that is a token stands for itself."""
        own = self.ranks.get(piece)
        return [own] if own is not None else self.read(self.extend(piece, [], 0))

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and the n + 1 offsets of the pieces in it.

        Prefixes of one length are settled together, so the same recurrence takes few
        steps for many pieces.
        """
        made: list = [None] * len(pieces)
        some = []
        for i, piece in enumerate(pieces):
            if (own := self.ranks.get(piece)) is not None:
                made[i] = [own]
            elif len(piece) > LONG:
                made[i] = self.encode(piece)
            elif piece:
                some.append(i)
        count = np.array([0 if x is None else len(x) for x in made], np.int64)
        if some:
            ids, own_count = self._together([pieces[i] for i in some])
            count[some] = own_count
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(at[-1], np.int32)
        if some:
            chosen = np.zeros(len(pieces), bool)
            chosen[some] = True
            here = np.repeat(chosen, count)
            out[here] = ids
            out[~here] = [x for own in made if own is not None for x in own]
        else:
            out[:] = [x for own in made if own is not None for x in own]
        return out, at

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has; no piece is empty."""
        size = np.array([len(x) for x in pieces], np.int64)
        begin = np.cumsum(size + 1) - size - 1  # a character that no token has stands between two pieces
        found = list(self.ends.iter("\u0100".join([x.decode("latin-1") for x in pieces])))
        end, value = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)
        token, before = value >> 8, end - (value & 255)
        # the longest token of each end is tried first, those that do not fit give way to the next
        lead = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        limit = np.append(lead[1:], len(end))
        of = np.searchsorted(begin, end[lead], "right") - 1
        length = end[lead] - begin[of]
        order = np.argsort(length, kind="stable")
        lead, limit, head = lead[order], limit[order], begin[of[order]]
        last = np.full(int(begin[-1] + size[-1]), -1, np.int64)
        rank = np.zeros(len(last), np.int64)  # how many tokens a prefix has
        edges = np.searchsorted(length[order], np.arange(int(size.max()) + 1)).tolist()
        known, stays = self._stay.get, self.stays
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at, until, first = lead[a:b], limit[a:b], head[a:b]
            while len(at):
                t, start = token[at], before[at]
                begins = start < first
                # a token that begins its piece has none before it: a number below 0
                pairs = (np.where(begins, -1, last[start]) << 32 | t).tolist()
                fits = [known(x) if x >= 0 else self.is_own(x & 0xFFFFFFFF) for x in pairs]
                if None in fits:
                    fits = [stays(x >> 32, x & 0xFFFFFFFF) if fit is None else fit for x, fit in zip(pairs, fits, strict=True)]
                fits = np.array(fits, bool)
                e = end[at[fits]]
                last[e] = t[fits]
                rank[e] = np.where(begins[fits], 0, rank[start[fits]]) + 1
                left = ~fits & (at + 1 < until)
                at, until, first = at[left] + 1, until[left], first[left]
        at = begin + size - 1
        count = rank[at]
        if not count.all():
            raise ValueError("a byte has no token of its own")
        out = np.empty(int(count.sum()), np.int32)
        place = np.cumsum(count) - 1
        width = self.widths()
        while len(at):
            out[place] = last[at]
            at = at - width[last[at]]
            left = at >= begin
            at, begin, place = at[left], begin[left], place[left] - 1
        return out, count

    def widths(self) -> np.ndarray:
        """How many bytes each token has."""
        if self._widths is None:
            self._widths = np.zeros(max(self.tokens) + 1, np.int64)
            self._widths[list(self.tokens)] = [len(x) for x in self.tokens.values()]
        return self._widths

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """A byte string with its encoding kept exact under appends and edits: only bytes from the change on are redone."""

    def __init__(self, encoder: PrefixEncoder, piece: bytes = b""):
        self.encoder, self.piece = encoder, piece
        self.last = encoder.extend(piece, [], 0)
        self.redone = len(piece)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put new in the place of bytes [start, stop)."""
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.redone = len(self.piece) - start
        self.encoder.extend(self.piece, self.last, start)

    def append(self, new: bytes) -> None:
        self.replace(len(self.piece), len(self.piece), new)

    def ids(self) -> list[int]:
        return self.encoder.read(self.last)


class TextCodec:
    """Whole texts to ids and back; ids are held as native 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = PrefixEncoder(ranks)
        own = pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")
        self.match = regex.compile(own, regex.V0).findall
        self.units = re.compile(rf"[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++").findall
        self.inner = re.compile(rf"[{WHITE}].*[^{WHITE}]", re.DOTALL).fullmatch
        self.table: dict[str, tuple[bytes, str]] = {}
        self.decimals = {rank: f" {rank}" for rank in ranks.values()}
        self.size = self.encoder.widths() if ranks else np.zeros(1, np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.encoder.tokens.get(i, b"") for i in range(len(self.size))), np.uint8)

    def _learn(self, units: list[str]) -> None:
        """Put the units in the table: ids as numbers, and as decimals each after a blank."""
        # units that begin with white space and end without are matched in one go, as no match passes their edges
        inner = [x for x in units if self.inner(x)]
        pieces = self.match("".join(inner))
        edges = np.searchsorted(np.cumsum([len(x) for x in pieces]), np.cumsum([len(x) for x in inner])) + 1 if inner else np.zeros(0, np.int64)
        stops, others = edges.tolist(), [x for x in units if not self.inner(x)]
        for unit in others:
            pieces += self.match(unit)
            stops.append(len(pieces))
        place = {x: i for i, x in enumerate(dict.fromkeys(pieces))}
        ids, at = self.encoder.encode_all([x.encode("utf-8") for x in place])
        which = np.array([place[x] for x in pieces], np.int64)
        count = np.diff(at)[which]
        ends = np.cumsum(count)
        flat = ids[np.repeat(at[which] - ends + count, count) + np.arange(int(ends[-1]))].astype(np.int32)
        blob, numbers, a = flat.tobytes(), [self.decimals[x] for x in flat.tolist()], 0
        for unit, b in zip(inner + others, ends[np.array(stops) - 1].tolist(), strict=True):
            self.table[unit] = (blob[4 * a : 4 * b], "".join(numbers[a:b]))
            a = b

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text, and their decimals joined by one blank."""
        split = [self.units(text) for text in texts]
        if len(self.table) > UNITS:
            self.table.clear()
        if new := list(dict.fromkeys(x for units in split for x in units if x not in self.table)):
            gc.disable()  # what is made here has no cycles, but would be looked through for them time and again
            try:
                self._learn(new)
            finally:
                gc.enable()
        look = self.table.__getitem__
        out = []
        for units in split:
            found = list(map(look, units))
            out.append((b"".join([x for x, _ in found]), "".join([x for _, x in found])[1:]))
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, and where those of each id end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def codec(path: str, pattern: str) -> TextCodec:
    """One per worker process."""
    return kept(("bpe", path, pattern), lambda: TextCodec(read_ranks(path), pattern))


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        own = codec(path, pattern)
        made, digests = [], []
        for ids, decimals in own.encode_all([text or "" for text in column_of(batch, "text").to_pylist()]):
            made.append(ids)
            digests.append(hashlib.sha256(decimals.encode()).hexdigest())
        count = np.array([len(ids) // 4 for ids in made], np.int64)
        decoded, ends = own.decode(np.frombuffer(b"".join(made), np.int32))
        stop = np.concatenate([[0], ends])[np.cumsum(count)]
        back = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(np.concatenate([[0], stop[:-1]]), stop, strict=True)]
        return pa.record_batch([column_of(batch, "doc_id"), pa.array(count), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return over_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)


def bpe_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and its token ids as an array."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        own = codec(path, pattern)
        ids = [np.frombuffer(x, np.int32) for x, _ in own.encode_all([text or "" for text in column_of(batch, "text").to_pylist()])]
        return pa.record_batch([column_of(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return over_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>", keeps=True)


def bpe_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text that its ids stand for; the inverse of :func:`bpe_ids`."""

    def run(batches):
        for batch in batches:
            decode = codec(path, pattern).encoder.decode
            yield pa.record_batch([batch.column(0), pa.array([decode(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
