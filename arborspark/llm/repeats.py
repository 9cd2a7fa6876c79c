"""Which windows of a document also occur in a document of a smaller id: exact, over the whole corpus.

1. Each document's windows are grouped to runs under anchors (:mod:`.anchors`).
   A run whose span a smaller document of the same slice has is settled there.  Of
   the others a few packed bytes are sent: anchor key, hash of the run's span, place.
2. Sent runs meet by key.  A run whose span also stands in a smaller document is
   repeated with all its windows.  What else has a key in common with another
   document is to be checked window by window; a run without such a key is new.
3. The windows of runs to be checked are named one by one and meet by name.
   Only first occurrences and the edges of repeats come so far: runs settled in
   step 2 need no check, as the smallest document with a window is never settled
   for it.

Common passages.  A task remembers the spans that its slices repeat and the keys
that it found crowded, so what a third of all documents hold is sent a few times
by a task, not by a document: repeats of a remembered span are settled at once, and
runs of a crowded key are to be checked without being sent, once a run of that key
has been sent with a mark that its key is crowded.  What a slice has settled or
found to check itself takes another way through the shuffle, dealt by slices, where
no key gathers anything.  Windows to be checked are dealt by their own names.

Keys, spans and windows are compared by at least 112 bits of hash (bucket, key and
span, or key and window).  Packed rows are dealt to buckets of a bounded size by
their key; a bucket is sorted in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import WINDOW, byte_runs, window_names, word_runs
from .shared import _BYTE_NAMES, column_of, cut, discarded, mix, over_texts, release, rolling, span_hash, stored, word_names

#: Bytes of text whose runs go to one bucket.
BUCKET_BYTES = 10_000_000
#: Runs of one key that a slice sends at most, and spans and keys that a task remembers; beyond these the oldest are forgotten and sent again.
CROWD, REMEMBERED = 16, 1 << 16
#: Parts in which windows to be checked are shuffled, one after the other.
WINDOW_PASSES = 2
#: Stands for a null doc_id: none is later.
LAST = (1 << 63) - 1


def tokens_of(kind: str, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tokens (bytes or words) and the texts' n + 1 offsets among them."""
    if kind == "bytes":
        return _BYTE_NAMES[raw], at
    names, _, _, of = word_names(raw, at, lower=False)
    return names, of


def _planes(x: np.ndarray, kept: int) -> bytes:
    """The lowest bytes of each number, byte plane by byte plane, so that equal high bytes lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept].T).tobytes()


def _unplaned(blob: bytes, n: int, kept: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :kept] = np.frombuffer(blob, np.uint8, n * kept).reshape(kept, n).T
    return out.view("<u8").ravel()


#: Packed columns and how many bytes of each are kept; the key's lowest bits are the bucket's as well.
_WIDTHS = {"key": 7, "hash": 7, "doc": 4, "first": 4, "size": 1}


def packed(bucket: np.ndarray, key: np.ndarray, hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, marked: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that some of the runs belong to: bucket, number, body, and the documents' ids (as steps) and row hashes (none if all are 0)."""
    order = np.lexsort((first, doc, bucket))
    key, hashes, doc, first, size, bucket = (x[order] for x in (key, hashes, doc, first, size | np.where(marked, 128, 0), bucket))
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(bucket))
    out = []
    for a, b in zip(begin, end, strict=True):
        used, local = np.unique(doc[a:b], return_inverse=True)
        body = b"".join(_planes(x[a:b] if name != "doc" else local, _WIDTHS[name]) for name, x in zip(_WIDTHS, (key, hashes, doc, first, size), strict=True))
        out.append((int(bucket[a]), int(b - a), body, _planes(np.diff(ids[used].view(np.uint64), prepend=np.uint64(0)), 8), rows[used].tobytes() if rows[used].any() else b""))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["bucket", "n", "body", "ids", "rows"])


def _bucket(key: np.ndarray, aside: np.ndarray, ids: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket; what has been decided in the slice goes aside, to one below 0 that the slice's ids choose."""
    own = int(mix(ids.view(np.uint64)).sum() % np.uint64(buckets)) if len(ids) else 0
    return np.where(aside, -1 - own, (key % np.uint64(buckets)).astype(np.int64))


PACKED = "bucket int, n long, body binary, ids binary, rows binary"


def unpacked(table: pa.Table) -> dict[str, np.ndarray]:
    """key, hash, id, row, first, size and marked of all runs of a bucket."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "hash", "id", "row", "first", "size")}
    for n, body, ids, rows in zip(*(table.column(c).to_pylist() for c in ("n", "body", "ids", "rows")), strict=True):
        at = 0
        ids = np.cumsum(_unplaned(ids, len(ids) // 8, 8)).view(np.int64)
        rows = np.frombuffer(rows, np.int64) if rows else np.zeros(len(ids), np.int64)
        for name, kept in _WIDTHS.items():
            x = _unplaned(body[at : at + n * kept], n, kept)
            at += n * kept
            if name == "doc":
                parts["id"].append(ids[x.astype(np.int64)])
                parts["row"].append(rows[x.astype(np.int64)])
            else:
                parts[name].append(x)
    out = {k: np.concatenate(v) for k, v in parts.items()}
    out["marked"] = out["size"] >= 128
    out["size"] &= np.uint64(127)
    return out


def _first_of(key: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, hash, id), where in it a new (key, hash) begins, and each row's smallest id under its (key, hash), in that order."""
    order = np.lexsort((ids, hashes, key))
    k, h = key[order], hashes[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return order, new, ids[order][new][np.cumsum(new) - 1] if len(k) else ids


class _Memory:
    """Spans that a task has sent, with the least id it sent or settled, and keys that it has marked as crowded."""

    def __init__(self):
        self.name, self.key, self.span = (np.zeros(0, np.uint64) for _ in range(3))
        self.least = np.zeros(0, np.int64)
        self.crowded = np.zeros(0, np.uint64)

    def lowest(self, key: np.ndarray, span: np.ndarray) -> np.ndarray:
        """The least id remembered for each (key, span), else the greatest number."""
        if not len(self.name):
            return np.full(len(key), LAST)
        name = key ^ span
        at = np.searchsorted(self.name, name)
        at[at == len(self.name)] = 0
        return np.where((self.key[at] == key) & (self.span[at] == span), self.least[at], LAST)

    def note(self, key: np.ndarray, span: np.ndarray, least: np.ndarray) -> None:
        """Remember spans; of a span that is known the lesser id stays."""
        key, span, least = np.concatenate([key, self.key]), np.concatenate([span, self.span]), np.concatenate([least, self.least])
        if len(key) > REMEMBERED:
            key, span, least = key[:REMEMBERED], span[:REMEMBERED], least[:REMEMBERED]
        order = np.lexsort((least, key ^ span))
        name = (key ^ span)[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        self.name, self.key, self.span, self.least = name[new], key[order][new], span[order][new], least[order][new]

    def mark(self, keys: np.ndarray) -> None:
        kept = np.concatenate([np.unique(keys), self.crowded])[:REMEMBERED]
        self.crowded = np.unique(kept)

    def is_crowded(self, key: np.ndarray) -> np.ndarray:
        return np.isin(key, self.crowded)


def _runs_of(kind: str, buckets: int):
    memory = _Memory()  # every task has its own

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
        names, of = tokens_of(kind, raw, at)
        key, first, last = byte_runs(raw, of) if kind == "bytes" else word_runs(names, of)
        if not len(key):
            return None
        span = span_hash(rolling(names), first, last + WINDOW)
        doc = np.searchsorted(of, first, "right") - 1
        ids = column_of(batch, "doc_id").to_numpy(zero_copy_only=False)
        rows = column_of(batch, "row").to_numpy(zero_copy_only=False)
        # all in the order of (key, span, id) from here on
        order, new, least = _first_of(key, span, ids[doc])
        key, span, doc, first, last = key[order], span[order], doc[order], first[order], last[order]
        least = np.minimum(least, memory.lowest(key, span))
        settled = ids[doc] > least
        group = np.cumsum(new) - 1
        common = (np.bincount(group) > 1)[group]
        # of each key: how many of its runs are still to be sent
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        of_key = np.cumsum(head) - 1
        marked = memory.is_crowded(key)
        crowded = marked | (np.bincount(of_key, weights=~settled) > CROWD)[of_key]
        # the first run of a key that is crowded for the first time is sent with the mark
        candidate = np.flatnonzero(crowded & ~marked & ~settled)
        _, lead = np.unique(of_key[candidate], return_index=True)
        mark = np.zeros(len(key), bool)
        mark[candidate[lead]] = True
        check = crowded & ~settled & ~common & ~mark
        memory.mark(key[mark])
        noted = common & new
        memory.note(key[noted], span[noted], least[noted])
        aside = settled | check
        return packed(_bucket(key, aside, ids, buckets), key, span, doc, first - of[doc], last - first + 1, np.where(aside, check, mark), ids, rows)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket's runs: those repeated (state 0) and those to be checked (state 1)."""
    x = unpacked(table)
    if table.column("bucket")[0].as_py() < 0:
        settled = {k: v[~x["marked"]] for k, v in x.items()}
        out = pa.concat_tables([_joined(settled), _ranges(x, x["marked"], np.ones(len(x["key"]), np.int8))])
        release()
        return out
    order, new, least = _first_of(x["key"], x["hash"], x["id"])
    repeated = np.empty(len(order), bool)
    repeated[order] = x["id"][order] > least
    # keys under which runs that are not repeated come from two documents or more, or that a slice has marked
    k, i = x["key"][order], x["id"][order]
    mine = i == least
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    lowest = np.minimum.reduceat(np.where(mine, i, LAST), begin)
    highest = np.maximum.reduceat(np.where(mine, i, -(1 << 63)), begin)
    crowded = np.logical_or.reduceat(x["marked"][order], begin)
    mixed = np.repeat((lowest < highest) | crowded, np.diff(np.append(begin, len(k))))
    check = np.zeros(len(order), bool)
    check[order] = mixed & mine
    out = _ranges(x, repeated | check, np.where(repeated, 0, 1))
    release()
    return out


def _ranges(x: dict[str, np.ndarray], keep: np.ndarray, state: np.ndarray) -> pa.Table:
    columns = (x["id"][keep], x["row"][keep], x["first"][keep].astype(np.int64), x["size"][keep].astype(np.int64), state[keep].astype(np.int8), np.where(state[keep] == 1, x["key"][keep].astype(np.int64), 0))
    return pa.table([pa.array(c) for c in columns], names=["doc_id", "row", "first", "size", "state", "key"])


RANGES = "doc_id long, row long, first long, size long, state tinyint, key long"


def _windows_of(kind: str, buckets: int, part: int, parts: int):
    """Every window of the runs to be checked whose key belongs to the part, named; equal windows have equal keys."""

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
        lists = column_of(batch, "checks")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        run_ = lists.flatten()
        first, size, key = (run_.field(k).to_numpy(zero_copy_only=False) for k in ("first", "size", "key"))
        mine = key % parts == part
        if not mine.any():
            return None
        doc, first, size, key = (x[mine] for x in (doc, first, size, key))
        names, of = tokens_of(kind, raw, at)
        each = np.repeat(np.arange(len(doc)), size)
        start = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        doc, key = doc[each], key[each].astype(np.uint64)
        place = start + of[doc]
        name = window_names(raw)[place] if kind == "bytes" else span_hash(rolling(names), place, place + WINDOW)
        ids = column_of(batch, "doc_id").to_numpy(zero_copy_only=False)
        rows = column_of(batch, "row").to_numpy(zero_copy_only=False)
        order, _, least = _first_of(name, key, ids[doc])
        settled = np.zeros(len(key), bool)
        settled[order] = ids[doc][order] > least
        return packed(_bucket(name, settled, ids, buckets), name, key, doc, start, np.ones(len(key), np.int64), np.zeros(len(key), bool), ids, rows)

    return run


def _decide(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, the repeated ones, neighbours joined."""
    x = unpacked(table)
    if table.column("bucket")[0].as_py() >= 0:
        order, _, least = _first_of(x["key"], x["hash"], x["id"])
        repeated = np.empty(len(order), bool)
        repeated[order] = x["id"][order] > least
        x = {k: v[repeated] for k, v in x.items()}
    out = _joined(x)
    release()
    return out


def _joined(x: dict[str, np.ndarray]) -> pa.Table:
    """Repeated runs, those that touch or overlap as one."""
    order = np.lexsort((x["first"], x["row"], x["id"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    if not n:
        return _ranges(x, np.zeros(0, bool), np.zeros(0, np.int8))
    stop = x["first"] + x["size"]
    same = np.zeros(n, bool)
    same[1:] = (x["id"][1:] == x["id"][:-1]) & (x["row"][1:] == x["row"][:-1])
    # the furthest stop so far within a document; documents are set apart by a step of their own
    far = np.cumsum(~same).astype(np.uint64) << np.uint64(33)
    reach = np.maximum.accumulate(far + stop)
    new = ~same
    new[1:] |= (far + x["first"])[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], n) - 1
    size = reach[final] - far[final] - x["first"][begin]
    x = {k: v[begin] for k, v in x.items()} | {"size": size}
    return _ranges(x, np.ones(len(begin), bool), np.zeros(len(begin), np.int8))


def repeated_windows(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, row, runs (array of struct<first, size>): the repeated windows of each document that has some.

    docs: doc_id (long, not null), row (long, tells rows of one doc_id apart), text;
    kind: "bytes" or "words", the tokens of which a window has WINDOW.  A partition of docs
    must give its rows in the same order if it is computed again, as those of tables do:
    what is sent depends on the slices.  The result is stored.
    """
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-volume // BUCKET_BYTES))
    runs = over_texts(docs, _runs_of(kind, buckets), PACKED)
    ranges = stored(runs.groupBy("bucket").applyInArrow(_meet, RANGES))
    checks = stored(ranges.where("state = 1").groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "size", "key")).alias("checks")))
    # stored texts have an order that a task that is run again meets as well
    texts = stored(matched(docs, checks))
    discarded(checks)
    decided = [stored(over_texts(texts, _windows_of(kind, buckets, part, WINDOW_PASSES), PACKED).groupBy("bucket").applyInArrow(_decide, RANGES)) for part in range(WINDOW_PASSES)]
    discarded(texts)
    whole = ranges.where("state = 0")
    for some in decided:
        whole = whole.union(some)
    found = stored(whole.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "size")).alias("runs")))
    discarded(ranges, *decided)
    return found


#: Keys that may be broadcast in matched().
BROADCAST_ROWS = 300_000


def matched(docs: DataFrame, found: DataFrame, rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs joined to found on (doc_id, row); rest, if given, makes rows of the same columns of those without a match.

    If found has few rows, their keys are broadcast first, so only matching texts are shuffled.
    """
    keys = found.select("doc_id", "row")
    few = found.count() <= BROADCAST_ROWS
    if not few:
        joined = docs.join(found, ["doc_id", "row"], "left" if rest else "inner")
        return joined
    mine = docs.join(F.broadcast(keys), ["doc_id", "row"], "left_semi").join(found, ["doc_id", "row"])
    return mine.unionByName(rest(docs.join(F.broadcast(keys), ["doc_id", "row"], "left_anti"))) if rest else mine


def with_runs(docs: DataFrame, kind: str) -> DataFrame:
    """All columns of docs (doc_id, row and text among them) with runs, which is null where nothing is repeated."""
    found = repeated_windows(docs.select("doc_id", "row", "text"), kind)
    return matched(docs, found, lambda others: others.withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType)))


def keyed(docs: DataFrame, *others: str | Column) -> DataFrame:
    """doc_id, row, text with the defined stand-ins for nulls, and other columns; row is 0 where no other row has the doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    again = cut(docs.groupBy(key.alias("again_")).count().where("count > 1").select("again_"))
    many = again.count()
    if not many:
        row = F.lit(0).cast("long")
    elif many > BROADCAST_ROWS:
        row = F.xxhash64(text)
    else:
        docs = docs.join(F.broadcast(again), key == F.col("again_"), "left")
        row = F.when(F.col("again_").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0))
    return docs.select(key.alias("doc_id"), row.alias("row"), text.alias("text"), *others)


def covered(batch: pa.RecordBatch, of: np.ndarray) -> np.ndarray:
    """Whether each token of a slice lies in a repeated window; the slice has a column runs."""
    lists = column_of(batch, "runs")
    edge = np.zeros(int(of[-1]) + 1, np.int64)
    for doc, runs in enumerate(lists):
        if runs.is_valid:
            values = runs.values
            first = values.field("first").to_numpy(zero_copy_only=False) + of[doc]
            np.add.at(edge, first, 1)
            np.add.at(edge, first + values.field("size").to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
    return np.cumsum(edge)[:-1] > 0
