"""Language identification by interpolated Kneser-Ney character models.

Each language's model gives P(c | three characters before) as

    max(n(hc) - D, 0) / n(h) + D * N(h .) / n(h) * P(c | shorter h)

with counts n of the highest order, and below it the number of different left
neighbours; D comes from the counts of counts.  The n-grams of all languages
lie in one sorted hash array per order, with every language's log-probability;
a second one holds the contexts with their back-off weights.  A text goes to the
language of the lowest cross-entropy per character.  It is rejected if that
exceeds what texts of its length reach in a calibration part of the sample, by a
wide margin, or if it has no letter.

The models are fitted on a bounded sample: of each language the
``per_language`` texts first in the order of a hash of the id, none longer than
``longest`` characters; each such text is used whole.  Every character of every
text is scored.

Letters are lower-cased, every other run of characters counts as one blank.  An
n-gram has 16 bits for a letter: should a sample hold more than 65,534 different
letters, those last in the order of code points count as unknown ones.
Defined cases: null, empty and letterless texts get `und`, score 0 and are
rejected; ties go to the language first in order; repeated rows are scored each;
an empty table gives no rows; without any labelled row every text gets `und`.
Only the columns named to the functions are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from .shared import column_of, documents, mix, over_texts

ORDER = 4
BLANK, UNKNOWN = 1, 0
#: Symbols that are judged at once, whatever the lengths of texts.
BLOCK = 1 << 16


class HashArray:
    """Sorted hashes of packed n-grams, each with a row of values, one per language."""

    def __init__(self, grams: np.ndarray, rows: np.ndarray):
        keys = mix(grams)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams, and which of them are there."""
        keys = mix(grams)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys


def _tail(grams: np.ndarray, symbols: int) -> np.ndarray:
    return grams & np.uint64((1 << 16 * symbols) - 1)


def windows(codes: np.ndarray) -> np.ndarray:
    """Each symbol with the ORDER - 1 before it, 16 bits a symbol; blanks stand before the text."""
    wide = np.concatenate([np.full(ORDER - 1, BLANK), codes]).astype(np.uint64)
    out = np.zeros(len(codes), np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | wide[k : k + len(codes)]
    return out


class KneserNey:
    """One language's counts, turned into probabilities of any packed n-gram."""

    def __init__(self, texts: list[np.ndarray], alphabet: int):
        self.alphabet = alphabet
        self.levels: list[tuple] = [()] * (ORDER + 1)
        grams, counts = np.unique(np.concatenate([windows(x) for x in texts]), return_counts=True)
        for order in range(ORDER, 0, -1):
            self.levels[order] = self._level(grams, counts.astype(float))
            # one order less: in how many different left neighbourhoods a gram is seen
            grams, counts = np.unique(_tail(grams, order - 1), return_counts=True)

    @staticmethod
    def _level(grams: np.ndarray, counts: np.ndarray) -> tuple:
        once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, of = np.unique(grams >> np.uint64(16), return_inverse=True)
        total = np.bincount(of, weights=counts)
        kept = np.maximum(counts - discount, 0) / total[of]
        spared = np.bincount(of, weights=np.minimum(counts, discount)) / total
        return grams, kept, contexts, spared

    def back_off(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """The weight that the shorter context has after each context of order - 1 symbols; 1 after unseen ones."""
        _, _, have, spared = self.levels[order]
        at = np.minimum(np.searchsorted(have, contexts), len(have) - 1)
        return np.where(have[at] == contexts, spared[at], 1.0)

    def probability(self, grams: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full(len(grams), 1 / self.alphabet)
        have, kept, _, _ = self.levels[order]
        at = np.minimum(np.searchsorted(have, grams), len(have) - 1)
        own = np.where(have[at] == grams, kept[at], 0.0)
        return own + self.back_off(grams >> np.uint64(16), order) * self.probability(_tail(grams, order - 1), order - 1)


class LanguageModels:
    """All languages' models with their calibration."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha() and ord(c) < 0x110000})[: (1 << 16) - 2]
        self._tables()
        coded = {k: [self.symbols(t)[0] for t in samples[k]] for k in self.languages}
        parts = {k: [x for x in v if len(x)] for k, v in coded.items()}
        self.languages = [k for k in self.languages if parts[k]]
        fitted = [KneserNey([x for i, x in enumerate(parts[k]) if i % 5] or parts[k], len(self.letters) + 2) for k in self.languages]
        self.grams, self.contexts = {}, {}
        for order in range(1, ORDER + 1):
            seen = np.unique(np.concatenate([m.levels[order][0] for m in fitted])) if fitted else np.zeros(0, np.uint64)
            self.grams[order] = HashArray(seen, np.log(np.stack([m.probability(seen, order) for m in fitted], 1)).astype(np.float32) if fitted else np.zeros((0, 0), np.float32))
            seen = np.unique(np.concatenate([m.levels[order][2] for m in fitted])) if fitted else np.zeros(0, np.uint64)
            self.contexts[order] = HashArray(seen, np.log(np.stack([m.back_off(seen, order) for m in fitted], 1)).astype(np.float32) if fitted else np.zeros((0, 0), np.float32))
        self.floor = float(-np.log(len(self.letters) + 2))
        self.usual = np.zeros(len(self.languages))
        self.spread = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            own = [x for i, x in enumerate(parts[name]) if not i % 5]
            losses = np.concatenate([-self.log_probabilities(windows(x))[:, k] for x in own])
            self.usual[k], self.spread[k] = losses.mean(), losses.std()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("code", "is_letter")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tables()

    def _tables(self) -> None:
        """For each character: its symbol, and whether it is a letter."""
        place = {c: i + 2 for i, c in enumerate(self.letters)}
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.code = np.full(0x110000, BLANK, np.uint16)
        self.code[self.is_letter] = UNKNOWN
        for c in range(0x110000):
            if self.is_letter[c] and (at := place.get(chr(c).lower())):
                self.code[c] = at

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        codes, of, letters = self.coded(text.encode("utf-8", "replace").decode("utf-8"), np.array([0, len(text)]))
        return codes, bool(letters[0])

    def coded(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of joined texts with blank runs as one, the texts' new offsets, and how many letters each has."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, letter = self.code[points], self.is_letter[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1]
        starts = at[:-1][np.diff(at) > 0]
        keep[starts] = True
        return codes[keep], np.concatenate([[0], np.cumsum(keep)])[at], np.diff(np.concatenate([[0], np.cumsum(letter)])[at])

    def log_probabilities(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """ln P of each gram's last symbol after the others, a column per language."""
        if not order:
            return np.full((len(grams), len(self.languages)), self.floor, np.float32)
        table = self.grams[order]
        at, there = table.find(grams)
        out = table.rows[at]
        miss = np.flatnonzero(~there)
        if len(miss):
            lost = grams[miss]
            lower = self.log_probabilities(_tail(lost, order - 1), order - 1)
            where, known = self.contexts[order].find(lost >> np.uint64(16))
            out[miss] = lower + np.where(known[:, None], self.contexts[order].rows[where], np.float32(0))
        return out

    def judge(self, text: str, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of each of the joined texts."""
        n = len(at) - 1
        names, score, loss, fine = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
        if not self.languages:
            return names, score, loss, fine
        codes, of, letters = self.coded(text, at)
        some = np.flatnonzero(letters)
        if not len(some):
            return names, score, loss, fine
        # each text starts anew: blanks stand before it
        wide = np.full(len(codes) + (ORDER - 1) * n, BLANK, np.uint64)
        doc = np.repeat(np.arange(n), np.diff(of))
        wide[np.arange(len(codes)) + (ORDER - 1) * (doc + 1)] = codes
        sums = np.zeros((n, len(self.languages)))
        # a block of symbols at a time, as a symbol takes some hundred bytes here
        for start in range(0, len(codes), BLOCK):
            own = doc[start : start + BLOCK]
            ends = np.arange(start, start + len(own)) + (ORDER - 1) * (own + 1)
            grams = np.zeros(len(own), np.uint64)
            for k in range(ORDER):
                grams = grams << np.uint64(16) | wide[ends - (ORDER - 1) + k]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[first]] += np.add.reduceat(self.log_probabilities(grams).astype(np.float64), first, axis=0)
        sizes = np.diff(of)[some].astype(float)
        entropy = -sums[some] / sizes[:, None]
        best = np.argmin(entropy, axis=1)
        least = entropy[np.arange(len(some)), best]
        score[some] = 1 / np.exp(least[:, None] - entropy).sum(axis=1)
        loss[some] = least
        fine[some] = least <= 1.5 * self.usual[best] + 8 * self.spread[best] / np.sqrt(sizes)
        for row, k in zip(some, best, strict=True):
            names[row] = self.languages[k]
        return names, score, loss, fine


def fit(docs: DataFrame, usable: Column, per_language: int = 160, longest: int = 60_000) -> LanguageModels:
    """Models of the languages of the usable rows with a language, on a bounded sample of them."""
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= longest)).select("doc_id", "lang")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r["doc_id"] for r in rows.withColumn("place", first).where(F.col("place") <= per_language).select("doc_id").collect()]
    texts = docs.where(usable & F.col("doc_id").isin(ids) & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= longest)).select("doc_id", "lang", "text").collect() if ids else []
    samples: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        if len(own := samples.setdefault(r["lang"], [])) < per_language:
            own.append(r["text"])
    return LanguageModels(samples)


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of docs (any columns, a text among them) with lang_pred, score, cross_entropy and accepted as the last columns.

    A name that docs has already gets underscores at its end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # its size is bounded by the sample's
    made = []
    for name in ("lang_pred", "score", "cross_entropy", "accepted"):
        while name in docs.columns:
            name += "_"
        made.append(name)
    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(made, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)

    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        names, score, loss, fine = shared.value.judge(raw.tobytes().decode("utf-8"), chars)
        return pa.record_batch([*batch.columns, pa.array(names), pa.array(score), pa.array(loss, from_pandas=True), pa.array(fine)], names=[*batch.schema.names, *made])

    return over_texts(docs, run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    docs = documents(spark, sf_dir)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    models = fit(docs, F.coalesce(~held_out, F.lit(False)))
    told = identify(docs.select("doc_id", "text"), models)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
