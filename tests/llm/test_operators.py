"""Each operator against a brute-force version on a small table with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.llm import bpe, kdtree, language_id, minhash, packing, sharding, simhash, substring_dedup, suffix_dedup, token_counts
from arborspark.llm.components import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, runs string, key long, accepted string, lang_pred string, component_id long"


def corpus() -> list[tuple]:
    rng = random.Random(7)
    pool = ["".join(rng.choice("abcdeöß日") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    passage, base = text(60), text(200)
    texts = [None, "", " \t\n", "one", "One", "two words", "a", base, base, text(30) + "\n" + passage + " " + text(20), text(10) + "\n" + passage, passage, "w " * 200, "w " * 120 + "x", text(4000) + " " + passage]
    for k in (1, 3, 10, 40):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(200)] = rng.choice(pool)
        texts.append(" ".join(words))
    texts += [text(rng.randint(1, 120)) for _ in range(20)] + ["don't  stop, 123 now!  ", "  x    y\r\n\r\nz" + " end\x1c.", "ÀÉ İ ſ ́x " + "🙂🙂 ok"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(21, base), (33, passage), (None, base), (None, "lost " + passage)]  # repeated ids, the same row twice, no id
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "x", 1, "y", "z", 9) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_minhash(docs, rows, size):
    known = [(i, shingles(t, size)) for i, t in rows]
    group = {i: i for i, _ in known if i is not None}
    find = lambda i: i if group[i] == i else find(group[i])
    for a, x in known:
        for b, y in known:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                group[q] = p
    want = sorted((str(i), len(x), str(None if i is None else find(i)), i is None or find(i) == i) for i, x in known)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs, size, 80).collect())
    assert got == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with a few words changed, many of them close to the limit; blocks of cells are tiny."""
    rng = random.Random(15)
    pool = [f"w{i}" for i in range(3000)]
    base = [rng.choice(pool) for _ in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(2, 8)):
            words[rng.randrange(100)] = rng.choice(pool)
        rows.append((i * 7 % 151, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(20)]
    monkeypatch.setattr(minhash, "CELL", 10)
    known = {i: shingles(t, 2) for i, t in rows}
    like = {(a, b): len(known[a] & known[b]) / len(known[a] | known[b]) for a in known for b in known if a < b}
    assert sum(0.8 <= x <= 0.85 for x in like.values()) > 30
    want = {i: i for i in known}
    for _ in range(20):
        for (a, b), x in like.items():
            if 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b]):
                want[a] = want[b] = min(want[a], want[b])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 25


def test_components_of_large_stars(spark, monkeypatch):
    from arborspark.llm import components as module

    monkeypatch.setattr(module, "CROWDED", 5)
    links = [(1000 + i, i % 3) for i in range(60)] + [(0, 50), (50, 51), (1005, 70), (1001, 71), (71, 1007)]
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(10):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect())) == want


@pytest.mark.parametrize("size", [1, 2, 700])
def test_native_components(spark, monkeypatch, size):
    """A long chain, a star, a small cycle: without any task of Python, as op1 asks for."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *_, **__: pytest.fail("Python on the executors"))
    links = [(7 * i % 701, 7 * (i + 1) % 701) for i in range(size)] + [(1000, 1001 + i) for i in range(size)] + [(2003, 2001), (2001, 2002), (2002, 2003), (5, 5), (None, 4)]
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    assert dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), native=True).collect())) == want


def test_fingerprints_run_no_python(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", lambda *_, **__: pytest.fail("Python on the executors"))
    frame = spark.createDataFrame([(i, "one two three four five six seven eight " * 20 + ("nine" if i % 2 else "")) for i in range(8)], "doc_id long, text string")
    assert {r.near_class for r in simhash.edited_fingerprints(frame).collect()} == {0}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 3), (None, 1), (2, 1)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 1), (4, 4), (5, 4)}


@pytest.mark.parametrize("task_links", [7, 40, 10**6])
def test_components_over_several_tasks(spark, monkeypatch, task_links):
    from arborspark.llm import components as module

    monkeypatch.setattr(module, "TASK_LINKS", task_links)
    monkeypatch.setattr(module, "CROWDED", 5)
    chance = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in chance.integers(-60, 240, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(900, i) for i in range(400, 440)] + [(None, 5), (7, None), (8, 8), (8, 8)]
    links += [(-(2**63), 2**63 - 1), (2**63 - 1, 1000)]
    root: dict[int, int] = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    made = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(made) == len(set(made)) and dict(made) == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(rows, tokens, join):
    first = {}
    key = lambda i: (1 << 63) - 1 if i is None else i
    split = [(i, tokens((t or "").encode())) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            x = join(w[k : k + 50])
            first[x] = min(first.get(x, key(i)), key(i))
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[join(w[k : k + 50])] < key(i):
                gone[k : k + 50] = [True] * 50
        yield i, w, gone


def test_substring_dedup(docs, rows):
    found = list(repeats(rows, bytes.split, b" ".join))
    want = sorted((str(i), len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for i, w, g in found)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_words(docs).collect()) == want
    assert sum(x[2] for x in want) > 200
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    left = sorted((str(i), b" ".join(x for x, y in zip(w, g) if not y)) for i, w, g in found if not w or not all(g))
    assert sorted((str(r.doc_id), b" ".join((r.text or "").encode().split())) for r in kept.collect()) == left
    whole = {(str(i), t) for (i, t), (_, _, g) in zip(rows, found) if not any(g)}
    assert whole <= {(str(r.doc_id), r.text) for r in kept.collect()}


def test_suffix_dedup(docs, rows):
    runs = lambda g: sum(x and not (k and g[k - 1]) for k, x in enumerate(g))
    want = sorted((str(i), len(w), sum(g), runs(g), hashlib.sha256(bytes(x for x, y in zip(w, g) if not y)).hexdigest()) for i, w, g in repeats(rows, bytes, bytes))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect()) == want


def crowd():
    """One passage in many documents, each time beside other words; some ids at the edges of long."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    passage, other = text(75), text(64)
    texts = [text(rng.randint(0, 30)) + " " + passage + " " + text(rng.randint(0, 30)) for _ in range(60)]
    texts += [text(20) + " " + other + " " + passage, other, passage, passage, text(55), "z " * 130]
    ids = rng.sample(range(1000), len(texts) - 2) + [(1 << 63) - 1, -(1 << 63)]
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("kind", "slice_bytes"), [("words", 30_000), ("bytes", 30_000), ("words", 700), ("bytes", 700)])
def test_a_passage_of_many_documents(spark, monkeypatch, kind, slice_bytes):
    from arborspark.llm import repeats, shared

    rows = crowd()
    monkeypatch.setattr(shared, "SLICE_BYTES", slice_bytes)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    split = (lambda t: t.encode().split()) if kind == "words" else (lambda t: [bytes([b]) for b in t.encode()])
    joined = b" ".join if kind == "words" else b"".join
    first = {}
    for i, t in rows:
        x = split(t)
        for k in range(len(x) - 49):
            w = tuple(x[k : k + 50])
            first[w] = min(first.get(w, i), i)
    want = {}
    for i, t in rows:
        x = split(t)
        gone = [False] * len(x)
        for k in range(len(x) - 49):
            if first[tuple(x[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = sum(gone), hashlib.sha256(joined([w for w, g in zip(x, gone, strict=True) if not g])).hexdigest()
    made = (substring_dedup.dedup_words if kind == "words" else suffix_dedup.dedup_bytes)(frame)
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in made.collect()} == want
    # of slices that hold many such documents, most runs of the passage go to no bucket of a key
    sent = dict(shared.over_texts(repeats.keyed(frame), repeats._runs_of(kind, 1), repeats.PACKED).groupBy(F.col("bucket") >= 0).agg(F.sum("n")).collect())
    assert slice_bytes < 30_000 or sent[False] > 2 * 60


def test_what_repeats_leave_on_disk(spark):
    """Row hashes are sent for repeated ids only; tables and shuffle files of a step go when the next has what it needs."""
    import time
    from pathlib import Path

    from arborspark.llm import repeats, shared

    rows = [(i, t) for i, t in crowd() if 0 <= i < 1000]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    sent = shared.over_texts(repeats.keyed(frame), repeats._runs_of("bytes", 500), repeats.PACKED)
    assert sent.agg(F.sum(F.length("rows"))).first()[0] == 0
    twice = repeats.keyed(frame.union(frame.limit(1))).where("row <> 0")
    assert [r.doc_id for r in twice.collect()] == [rows[0][0]] * 2
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    tables = lambda: {x for x in folder.iterdir() if len(x.name) == 32}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle_" in x for x in disk.getAllFiles().mkString("|").split("|"))
    keyed = repeats.keyed(frame).cache()
    keyed.count()
    old, before = tables(), shuffles()
    repeats.repeated_windows(keyed, "bytes")
    assert len(tables() - old) == 1
    for _ in range(100):  # files go a little after the query
        if shuffles() <= before + 2:
            break
        time.sleep(0.1)
    assert shuffles() <= before + 2  # an aggregate of one number may stay


def test_bpe(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := plain.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs, path, P.PATTERN).collect()) == want
    back = bpe.bpe_texts(bpe.bpe_ids(docs, path, P.PATTERN), path, P.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)


def test_bpe_edits():
    encoder = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encoder
    rng = random.Random(1)
    for _ in range(60):
        piece = bytes(rng.choice(b"aeinrstho .xyz\xc3\x9f") for _ in range(rng.randint(0, 25)))
        text = bpe.EditableText(encoder, piece)
        assert text.ids() == encoder.merged(piece)
        text.append(b"ing")
        assert text.redone == 3 and text.ids() == encoder.merged(piece + b"ing")
        a = rng.randint(0, len(text.piece))
        text.replace(a, min(len(text.piece), a + 2), b"er")
        assert text.ids() == encoder.merged(text.piece) and encoder.decode(text.ids()) == text.piece


def test_token_counts(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for rule in token_counts.RULES:
        got = token_counts.section_tokens(docs, path, P.PATTERN, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("c")).collect()
        want = {}
        for i, t in rows:
            n, c = want.get(i, (0, 0))
            want[i] = n + len(plain.encode_ordinary(t or "")), c + len(t or "")
        assert {r.doc_id: (round(r.n, 6), r.c) for r in got} == want
    tokens, sections = np.array([0, 3, 8, 10]), np.array([0, 5, 6, 10])
    assert [list(token_counts.attribute(tokens, sections, r)[0]) for r in token_counts.RULES] == [[2, 0, 1], [2, 0, 1], pytest.approx([1.4, 0.2, 1.4])]
    assert list(token_counts.attribute(tokens, sections, "start")[1]) == [1, 0, 0]


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path, limit = P.path("word_bpe_49k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, s, len(x := ids[s : s + limit]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), limit))]
    got = packing.pack_documents(docs, path, limit).toPandas()
    ids = [str(None if x != x else int(x)) for x in got["doc_id"].astype(float)]
    assert sorted(zip(ids, got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.concatenate([[0], np.cumsum(own["length"])[:-1]])).all() and own["length"].sum() <= limit
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // limit) + 1


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for length, first, stop, base, each, at in packing.sweep(counts, 40):
            for r in range(first, stop):
                seq = base + (r - first) // each
                assert used.get(seq, 0) == at + (r - first) % each * length
                used[seq] = used.get(seq, 0) + length
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((40 if fit is None else fit) - n)
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= 40 and len(used) == len(gaps)


@pytest.mark.parametrize("law", sharding.LAWS)
def test_sharding(docs, rows, law):
    got = sharding.shard(docs, 4, law).toPandas()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    ids = [str(None if x != x else int(x)) for x in got["doc_id"].astype(float)]
    assert sorted(zip(ids, got["size"], got["text_crc32"])) == want
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    if law == "rows":
        assert np.ptp(got.groupby("shard").size()) <= 1
    elif law == "bytes":
        assert np.ptp(got.groupby("shard")["size"].sum().reindex(range(4), fill_value=0)) <= 2 * got["size"].max()
    else:
        assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 4)).all()
        assert got[got["doc_id"] == 33]["shard"].nunique() == 1


def voted(text):
    """SimHash by its definition: every word with its follower votes with 128 bits of a hash."""
    import re
    import struct

    xxhash = pytest.importorskip("xxhash")
    of_long = lambda x, seed=42: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
    names = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    votes = [0] * 128
    for k, x in enumerate(names):
        low = of_long(names[k + 1], of_long(x)) if k + 1 < len(names) else of_long(x)
        value = of_long(low) << 64 | low
        for bit in range(128):
            votes[bit] += 1 if value >> bit & 1 else -1
    return f"{sum(1 << bit for bit, x in enumerate(votes) if x > 0):032x}"


def test_fingerprints(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgö") for _ in range(5)) for _ in range(400)]
    texts = [None, "", " \n", "One", "one", "a  b\ta b ", "x " * 700, "x y " * 300] + [" ".join(rng.choice(pool) for _ in range(n)) for n in (3, 126, 127, 128, 129, 1000, 50, 50, 60)]
    texts += [texts[-1].replace(texts[-1].split()[30], "zz"), texts[-2]]
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    prints = {i: voted(t) for i, t in ordered}
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for (i, t), (j, follower) in zip(ordered, ordered[1:] + ordered[:1]):  # after the last comes the first
        half = len(t) // 2
        edited, r = t[: len(t) - half] + follower[:half], got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], voted(edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(near(prints[i], voted(edited))), pytest.approx(near(prints[i], prints[j])))
    assert len(got) == len(rows)
    classes = {i: i for i in prints}
    for _ in prints:
        for i, x in prints.items():
            classes[i] = min(classes[j] for j, y in prints.items() if (int(x, 16) ^ int(y, 16)).bit_count() <= simhash.RADIUS)
    assert {i: r.near_class for i, r in got.items()} == classes


def test_near_classes(spark, monkeypatch):
    rng = random.Random(16)
    base = [rng.getrandbits(128) for _ in range(40)]
    for b in base[:15]:
        base += [b ^ sum(1 << x for x in rng.sample(range(128), k)) for k in (1, 5, 10, 18, 19, 20, 21, 30)]
    base += [base[0] ^ (1 << k) for k in range(60)] + base[:5] + [0, 0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(b >> 64), signed(b & (1 << 64) - 1), i if i % 3 else None) for i, b in enumerate(base)], "hi long, lo long, doc_id long")
    for rotations, cell in ((16, 1 << 14), (2, 3)):
        monkeypatch.setattr(simhash, "CELL_ROWS", cell)
        monkeypatch.setattr(simhash, "ROTATIONS", rotations)
        left, want = dict.fromkeys(base), {}
        while left:
            reached, new = set(), [next(iter(left))]
            while new:
                reached.update(new)
                new = [b for b in left if b not in reached and any((a ^ b).bit_count() <= 19 for a in new)]
            least = min((i for i, b in enumerate(base) if b in reached and i % 3), default=None)
            want |= dict.fromkeys(reached, least)
            left = {b: None for b in left if b not in reached}
        got = simhash.near_classes(table, 19).collect()
        assert {(r.hi % (1 << 64)) << 64 | r.lo % (1 << 64): r.near_class for r in got} == want


def test_fingerprints_of_odd_rows(docs, rows):
    got = simhash.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    unique = {i: t or "" for i, t in rows if sum(i == j for j, _ in rows) == 1}
    assert all(r.fingerprint == voted(unique[r.doc_id]) for r in got if r.doc_id in unique)


def test_near_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(40)]
    for b in base[:20]:
        for k in range(1, 7):
            base.append(b ^ sum(1 << x for x in rng.sample(range(128), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(b >> 64), signed(b & (1 << 64) - 1)) for b in base + base[:3]], "hi long, lo long")
    for radius in (1, 3, 5):
        want = {frozenset((a, b)) for a in base for b in base if a != b and (a ^ b).bit_count() <= radius}
        whole = lambda h, l: (h % (1 << 64)) << 64 | l % (1 << 64)
        got = [frozenset((whole(r.a_hi, r.a_lo), whole(r.b_hi, r.b_lo))) for r in simhash.near_fingerprints(table, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_counts(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(30)]
    for b in base[:12]:
        base += [b ^ sum(1 << x for x in rng.sample(range(128), k)) for k in (1, 2, 10, 18, 19, 20, 21)]
    base += base[:5] + [0, 0, 0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(b >> 64), signed(b & (1 << 64) - 1)) for b in base], "hi long, lo long")
    for radius, cell in ((3, 1 << 14), (18, 1 << 14), (19, 1 << 14), (19, 3)):
        monkeypatch.setattr(simhash, "CELL_ROWS", cell)
        want = {b: sum((a ^ b).bit_count() <= radius for a in base) - 1 for b in base}
        got = simhash.near_counts(table, radius).collect()
        assert len(got) == len(want) and {(r.hi % (1 << 64)) << 64 | r.lo % (1 << 64): r.n_near for r in got} == want


def test_near_copies_of_one_word_changed_are_near(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows = []
    for i in range(12):
        words = [rng.choice(pool) for _ in range(150)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:70] + ["changed"] + words[71:]))]
    rows += [(100, "one text only"), (101, "one text only")]
    got = {r.doc_id: r.near_class for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_language_id(spark, docs):
    rng = random.Random(11)
    kinds = {"aa": "the and ing ion er".split(), "bb": "sch ung ein der ß".split(), "cc": "é eau oi ment la".split()}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    table = spark.createDataFrame([(i, text(k := "aabbcc"[i % 3 * 2 :][:2], rng.randint(5, 80)), k) for i in range(300)], "doc_id long, text string, lang string")
    models = language_id.fit(table, F.col("doc_id") % 5 != 0, per_language=40)
    told = language_id.identify(table, models).collect()
    held = [r for r in told if r.doc_id % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in told) and sum(r.accepted for r in told) >= 0.99 * len(told)
    odd = language_id.identify(docs, models)
    assert odd.columns[:11] == docs.columns and odd.columns[11:] == ["lang_pred_", "score", "cross_entropy", "accepted_"]
    for r in odd.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred_ == "und") == (not letters) and (letters or not r.accepted_)
    noise = spark.createDataFrame([(1, "qzx jkq vvw xqz " * 30)], "doc_id long, text string")
    assert not language_id.identify(noise, models).first().accepted
    none = language_id.fit(table.where("false"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(table, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    models = language_id.LanguageModels({"x": ["abracadabra abc", "cab dab"], "y": ["zzz abc"]})
    alphabet = np.arange(len(models.letters) + 2, dtype=np.uint64)
    for context in ([1, 2, 3], [2, 2, 2], [3, 1, 2]):
        head = np.uint64(0)
        for c in context:
            head = head << np.uint64(16) | np.uint64(c)
        total = np.exp(models.log_probabilities(head << np.uint64(16) | alphabet).astype(float)).sum(axis=0)
        assert total == pytest.approx(np.ones(2), abs=1e-3)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    table = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(400)]
    table += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan"), 0.0, 0.0, 0.0]), (403, [float("inf")] * 4), (450, table[7][1]), (451, table[7][1]), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, table[3][1])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    fine = {i: np.floor(256 * np.array(v, np.float64)) for i, v in table if i is not None and i not in (400, 401, 402, 403)}
    for size in (64, 8192):
        kdtree.SHARD_ROWS = size
        got = {}
        for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        for q in [i for i in fine if i % 50 == 0]:
            scores = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
            assert [got[q][k + 1] for k in range(len(scores))] == [(i, -s) for s, i in scores]
    assert kdtree.top_k(df.where("false"), F.lit(True), 5).isEmpty()


def test_top_k_of_large_components(spark):
    rows = [(1, [1.1e12, 1.0]), (2, [1e300, -1e300]), (3, [-1e300, 0.0]), (4, [0.5, 0.25]), (5, [float("inf"), 0.0]), (6, None)]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 4, 5).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(1, 2), (2, 1), (3, 3)]
    assert next(r.score for r in got if r.vec_id == 1) == 128 * 256 * 1_100_000_000_000 + 64 * 256


def test_empty_tables(empty):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    made = [minhash.near_duplicates(empty), substring_dedup.dedup_words(empty), suffix_dedup.dedup_bytes(empty), substring_dedup.without_repeats(empty), bpe.bpe_digests(empty, path, pattern), token_counts.section_tokens(empty, path, pattern),
            packing.pack_documents(empty, P.path("word_bpe_49k.json")), sharding.shard(empty), simhash.edited_fingerprints(empty), language_id.identify(empty, language_id.fit(empty, F.lit(True)))]
    assert all(df.isEmpty() for df in made)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    import corpus_pipeline

    told = docs.withColumn("lang", F.lit("en"))
    for table in (told, empty):
        current = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, current, str(tmp_path))
            assert made.columns == docs.columns
            made.write.parquet(f"file://{tmp_path}/{name}{table is empty}")
            before, current = current, spark.read.parquet(f"file://{tmp_path}/{name}{table is empty}")
            assert current.count() <= before.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path))
        assert packed.where("piece = 0").count() == current.count()


def test_near_copy_stage(spark, docs, rows):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    long, lost = " ".join(word() for _ in range(90)), " ".join(word() for _ in range(80))
    extra = [(500, long), (500, lost), (None, long + " end"), (None, lost), (None, lost), (None, word() + " alone"), (501, "other text here " + word()), (501, "nothing alike in it " + word())]
    table = docs.union(spark.createDataFrame([(i, t, "en", "s", len(t), 5, "x", 1, "y", "z", 9) for i, t in extra], docs.schema))
    known = sorted({(i is None, i or 0, t or "") for i, t in rows + extra})
    group = {k: k for k in known}
    find = lambda k: k if group[k] == k else find(group[k])
    sets = {k: shingles(k[2], 5) for k in known}
    for a in known:
        for b in known:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                group[q] = p
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_copy_stage(spark, table, "").collect())
    assert got == sorted(k for k in known if find(k) == k)
