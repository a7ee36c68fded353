"""Packing, shingles, MinHash near-dedup, line dedup and SentencePiece, against brute force."""

import collections
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipelens.llm import line_dedup, minhash, packing, sentencepiece_dropout, shingles
from pipelens.llm.common import connected_components
from pipelens.llm.entry import op1_packing, op3_sentencepiece, op4_minhash, op7_line_dedup, tokenizer_file
from pipelens.llm.line_dedup import dedup_lines
from pipelens.llm.minhash import near_duplicates
from pipelens.llm.packing import pack_documents, plan
from pipelens.llm.shingles import shingle_sets
from tests.llm.conftest import ODD, words

BPE, SP = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


# --- packing ----------------------------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_plan_uses_the_histogram_up(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    used = np.zeros(65, int)
    for pattern, n in plan(histogram, 64):
        assert sum(pattern) <= 64 and n > 0
        for p in pattern:
            used[p] += n
    assert (used == histogram).all()


def check_packed(rows, texts, encode, window):
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc, pieces in by_doc.items():
        at = 0
        ids = np.array(encode(texts[doc] or "") + [0], "<u4")
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and 0 < p.length <= window
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by_sequence))


def slow_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_of_a_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packed(op1_packing(spark, sf).collect(), texts, slow_encoder(), 1024) > 0.95


def test_packing_of_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    rows = [(i, t) for i, t in ODD if i not in (None, 5)] + [(20 + i, "same text") for i in range(30)]
    assert check_packed(pack_documents(docs(rows), BPE, 64).collect(), dict(rows), slow_encoder(), 64) > 0.9
    twice = pack_documents(docs(ODD), BPE, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert sum(r.doc_id == 5 for r in twice) == 2 and any(r.doc_id is None for r in twice)
    assert pack_documents(docs([]), BPE).count() == 0


def test_packing_of_equal_and_long_rows(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    same = pack_documents(docs([(1, "one and the same")] * 50 + [(2, "other")] * 7), BPE, 16).collect()
    assert len(same) == 57 and len({(r.sequence_id, r.offset) for r in same}) == 57
    long = {1: " " * 1_200_000, 2: "\n" * 1_200_000, 3: "a" * 1_000_000, 4: "x y" * 5}
    check_packed(pack_documents(docs(list(long.items())), BPE).collect(), long, slow_encoder(), 1024)


def test_fast_encoder_gives_the_same_ids():
    texts = ["a<|endoftext|>b", "", " \n\n x\t\t y  ", "É̀ 🙂‍ x's'S 12 ３", "don't 123 \u00a0 x", "".join(map(chr, range(32, 900)))]
    assert packing._encoder(BPE)(texts) == [slow_encoder()(t) for t in texts]


# --- shingles and MinHash ---------------------------------------------------------------------------------------------


def word_set(text, k):
    raw = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {i: word_set(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(a), root(b)
                top[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), root(i)) for i in ids}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \n\té", max_size=12)), max_size=8), st.integers(1, 3))
def test_shingle_sets(texts, k):
    found = list(shingle_sets(pa.array(texts, pa.string()), k))
    want = [word_set(t, k) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in want]
    for f, w in zip(found, want):
        for g, v in zip(found, want):
            assert len(np.intersect1d(f, g)) == len(w & v)


def variants(n, edits, seed):
    rng, base, out = random.Random(seed), words(60, seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_like_brute_force(docs):
    texts = variants(40, 4, 1) + variants(60, 9, 2) + variants(25, 6, 3) + ["copy of one text here"] * 30 + [" ".join(words(30, s)) for s in range(20)]
    random.Random(5).shuffle(texts)
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(2, None), (3, ""), (4, " \n "), (5, "one"), (6, "ONE"), (7, "one two"), (8, "x y\n" * 2000)]
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), k, 80).collect()}
        assert got == brute_components(rows, k, 80)


def test_near_duplicates_of_odd_rows(docs):
    got = near_duplicates(docs(ODD), 2, 80).collect()
    assert len(got) == len(ODD) and [r.kept for r in got if r.doc_id is None] == [True]
    assert sum(r.doc_id == 5 and r.component_id == 5 for r in got) == 2
    assert near_duplicates(docs([]), 2, 80).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(docs):
    t, u = "one two three four five six seven", "eight nine ten eleven twelve"
    got = {(r.doc_id, r.th): r for r in near_duplicates(docs([(3, t), (5, t), (5, u), (9, u), (5, t)]), 2, 80).collect()}
    assert sorted((i, r.component_id, r.kept, r.leader) for (i, _), r in got.items()) == [(3, 3, True, True), (5, 3, False, False), (5, 5, True, True), (9, 5, False, False)]


def test_heavy_shingles_are_joined_in_parts(docs, monkeypatch):
    """Many texts just under the threshold, whose rare shingles are shared by groups."""
    monkeypatch.setattr(minhash, "POSTINGS", 3)
    monkeypatch.setattr(minhash, "CENTRE_ROWS", 4)
    rows = list(enumerate(variants(60, 9, 2) + variants(40, 5, 4)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(words(5000, 3)) + " " + "y" * 3000 + "  " + " ".join(words(300, 5))
    whole = next(shingle_sets(pa.array([text]), 5))
    monkeypatch.setattr(shingles, "CHUNK", 500)
    assert next(shingle_sets(pa.array([text]), 5)).tolist() == whole.tolist()


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op4_minhash(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_estimates_are_near_the_truth(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    pairs = []
    for share in (0.0, 0.5, 0.8, 1.0):
        b = np.concatenate([a[: int(1000 * share)], rng.integers(0, 2**63, 1000 - int(1000 * share)).astype(np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pairs.append((truth, *[[int(x) for x in minhash.signature(minhash.minima(s))] for s in (a, b)]))
    got = spark.createDataFrame(pairs, "truth double, a array<long>, b array<long>").select("truth", minhash.estimate("a", "b").alias("e")).collect()
    assert all(abs(r.truth - r.e) < 0.13 for r in got)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(1000, i) for i in range(200, 260)] + [(7, 7), (3, 9), (9, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(50, 91)} == {50} and got[1000] == 200 and got[9] == 3 and 7 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- line dedup -------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    """The runs that winnowing finds, worked out document by document."""
    docs = []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, at = [], 0
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" ")
            if line:
                n = max(sum(line.count(c) for c in line_dedup.GAPS) + 1, -(-len(line) // line_dedup.UNSPACED))
                lines.append((line, pos, at, at + n))
                at += n
        docs.append((i, lines))
    return docs


def test_lines_repeated_later_are_cut(docs):
    run = ["\n".join(" ".join(words(20, 100 * s + i)) for i in range(5)) for s in range(3)]
    own = lambda s: " ".join(words(15, 9000 + s))
    long_line = " ".join(words(60, 77))
    rows = [
        (1, f"{own(1)}\n{run[0]}\n{own(2)}"),
        (2, f"{own(3)}\n{run[0]}\n{own(4)}"),
        (3, run[0]),
        (4, f"{own(5)}\n{long_line}\n\n{own(6)}"),
        (5, f"{own(7)}\n{long_line}\n{own(8)}"),
        (6, f"{own(9)}\nshort line\n{own(10)}"),
        (7, f"{own(11)}\nshort line\n{own(12)}"),
        (8, f"{run[1]}\n{own(13)}\n{run[1]}"),
        (9, "\n".join([own(14)] * 40)),
    ]
    got = {r.doc_id: (r.text, r.n_removed, r.n_chars) for r in dedup_lines(docs(rows)).collect()}
    want = dict(rows)
    for i in (1, 4, 6, 7):
        assert got[i][:2] == (want[i], 0)
    assert got[2][0] == f"{own(3)}\n{own(4)}" and got[2][1] == 5
    assert got[3][0] == ""
    assert got[5][0] == f"{own(7)}\n{own(8)}"
    assert got[8][0] == f"{run[1]}\n{own(13)}"
    assert got[9][0].split("\n")[0] == own(14) and len(got[9][0].split("\n")) < 8
    assert all(n == len(t) for t, _, n in got.values())


def test_nothing_is_lost_and_runs_are_found(docs):
    """Every line cut stands in what is left; every whole repeated document of enough words goes."""
    rng = random.Random(4)
    pool = ["\n".join(" ".join(words(rng.randint(3, 30), 50 * s + i)) for i in range(rng.randint(1, 8))) for s in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(words(12, 10**6 + 100 * i + k)) for k in range(rng.randint(1, 6)))) for i in range(150)]
    left = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    kept = {line.strip(" ") for t in left.values() for line in t.split("\n")}
    assert {line.strip(" ") for _, t in rows for line in t.split("\n")} - kept <= {""}
    first = {}
    for i, t in rows:
        if t in first and sum(x[3] - x[2] for x in brute_lines([(i, t)], 0)[0][1]) >= 60:
            assert len(left[i]) < len(t)
        first.setdefault(t, i)


def brute_repeats(rows, least):
    """The text that is left if every line goes that belongs to a run of ``least`` words seen earlier."""
    docs = brute_lines(rows, least)
    left, places = {}, collections.defaultdict(list)
    for d, (i, lines) in enumerate(docs):
        gone = set()
        for n, (line, *_) in enumerate(lines):
            for e, m in places[line]:
                other, size = docs[e][1], 0
                while n + size < len(lines) and m + size < len(other) and lines[n + size][0] == other[m + size][0]:
                    size += 1
                if lines[n + size - 1][3] - lines[n][2] >= least:
                    gone |= set(range(lines[n][1], lines[n + size - 1][1] + 1))
            places[line].append((d, n))
        left[i] = "\n".join(x for pos, x in enumerate((dict(rows)[i] or "").split("\n")) if pos not in gone)
    return left


def test_a_passage_is_found_though_its_lines_stand_alone_earlier(docs):
    """Each line of the passage, so also its fingerprint, first stands in other surroundings."""
    own = lambda s: " ".join(words(30, 7000 + s))
    passage = [" ".join(words(n, 600 + n)) for n in (8, 14, 11, 13, 15)]
    rows = [(1 + i, f"{own(2 * i)}\n{line}\n{own(2 * i + 1)}") for i, line in enumerate(passage)]
    rows += [(i, "\n".join([own(i), *passage, own(i + 1)])) for i in (20, 30)]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50) == dict(rows) | {30: f"{own(30)}\n{own(31)}"}


def test_runs_are_cut_to_their_ends(docs):
    """What follows a long fingerprint line goes too; all runs of 50 words seen earlier, and nothing else."""
    own = lambda s: " ".join(words(30, 8000 + s))
    long_line = " ".join(words(70, 78))
    rows = [(i, f"{own(i)}\n{long_line}\n\nshort one\nand another\n{own(50 + i)}") for i in range(3)]
    rng = random.Random(6)
    lines = [" ".join(words(rng.choice([1, 2, 5, 9, 20, 60]), 300 + s)) for s in range(25)]
    pool = [[rng.choice(lines) for _ in range(rng.randint(2, 15))] for _ in range(12)]
    for i in range(100, 180):
        parts = [rng.choice(pool) if rng.random() < 0.6 else [rng.choice(lines)] if rng.random() < 0.5 else [own(100 * i)] for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(line for p in parts for line in p)))
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got[1] == f"{own(1)}\n{own(51)}"
    assert got == brute_repeats(rows, 50)


def test_passages_without_spaces_count(docs):
    rng = random.Random(9)
    line = lambda: "".join(rng.choices("漢字仮名交文日本語", k=300))
    shared, tabs = [line() for _ in range(5)], "\t".join(words(60, 5))
    rows = [(i, "\n".join([line(), *shared, tabs, line()])) for i in range(3)] + [(7, f"{line()}\n{tabs}\n{line()[:90]}"), (8, f"{shared[0]}\n{line()}")]
    got = {r.doc_id: r.text for r in dedup_lines(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50) and len(got[1].split("\n")) == 2 and len(got[7].split("\n")) == 2 and got[8] == rows[-1][1]


def test_line_dedup_of_odd_rows(docs, spark, sf):
    got = dedup_lines(docs(ODD)).collect()
    texts = {r.doc_id: r.text for r in got}
    assert len(got) == len(ODD) and texts[2] is None and texts[3] == "" and texts[7] == "a" * 5000 and got[0].runs == "x"
    assert sum(r.doc_id == 5 and r.text == "one" for r in got) == 2
    assert dedup_lines(docs([])).count() == 0
    out = op7_line_dedup(spark, sf)
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in out.collect()} == brute_repeats(list(table.items()), 50)
    physical = out._jdf.queryExecution().toString()
    assert "Python" not in physical and "Arrow" not in physical


# --- SentencePiece ----------------------------------------------------------------------------------------------------


def test_without_dropout_the_library_agrees(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["  a\n bé🙂 x ", "a" * 300 + " " + "ab" * 40, "", "   ", "\n\n", "tab\there ﬁ"]
    got = sentencepiece_dropout.Encoder(SP, 0, 0.0, 4).encode(list(enumerate(texts)))
    assert [g.tolist() for g in got] == [sp.encode(t) for t in texts]


def test_dropout_is_seeded_varied_and_lossless(docs):
    rows = [(i, t) for i, t in ODD] + [(100 + i, "the same ordinary sentence about nothing in particular") for i in range(40)]
    one = lambda seed, rate=0.3: sentencepiece_dropout.decode(sentencepiece_dropout.encode(docs(rows), SP, seed=seed, dropout=rate), SP).collect()
    a, b, c = one(1), one(1), one(2)
    ids = lambda rs: [r.ids for r in rs]
    assert ids(a) == ids(b) and ids(a) != ids(c)
    assert all(r.decoded == r.text for r in [*a, *c])
    assert len({tuple(r.ids) for r in a if r.doc_id and r.doc_id >= 100}) > 1
    assert one(1)[1].ids is None and sentencepiece_dropout.encode(docs([]), SP).count() == 0
    plain, whole = sum(len(r.ids or []) for r in one(1, 0.0)), sum(len(r.ids or []) for r in one(1, 1.0))
    assert plain < sum(len(r.ids or []) for r in a) < whole


def agenda(e, chunk, key):
    """One chunk by a plain agenda: the best pair first, the leftmost of equals; each candidate is skipped by its own hash."""
    mask, v = (1 << 64) - 1, e.v

    def splitmix(x):
        x &= mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def skipped(a, m, b):
        name = splitmix(splitmix(a * 0x9E3779B97F4A7C15 + 1) + m * 0xC2B2AE3D27D4EB4F + b)
        return (splitmix(key + name) >> 11) * 2.0**-53 < e.rate

    parts = []
    for c in chunk:
        i = int(v.char[ord(c)])
        parts += [i] if i >= 0 else v.byte[list(c.encode())].tolist()
    parts = [(i, at, at + 1) for at, i in enumerate(parts)]
    while True:
        found = []
        for n, ((i, a, m), (j, _, b)) in enumerate(zip(parts, parts[1:])):
            to = v.pairs.get(i * 65536 + j)
            if to and not skipped(a, m, b):
                found.append((to[1], n, to[0], a, b))
        if not found:
            return np.array([i for i, _, _ in parts], np.uint16).tobytes()
        _, n, to, a, b = min(found)
        parts[n : n + 2] = [(to, a, b)]


def test_all_ways_of_merging_equal_the_plain_agenda(monkeypatch):
    e = sentencepiece_dropout.Encoder(SP, 3, 0.2)
    rng = random.Random(1)
    chunks = [f"▁{w}" for w in ["hello", "thehawhen", "x", "naïve", "antidisestablishmentarianism", "🙂🙂", "ab" * 20]] + ["▁" * n for n in (2, 7, 40, 90)]
    chunks += ["▁" + "".join(rng.choices(letters, k=n)) for letters in ("abcdest", "=-", "▁a", "xyé漢") for n in (3, 30, 80)]
    for rate in (0.0, 0.1, 0.5):
        e.rate = rate
        for key in range(3):
            own = int(sentencepiece_dropout.mix(sentencepiece_dropout.mix(np.array([key + 3 * 1_000_003], np.uint64)))[0])
            want = [agenda(e, c, own) for c in chunks]
            for long in (10**9, 0, 48):
                monkeypatch.setattr(sentencepiece_dropout, "LONG", long)
                assert e.segment(chunks, key) == want


def test_long_runs_take_linear_time():
    e = sentencepiece_dropout.Encoder(SP, 3, 0.1)
    rng = random.Random(2)
    for text in (" " * 100_000, "\n" * 500_000, "a" * 500_000, "".join(rng.choices("abcdefghij", k=200_000)), "-" * 100_000):
        start = time.process_time()
        ids = e.encode([(4, text)])[0]
        assert time.process_time() - start < 20
        assert b"".join(e.v.bytes_of[i] for i in ids).decode()[1:] == text


def test_each_occurrence_has_its_own_dropout(docs, monkeypatch):
    """Within a document and over documents of one text, and as merging each occurrence by itself gives."""
    word = "unbelievably"
    rows = [(i, " ".join([word] * 20)) for i in range(40)]
    got = [tuple(r.ids) for r in sentencepiece_dropout.encode(docs(rows), SP, seed=1, dropout=0.3).collect()]
    assert len(set(got)) == 40
    assert got == [tuple(r.ids) for r in sentencepiece_dropout.encode(docs(rows).repartition(3), SP, seed=1, dropout=0.3).orderBy("doc_id").collect()]
    e = sentencepiece_dropout.Encoder(SP, 5, 0.2)
    seen = {e.encode([(7, f"{'x ' * n}{word}")])[0].tobytes()[-6:] for n in range(40)}
    assert len(seen) > 4
    texts = [f"{word} naïve 🙂 {'ab' * 40} the_of {word}, ▁ a1b2c3d4 antidisestablishmentarianism \n  {word * 9}", word, ""]
    for key, text in enumerate(texts * 20):
        chunks = sentencepiece_dropout.CHUNK.findall("▁" + text.replace("▁", "\ud800").replace(" ", "▁")) if text else []
        own = sentencepiece_dropout.mix(np.array([key + 5 * 1_000_003], np.uint64))
        keys = sentencepiece_dropout.mix(own + np.arange(len(chunks)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        alone = b"".join(e._segment([c], keys[n : n + 1])[0] for n, c in enumerate(chunks))
        for often, missed in ((10**9, 0), (1, 100), (1, 0)):
            monkeypatch.setattr(sentencepiece_dropout, "OFTEN", often)
            monkeypatch.setattr(sentencepiece_dropout, "MISSED", missed)
            assert e.encode([(key, text)])[0].tobytes() == alone


def test_sentencepiece_query(spark, sf):
    assert op3_sentencepiece(spark, sf).where(~F.col("lossless")).count() == 0


assert public_tokenizers and pytest
