"""Operators 1, 3, 8 and 10 against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomkv.llm import grammar, library_bpe, merges, packing, prefix_bpe, rank_merge, repair, units

MULTI, BYTES, WORDS = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = ["a", "b", "Th", "é", "É", "'s", "'", "  ", " ", "\n", "\t", "\x1c", "\x85", " ", "̈", "Σ", "İ", "1", "½", "<|endoftext|>", "!!", "ﬁ", "日本", "\0", "aaaaaaa", "🙂", " x", "ing"]
odd = st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join)


def ids_of(name, texts):
    return [e.ids for e in Tokenizer.from_file(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def multi():
    return prefix_bpe.TextEncoder(open(MULTI, "rb").read(), P.PATTERN)


@pytest.fixture(scope="module")
def tik(multi):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi.bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(odd)
def test_prefix_bpe_is_tiktoken(multi, tik, text):
    ids = np.frombuffer(multi.encode(text), "<u4").tolist()
    assert ids == tik.encode_ordinary(text) and multi.bpe.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(odd, st.integers(1, 6))
def test_long_parts(tik, text, size):
    cut = list(units.long_parts(text, size))
    assert "".join(cut) == text and [i for p in cut for i in tik.encode_ordinary(p)] == tik.encode_ordinary(text)


def test_prefix_table_appends_and_edits(multi):
    r = random.Random(1)
    for _ in range(150):
        data = bytes(r.choices(b"abcdefgh the ing\xc3\xa9", k=r.randint(0, 60)))
        a, b = prefix_bpe.Prefixes(multi.bpe, data[:20]), prefix_bpe.Prefixes(multi.bpe, data)
        a.append(data[20:])
        assert a.last == b.last
        start = r.randint(0, len(data))
        end = r.randint(start, len(data))
        b.edit(start, end, new := bytes(r.choices(b"xyz ", k=r.randint(0, 4))))
        assert b.data == data[:start] + new + data[end:] and b.last == prefix_bpe.Prefixes(multi.bpe, b.data).last
    long = prefix_bpe.Prefixes(multi.bpe, b"abcdefghij" * 2000)
    assert long.edit(10, 11, b"Q") < 3000  # far entries are taken over


def test_op1(docs, empty, texts, tik):
    raw = base64.b64decode  # the file's format
    assert raw("QQ==") == b"A"
    got = {r.doc_id: r for r in prefix_bpe.encode_decode(docs, MULTI, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = tik.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert prefix_bpe.encode_decode(empty, MULTI, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_library_units(name, texts):
    r = random.Random(2)
    many = ["".join(r.choices(ALPHABET, k=r.randint(0, 25))) for _ in range(1500)] + [t or "" for t in texts]
    enc = library_bpe.LibraryEncoder(open(name, "rb").read(), kept=200)  # the table starts anew often
    got = [x for run in library_bpe.small_batches(many, 500) for x in enc.encode_many(run)]
    assert got == [packed(x) for x in ids_of(name, many)]


def repeated(seq):
    """Pairs of neighbours that occur twice without overlap."""
    n, last = {}, {}
    for i, p in enumerate(zip(seq[:-1], seq[1:])):
        if last.get(p) != i - 1 or p[0] != p[1]:
            n[p], last[p] = n.get(p, 0) + 1, i
    return {p for p, k in n.items() if k > 1}


def plain_repair(seq, base):
    """Re-Pair one pair at a time: the most frequent one first, counted anew each time. Length of rules and sequence."""
    seq, rules = list(seq), 0
    while more := repeated(seq):
        def times(p):
            i = k = 0
            while i < len(seq) - 1:
                hit = (seq[i], seq[i + 1]) == p
                k, i = k + hit, i + 1 + hit
            return k

        best = max(sorted(more), key=times)
        out, i = [], 0
        while i < len(seq):
            hit = i + 1 < len(seq) and (seq[i], seq[i + 1]) == best
            out.append(base + rules if hit else seq[i])
            i += 1 + hit
        seq, rules = out, rules + 1
    return rules, len(seq)


@pytest.mark.parametrize("few", [2, 5, 64])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120), st.integers(1, 3))
def test_repair_leaves_no_pair_twice(few, ids, times):
    kept, grammar.FEW = grammar.FEW, few
    try:
        rules, short = grammar.compress(np.array(ids * times, np.uint32), 10)
    finally:
        grammar.FEW = kept
    assert repair.expand(short, rules, repair.expansion_lengths(rules, 10), 10).tolist() == ids * times
    assert not repeated(short.tolist()) and all(a < 10 + k and b < 10 + k for k, (a, b) in enumerate(rules.tolist()))


def test_repair_is_near_plain_repair():
    """Phrases that repeat: symbols and rules together stay within a tenth of those of the plain method."""
    r = random.Random(7)
    phrases = [[r.randint(0, 60) for _ in range(6)] for _ in range(40)]
    ids = [x for _ in range(160) for x in r.choice(phrases)]
    rules, short = grammar.compress(np.array(ids, np.uint32), 100)
    n, left = plain_repair(ids, 100)
    assert len(rules) + len(short) <= 1.1 * (n + left)
    phrases = [r.choices(range(40_000), k=6) for _ in range(3000)]
    ids = np.array([x for _ in range(60_000) for x in r.choice(phrases)], np.uint32)
    rules, short = grammar.compress(ids, 50_257)
    assert not repeated(short.tolist()) and len(short) < len(ids) / 5  # a phrase becomes one symbol


def test_repair_file():
    r = random.Random(3)
    each = [packed(r.choices(range(30), k=r.randint(0, 400)) + [2]) for _ in range(200)]
    data = repair.pack_shard([None, *range(199)], each, 100)
    asked = []
    shard = repair.Shard(lambda at, n: asked.append(n) or data[at : at + n])
    whole = np.frombuffer(b"".join(each), "<u4")
    assert (shard.ids() == whole).all() and shard.doc_ids[0] is None and len(shard.rules)
    for _ in range(100):
        a, n = r.randint(0, len(whole)), r.randint(0, 900)
        assert (shard.read(a, n) == whole[a : a + n]).all()
    assert max(asked[3:]) <= 3 * 2 * repair.SAMPLE  # parts of the sequence alone
    for k in (0, 7, 199):
        assert (shard.document(k) == np.frombuffer(each[k], "<u4")).all()
    for bad in (data[:-9] + b"x" + data[-8:], data[:60] + b"x" + data[61:], b"", data[:100]):
        with pytest.raises(ValueError):
            repair.Shard.of(bad).ids()
    none = repair.Shard.of(repair.pack_shard([], [], 100))
    assert len(none.ids()) == len(none.read(0, 5)) == 0


def test_op3(spark, docs, empty, texts):
    got = repair.write_and_read(docs, BYTES).orderBy("start").collect()
    start = 0
    for r, (i, ids) in zip(got, enumerate(ids_of(BYTES, texts)), strict=True):
        ids = ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert repair.write_and_read(empty, BYTES).count() == 0


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_range_bins(spark, monkeypatch, bins):
    """Bins are in the order of key and tie, nulls lowest; a key of many rows is spread over several."""
    from pyspark.sql import functions as F

    from loomkv.llm import common

    monkeypatch.setattr(common, "COARSE", 10)
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") * 7 - 9000).alias("doc_id"), F.xxhash64("id").alias("h"), F.col("id").alias("n"))
    made = common.RangeBins(df, "doc_id", bins)
    rows = df.withColumn("bin", made.bin(common.text_tie(F.col("h")))).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.bin for r in rows] == sorted(r.bin for r in rows) and max(r.bin for r in rows) < made.count
    most = max(sum(1 for r in rows if r.bin == b) for b in {r.bin for r in rows})
    assert most <= 3 * 6000 / bins and made.count <= 3 * bins + 10
    empty = common.RangeBins(df.where("false"), "doc_id", bins)
    assert df.withColumn("bin", empty.bin(F.lit(0.5))).agg(F.max("bin")).first()[0] == 0 and empty.cuts == []


def test_op3_repeated_and_null_ids(make_docs):
    got = repair.write_and_read(make_docs(["x", "y", "x", "x"], [None, 5, 5, 5]), BYTES).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5, 5]


def test_op10(docs, empty, texts):
    got = {r.doc_id: r for r in rank_merge.count_tokens(docs, WORDS, 500).collect()}
    for i, (t, ids) in enumerate(zip(texts, ids_of(WORDS, texts))):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 500)
    assert rank_merge.count_tokens(empty, WORDS).count() == 0


@pytest.fixture(scope="module")
def both():
    return {n: library_bpe.LibraryEncoder(open(n, "rb").read(), kept=500) for n in (WORDS, BYTES)}


@pytest.mark.parametrize("name", [WORDS, BYTES])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(odd, max_size=5))
def test_rank_merge(both, name, texts):
    assert both[name].encode_many(texts) == [packed(x) for x in ids_of(name, texts)]


def test_hashes_that_agree_by_chance(both, texts):
    """Units are compared byte by byte: where all hashes agree, texts go to the library and the ids are the same."""
    enc = library_bpe.LibraryEncoder(open(BYTES, "rb").read())
    many = [t or "" for t in texts]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(library_bpe, "_POWER", np.uint64(0))
        m.setattr(library_bpe, "_GOLD", np.uint64(0))
        assert enc.encode_many(many) == [packed(x) for x in ids_of(BYTES, many)]


def test_other_files_take_the_librarys_path():
    """A file whose steps aren't those that units rely on is recognised."""
    import json

    for name, change in ((BYTES, {"normalizer": {"type": "Lowercase"}}), (WORDS, {"normalizer": None}), (BYTES, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}})):
        spec = json.load(open(name)) | change
        file = json.dumps(spec).encode()
        enc = library_bpe.LibraryEncoder(file)
        lib = Tokenizer.from_str(file.decode())
        many = ["Ab cd, EF\n gh", "", "x  y É"]
        assert enc.merger is None and enc.encode_many(many) == [packed(lib.encode(t, add_special_tokens=False).ids) for t in many]
    assert merges.kind_of(json.load(open(WORDS)))[0] == "words" and merges.kind_of(json.load(open(BYTES)))[0] == "bytes"


def first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        b = next((k for k, x in enumerate(room) if x >= s), None)
        if b is None:
            room.append(capacity)
            b = len(room) - 1
        out.append((b, capacity - room[b]))
        room[b] -= s
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(sizes, 20) == first_fit(sizes, 20)


def test_op8(docs, empty, texts):
    got = packing.pack(docs, WORDS, 1, 64, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, ids in enumerate(ids_of(WORDS, texts)):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == packed(ids + [1]) and all(r.doc_tokens == len(ids) + 1 for r in pieces)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(empty, WORDS).count() == 0


def test_op8_ids_as_they_stand(make_docs):
    """Ids beyond 2^53 beside a null one, and repeated rows."""
    big = 1152921504606846977
    got = packing.pack(make_docs(["a b", "a b", "c", None, "d " * 300], [big, big, None, None, 7]), WORDS, 1, 64, with_ids=True).collect()
    assert sorted(r.doc_id for r in got if r.doc_id and r.doc_id != 7) == [big, big] and sum(r.doc_id is None for r in got) == 2
    assert sum(r.length for r in got if r.doc_id == 7) == 301 and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_op8_many_groups(spark, make_docs):
    """Groups share tasks; each is packed alone and whole."""
    df = spark.range(3000).selectExpr("id as doc_id", "0L as start", "1 + id % 50 as length", "0L as ids_crc32", "0L as doc_tokens")
    got = packing.pack_pieces(df, 64, group_pieces=100).collect()
    assert len(got) == len({r.doc_id for r in got}) == 3000
    by_group = {}
    for r in got:
        by_group.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(by_group) == 30
    for rows in by_group.values():
        rows.sort(key=lambda r: (-r.length, r.doc_id))
        assert [(r.sequence_id & 0xFFFFFFFF, r.offset) for r in rows] == first_fit([r.length for r in rows], 64)
