import zlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtrace.llm.common import WordMemo, tokenizer_path
from loomtrace.llm.dac import Block, encode_block, token_files
from loomtrace.llm.packing import best_fit, pack, place
from loomtrace.llm.token_counts import spliced_count, token_counts

SCHEMA = "doc_id long, text string"
TEXTS = ["Hello there, world.", "", None, "it's 12ab don't İstanbul ΣΑΣ ´ a\x1cb <|endoftext|> x", "日本語 テスト 😀 été l'été", "  \n\t ", "word " * 5000, "x" * 3000, "Hello there, world."]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(9 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, TEXTS[5])]
    return spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash")).repartition(3)


def ids(tok, t):
    return tok.encode(t or "", add_special_tokens=False).ids


def test_memo_is_exact(tok):
    memo = WordMemo(tokenizer_path(), most=50)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(memo.encode(t or ""), "<u4").tolist() == ids(tok, t)
    many = [" ".join(f"a{k}b, c{k % 7}." for k in range(j, j + 40)) for j in range(0, 400, 9)]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode_many(many, 300)] == [ids(tok, t) for t in many]
    for c in [*range(1, 0x250), 0x300, 0x301, 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0xFEFF, 0x200B]:
        t = f"ab{chr(c)}cd {chr(c)} x{chr(c)}."
        assert np.frombuffer(memo.encode(t), "<u4").tolist() == ids(tok, t), hex(c)


@pytest.mark.parametrize("text", ["some words here, and more. " * 400, "x" * 5000 + " y " + "z" * 3000, "é ́a" * 900, "abc\x1cdef " * 500, "a\n\n b" * 700])
def test_spliced_counts(tok, text):
    for chunk, overlap in ((200, 20), (1000, 5), (64, 64)):
        assert spliced_count(tok, text, chunk, overlap) == len(ids(tok, text))


def test_token_counts(spark, docs, tok):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, chunk=1000).collect())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(ids(tok, r.text)), len(ids(tok, r.text)) > 2048) for r in docs.collect())
    assert got == want
    assert token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [8, 16])
def test_codes_round_trip(width):
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 4000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        b = Block(encode_block(x, width))
        assert np.array_equal(b.all(), x) and [b.get(i) for i in range(0, n, 37)] == x[::37].tolist()
    with pytest.raises(IndexError):
        b.get(4000)


def test_token_files(spark, docs, tok):
    got = {(r.doc_id, r.n_tokens, r.ids_crc32): r.start for r in token_files(docs).collect()}
    want = {}
    for r in docs.collect():
        x = np.array([*ids(tok, r.text), 1], "<u4")
        want[r.doc_id, len(x), zlib.crc32(x.tobytes())] = None
    assert set(got) == set(want)
    order = sorted(got, key=lambda k: got[k])
    at, seen = 0, []
    for k in order:
        seen.append(k[0])
        at = max(at, got[k]) if got[k] >= at else pytest.fail("starts overlap")
    assert [x is None for x in seen] == sorted([x is None for x in seen], reverse=True) and [x for x in seen if x is not None] == sorted(x for x in seen if x is not None)
    assert token_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_best_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 500)
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sizes[b].sum() <= 100 for b in bins)
    rooms = []  # the same rule, plainly
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(100 - s)
    assert len(bins) == len(rooms)


def test_pack(spark, docs, tok):
    rows = pack(docs, 64).collect()
    want = []
    for r in docs.collect():
        x = np.array([*ids(tok, r.text), 0], "<u4")
        want += [(r.doc_id or -1, p, s, len(x[s : s + 64]), zlib.crc32(x[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(x), 64))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(w[3] for w in want) // 64) + 2
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pack_in_rounds_keeps_what_later_rounds_can_use(spark):
    """Small lots, few spare bins and many rounds: within a tenth of one best fit over all."""
    rng = np.random.default_rng(7)
    words = [int(x) for x in rng.integers(0, 60, 400)]
    df = spark.createDataFrame([(i, " ".join(["the"] * n)) for i, n in enumerate(words)], SCHEMA).repartition(6)
    rows = pack(df, 64, most=40, spare=12, fan_in=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.length for r in rows) == sorted(n + 1 for n in words)
    assert all(sum(n for _, n in s) <= 64 and sorted(s)[0][0] == 0 for s in by.values())
    assert len(by) <= 1.1 * len(best_fit(np.array(words) + 1, 64))


def test_bins_that_cannot_merge_do_not_travel(spark):
    from loomtrace.llm.packing import _Packer

    tags = iter(range(10_000))
    packer = _Packer(2048, 2038, 100, 5, lambda: next(tags))
    out = [b for k in range(1000) for b in packer.add([1030], [b"x"])] + list(packer.end())
    final = sum(sum(b.column("done").to_pylist()) for b in out)
    assert sum(b.num_rows for b in out) == 1000 and final == 995


def test_small_bins_find_every_bin_with_room(spark):
    """Each of 30 tasks has a bin of 40 and a small one of 24: with one spare bin of a size, all the small ones still find a place."""
    df = spark.createDataFrame([(i, " ".join(["the"] * (39 if i % 2 else 23))) for i in range(60)], SCHEMA)
    lots = [df.where(f"doc_id = {i}").coalesce(1) for i in range(60)]
    rows = pack(reduce(lambda a, b: a.union(b), lots), 64, spare=1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 60 and sorted(map(sorted, by.values())) == [[(0, 40), (40, 24)]] * 30


def test_place_is_one_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(50):
        large, small = rng.integers(33, 65, int(rng.integers(0, 60))).tolist(), rng.integers(1, 33, int(rng.integers(0, 90))).tolist()
        moves = place(list(enumerate(small)), {x: large.count(x) for x in large}, 64)
        assert len(large) + len(small) - len(moves) == len(best_fit(np.array(large + small, np.int64), 64))
        used = {}
        for tag, size, nth, at in moves:
            key = (size, nth)
            assert at == used.get(key, size if size >= 0 else small[nth]) and at + small[tag] <= 64
            assert size < 0 or 1 <= nth <= large.count(size)
            used[key] = at + small[tag]


def test_tokens_at(spark, docs, tok, tmp_path):
    """Single ids from the files are the library's."""
    from loomtrace.llm.dac import tokens_at, write_tokens

    write_tokens(docs, str(tmp_path / "t"), block_tokens=700)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    want = {}
    for r in rows:
        x = [*ids(tok, r.text), 1]
        for p in {0, len(x) // 2, len(x) - 1}:
            want.setdefault((r.doc_id, p), set()).add(int(x[p]))
    asked = [(d, p) for d, p in want] + [(rows[0].doc_id, -1), (rows[0].doc_id, 10**9), (None, 0), (10**12, 0)]
    got = {}
    for r in tokens_at(spark, str(tmp_path / "t"), spark.createDataFrame(asked + asked, "doc_id long, place long")).collect():
        got.setdefault((r.doc_id, r.place), set()).add(r.token)
    assert set(got) == set(want) and all(want[k] <= got[k] for k in want)


def test_huge_text_with_special_tokens(tok):
    from loomtrace.llm.common import WordMemo, tokenizer_path
    from loomtrace.llm.token_counts import whole_count

    text = "<|startoftext|>" + "some words, and more  \n" * 300 + "<|endoftext|>x<|endoftext|><|endoftext|> end" + " y" * 2000
    assert whole_count(WordMemo.at(tokenizer_path()), text, 1000) == len(tok.encode(text, add_special_tokens=False).ids)


def test_plain_words_spare_the_library_its_patterns(tok):
    """Letters with signs behind them go to the model alone; before, they all went through normalizer and patterns."""

    class Counted:
        seen: list[str] = []

        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, some, **more):
            self.seen += some
            return tok.encode_batch_fast(some, **more)

    memo = WordMemo(tokenizer_path())
    memo.tok = Counted()
    many = ["Plain WORDS, été. ÀÖØ öøÿ*** don't ???", "thshon,*** straße; (odd) a' l'été' x1. ×÷", "a!b c-- \u00aa\u00ba. n\u0303. =\u0338"]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode_many(many)] == [ids(tok, t) for t in many]
    assert memo.formed and not {"plain", "words", "été", "words,", "öøÿ***", "Plain WORDS"} & set(Counted.seen) and not any(" " in x for x in Counted.seen)
