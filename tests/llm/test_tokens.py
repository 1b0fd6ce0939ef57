import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stepframe.llm import op6_rans_files, op7_packing, pieces, rans
from stepframe.llm.op5_tokens import count_tokens
from stepframe.llm.shared import shared_path

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def texts(n=3000):
    random.seed(5)
    parts = [*"ab AB  \n\n\t'sre.,!12é中́Σ\x00\x1c\x85  ", "<|endoftext|>", "<|startoftext|>", "'re", "▁", "<s>", "</s>", "the cat", " of", "…", "😀"]
    return [None, "", " ", "\n", "a" * 3000, "foo  bar " * 300, *["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)]]


@pytest.mark.parametrize(("path", "keep"), [(BYTES, True), (WORDS, False)])
def test_ids_equal_the_library_on_whole_texts(path, keep):
    t, e = Tokenizer.from_file(path), pieces.SpacedEncoder(path, keep)
    for text, ids in zip(texts(), e.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_counts_equal_the_library_on_whole_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, n in zip(texts(), pieces.PieceCounter(PIECES).count(texts()), strict=True):
        assert n == len(model.encode(text or "")), text


def test_long_texts_are_cut_safely(monkeypatch):
    long = "".join(f"word{i % 97}, and more. " for i in range(5000))
    assert "".join(pieces.segments(long, 1000)) == long and len(pieces.segments(long, 1000)) > 50
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    parts = pieces.segments(long, 1000, keep_space=False)
    assert sum(sum(pieces.PieceCounter(PIECES).count([p])) for p in parts) == len(model.encode(long))


@pytest.mark.parametrize("unit", ["слово и ещё одно ", "一二三四五", "word\n", "abcdefgh"])
def test_long_texts_without_places_to_cut(unit):
    long = unit * (2_000_100 // len(unit) + 1)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    short = "some plain words, and more"
    assert pieces.PieceCounter(PIECES).count([long, None, short]) == [len(model.encode(long)), 0, len(model.encode(short))]


def docs_of(spark, held):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(held)], "doc_id long, text string, n_tokens int")


def test_token_counts(spark):
    held = texts(300)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in count_tokens(docs_of(spark, held), PIECES, 20).collect()}
    assert len(got) == len(held)
    for i, t in enumerate(held):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 20)
    assert count_tokens(docs_of(spark, held).limit(0), PIECES, 20).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 1_400_000])
def test_rans_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    symbols = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    table = rans.Table(rans.normalised(np.bincount(symbols, minlength=50_257)))
    block = rans.encode(symbols, table)
    assert (rans.decode(block, table) == symbols).all()
    many = rans.parts(block)
    assert len(many) == max(1, -(-(-(-n // rans.LANES)) // rans.EVERY))
    if n > 100_000:
        k = rans.EVERY * rans.LANES
        assert (rans.decode_part(block, many[2], table) == symbols[2 * k : 3 * k]).all()
        assert len(block["words"]) < 2 * n
        with pytest.raises(rans.ChecksumError):
            rans.decode({**block, "words": b"\x00" + block["words"][1:]}, table)


def test_rans_files(spark, monkeypatch):
    monkeypatch.setattr(op6_rans_files, "BLOCK_TOKENS", 500)
    held = texts(300)
    t = Tokenizer.from_file(BYTES)
    docs = docs_of(spark, held).repartition(5)
    docs = docs.unionByName(docs.where("doc_id = 7")).unionByName(spark.createDataFrame([(None, "no id", 1)], docs.schema))
    path = shared_path(spark, "test")
    got = sorted(op6_rans_files.write_and_digest(docs, BYTES, 2, 50_257, path).collect(), key=lambda r: r.start)
    at = 0
    want = []
    for i, x in [(None, "no id"), *sorted([*enumerate(held), (7, held[7])], key=lambda x: x[0])]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert op6_rans_files.write_and_digest(docs.limit(0), BYTES, 2, 50_257).count() == 0


def test_fullest_combination_is_the_best():
    random.seed(2)
    for _ in range(60):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(6)}
        chosen = op7_packing.fullest(counts, 40)
        sums = {max(counts)}
        for length, n in counts.items():
            for _ in range(n - (length == max(counts))):
                sums |= {s + length for s in sums if s + length <= 40}
        assert sum(k * m for k, m in chosen.items()) == max(sums) and all(counts[k] >= m for k, m in chosen.items())


def test_packing(spark):
    held = [*texts(200), "word " * 9000, "hello world", "", *["same text here"] * 200]
    t = Tokenizer.from_file(WORDS)
    docs = docs_of(spark, held)
    got = op7_packing.pack_documents(docs.unionByName(docs.where("doc_id = 3")), WORDS, 0, 256).collect()
    want = []
    for i, x in [*enumerate(held), (3, held[3])]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(w[3] for w in want) // 256) + 1
    assert op7_packing.pack_documents(docs.limit(0), WORDS, 0, 256).count() == 0
