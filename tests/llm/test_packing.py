import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from disarm.llm import packing
from disarm.llm.tokens import added_tokens, little_endian, token_ids, tokenizer_path

ODD = " \n\t\r\x0b\x0c\x1c\x85\xa0 　'sSabé中1٣!|<>\0́​½"


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["", "a" * 20000, " " * 5000 + "x"]
    for token in added_tokens(tokenizer_path()):
        around = ["", " ", "  ", "a", "a ", "'s", "\n\n ", token, token[:-1], "<", "é"]
        texts += [x + token + y for x in around for y in around]
    assert added_tokens(tokenizer_path())
    for text, want in zip(texts, library().encode_batch(texts, add_special_tokens=False)):
        assert little_endian(token_ids(text, tokenizer_path())) == np.array(want.ids, "<u4").tobytes()


def best_fit_decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


def test_plan_places_all_pieces_like_best_fit_decreasing():
    rng = random.Random(5)
    for spread in (3, 40, 100):
        lengths = [rng.randint(1, spread) for _ in range(500)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        filled, placed = defaultdict(list), defaultdict(set)
        for length, lo, hi, first, offset in packing.plan_runs(counts, 100):
            for k in range(hi - lo):
                filled[first + k].append((offset, length))
                placed[length].add(lo + k)
        assert {n: len(p) for n, p in placed.items()} == counts
        assert all(p == set(range(len(p))) for p in placed.values())
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100
        assert len(filled) == best_fit_decreasing(lengths, 100)


def test_documents_are_cut_and_packed(spark):
    rng = random.Random(2)
    texts = [None, "", "x", "x"] + [" ".join(rng.choice(["the", "of", "naïve", "42"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, piece int, offset int").repartition(3)
    pieces = packing.token_pieces(docs, capacity=32)
    got = packing.pack(pieces, ["doc_id", "piece", "start"], capacity=32).collect()
    encode = library()
    want = sorted((d is None, d or 0, zlib.crc32(np.array(encode.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for d, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    single = sorted((d is None, d or 0, zlib.crc32(b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.piece)))) for d, parts in by_doc.items() if d != 5)
    assert single == [w for w in want if w[1] != 5]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 32
    assert len(by_sequence) == best_fit_decreasing([r.length for r in got], 32)
    whole = packing.sequences(spark.createDataFrame(got)).where(F.length("ids") != 4 * F.col("length"))
    assert whole.isEmpty()


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(empty), ["doc_id"]).collect() == []
