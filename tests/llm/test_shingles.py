import random

import pyarrow as pa

from disarm.llm import shingles

ALPHABET = ["a", "B", "é", "the", "of", " ", "  ", "\n", "\t", "\x0b", "\xa0", "x" * 50, "Zz"]


def plain_sets(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def test_sets_have_the_size_and_overlap_of_plain_ones():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\t", "a", "A", "a b", "a b c d e", "a b c d e f"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = shingles.shingle_sets(pa.array(texts), 5)
    want = [plain_sets(t, 5) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(0, len(texts) - 1):
        assert len(set(got[i].tolist()) & set(got[i + 1].tolist())) == len(want[i] & want[i + 1])


def test_long_texts_are_hashed_in_pieces_alike(monkeypatch):
    text = " ".join(f"w{i % 97} {'y' * (i % 40)}" for i in range(5000))
    texts = pa.array(["lead in", text, None, "tail of it", text, "q" * 3000 + " end"])
    whole = shingles.shingle_sets(texts, 5)
    monkeypatch.setattr(shingles, "PIECE", 701)
    for a, b in zip(whole, shingles.shingle_sets(texts, 5)):
        assert a.tolist() == b.tolist()


def test_slices_of_a_batch_keep_their_texts():
    texts = pa.array(["one two three four five six", "seven", "eight nine ten eleven twelve"])
    assert [s.tolist() for s in shingles.shingle_sets(texts.slice(1), 5)] == [s.tolist() for s in shingles.shingle_sets(texts, 5)[1:]]
