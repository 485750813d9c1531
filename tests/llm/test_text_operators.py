import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from disarm.llm import licenses, token_counts, toxicity, vector_dedup
from disarm.llm.queries import REDACTED
from disarm.llm.tokens import encoded, tokenizer_path


def count(text):
    return len(encoded(text or "", tokenizer_path()))


def test_licenses_are_found_and_named(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["thing", "and", "river", "stone", "is", "permitted"]) for _ in range(n)) + "."
    rows, want = [], set()
    for k, ((name, form), text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((k, f"{prose(300)}\n{text}\n{prose(30)}"))
        want.add((k, name))
        rows.append((100 + k, f"{prose(20)} {text.upper()} {prose(9)}"))
        want.add((100 + k, name))
    rows += [(900, None), (901, ""), (902, prose(5000)), (903, "The software license is discussed here at length."), (904, "x" * 30000 + " license")]
    rows += [(905, licenses.TEMPLATES["MIT", "text"].replace("free of charge", "for a fee")), (905, rows[0][1])]
    want |= {(905, "MIT"), (905, rows and list(licenses.TEMPLATES)[0][0])}
    found = licenses.scan_licenses(spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, license string")).collect()
    assert {(r.doc_id, r.license) for r in found} == want
    changed = [r for r in found if r.doc_id == 905 and r.license == "MIT"][0]
    assert not changed.exact and {"free", "of", "charge"} <= set(changed.missing) and {"for", "a", "fee"} <= set(changed.extra)
    by_doc = dict(rows[:-1])
    assert all(by_doc[r.doc_id][r.start:r.start + r.length].strip() for r in found if r.doc_id < 900)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_counts_after_edits_equal_full_encodings():
    rng = random.Random(6)
    bits = ["word", " word", "  ", "\n", " ", "é", "'s", " 12", "　", "\t", " a b c", "", "x" * 30, "@", "?!", "<|endoftext|>", "a.b", "7", "_", "-", "e\u0301", "!'"]
    for turn in range(60):
        pick = bits if turn % 2 else [b for b in bits if " " not in b]
        text = "".join(rng.choice(pick) for _ in range(rng.randint(0, 900)))
        tree, leaves = token_counts.build(text, tokenizer_path())
        for _ in range(12):
            start, removed = rng.randint(0, len(text) + 3), rng.choice([0, 1, 2, 40, 700])
            inserted = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 200])))
            token_counts.edit(leaves, tree, start, removed, inserted, tokenizer_path())
            text = text[:start] + inserted + text[start + removed:]
            assert "".join(leaves) == text
            assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))


def test_long_texts_take_no_longer_than_they_are():
    path = tokenizer_path()
    for text in ("x" * 300_000, "1 " * 150_000, "a@b.c," * 10_000, "1." * 150_000):
        found = list(re.finditer(REDACTED, text))
        tree, leaves = token_counts.build(text, path)
        for m in reversed(found):
            token_counts.edit(leaves, tree, m.start(), m.end() - m.start(), "[redacted]", path)
        assert "".join(leaves) == re.sub(REDACTED, "[redacted]", text)


def test_edits_of_rows(spark):
    rows = [(1, "call 555-123-4567 or a.b@example.org now " * 40), (2, None), (3, ""), (4, "nothing"), (4, "nothing"), (5, "12345 " * 3000)]
    docs = token_counts.with_trees(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int"))
    docs = docs.withColumn("edits", token_counts.redactions(F.col("text"), REDACTED, "[redacted]"))
    got = token_counts.apply_edits(docs).collect()
    assert sorted((r.doc_id, r.text, r.n_tokens) for r in got) == sorted((d, t, count(t)) for d, t in ((d, re.sub(REDACTED, "[redacted]", t or "")) for d, t in rows))
    far = spark.createDataFrame([(1, "ab", [(99, 5, "c")]), (2, "ab", None)], f"doc_id long, text string, edits {token_counts.EDITS}")
    assert [r.text for r in token_counts.apply_edits(token_counts.with_trees(far)).orderBy("doc_id").collect()] == ["abc", "ab"]
    assert token_counts.apply_edits(token_counts.with_trees(far.where("false"))).collect() == []


def labelled(spark, rng, n=1200):
    syllables = ["ba", "de", "ki", "lo", "mu", "ra", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for d in range(n):
        words = [word() for _ in range(rng.randint(3, 60))]
        toxic = d % 9 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["oaf", "cretin", "grobl" + word()]))
        docs.append((d, " ".join(words) + "."))
        labels.append((d, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_documents(spark):
    docs, labels = labelled(spark, random.Random(3))
    extra = [(90001, None), (90002, ""), (None, "oaf"), (0, docs[0][1])]
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in docs + extra], "doc_id long, text string, score double")
    kinds = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 3)], "doc_id long, toxic int")
    model = toxicity.train(frame, kinds)
    got = frame.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held"), toxicity.scores(F.col("text"), model).alias("s")).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r.s <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert len(held) > 200 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    right = [(r.s >= 0.3) == bool(truth[r.doc_id]) for r in held]
    assert sum(right) / len(right) > 0.97
    blank = {r.s for r in got if not r.text}
    assert len(blank) == 1 and blank.pop() < 0.3


def test_context_changes_the_event():
    reader = toxicity.Reader(toxicity.Model({"=oaf": 5.0}, ()))
    events = lambda text, quoted=False: reader.clause(text.split(), quoted)
    assert events("what an oaf") == [("plain", 5.0)]
    assert events("he is not an oaf") == [("negated", 5.0)]
    assert events("they said that oaf") == [("reported", 5.0)]
    assert events("oaf", True) == [("reported", 5.0)]
    assert events("you oaf") == [("aimed", 5.0)]
    assert events("i will hurt you") == [("threat", 1.0)]
    assert events("nothing to see") == []


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    kinds = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r[0] for r in docs.select(toxicity.scores(F.col("text"), toxicity.train(docs, kinds))).collect()] == pytest.approx([0, 0], abs=1e-6)


def test_vector_links_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 24))
    group = base[0] + 0.12 * rng.standard_normal((90, 24))  # larger than a list
    step = [base[1]]
    for _ in range(30):  # a chain: neighbours link, ends don't
        step.append(step[-1] + 0.3 * rng.standard_normal(24))
    pairs = base[50:120] + 0.15 * rng.standard_normal((70, 24))
    good = np.concatenate([base, group, np.array(step), pairs, base[:3], 7 * base[4:6]]).astype(np.float32)
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(good)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [math.nan] + [1.0] * 23), (5004, [math.inf] * 24), (5005, [None] + [1.0] * 23), (5006, [1.0, 2.0]), (5006, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in vector_dedup.near_copies(frame).where("vec_id < 5000").collect()}
    wide = good.astype(float) / np.linalg.norm(good.astype(float), axis=1)[:, None]
    linked = wide @ wide.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.array([r[0] for r in rows])
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], 10**9).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {i: (int(n), int(c)) for (i, _), n, c in zip(rows, linked.sum(axis=1), root)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    odd = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_copies(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).collect())
    assert odd == [(i, 1 if i == 5006 else 0, i) for i, _ in bad]
    assert vector_dedup.near_copies(frame.where("false")).collect() == []
