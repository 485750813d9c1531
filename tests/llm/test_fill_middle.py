import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from disarm.llm.fill_middle import fill_in_middle, restore


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(13)
    bits = ["a", "Zz", "xyz", "é", "漢", "😀", " ", "\n", "@", "[", "`", "{", "0", "\x00", "\x7f", "<", "<P", "S>", "<M", "́", "ﬀ", "<S>"]
    made = [(i, "".join(rng.choice(bits[:-1] if rng.random() < 0.95 else bits) for _ in range(rng.randint(0, 60))), "x") for i in range(700)]
    made += [(701, None, "x"), (702, "", "x"), (None, "with no id é", "x"), (703, "abc" * 400_000, "x"), (704, "é1" * 900_000, "x"), (705, "😀", "x")]
    return made + [made[5], made[5]] + [(800 + i, "w" * i, "x") for i in range(20)]


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_plain_version(spark, parts):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, output string").repartition(parts)
    made = fill_in_middle(docs).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted((plain(d, t) for d, t, _ in rows()), key=repr)
    texts = {d: t or "" for d, t, _ in rows()}
    assert all(r.back == texts[r.doc_id] for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("a-1", "one two", 1)], "key string, body string, n int")
    row = fill_in_middle(docs, "key", "body", plain_from=101, suffix_first_below=100).first()
    assert row.key == "a-1" and row.form == "spm" and row.n == 3
    assert fill_in_middle(docs, "key", "body", plain_from=0).first().form == "plain"
    assert fill_in_middle(docs.where("false"), "key", "body").collect() == []
