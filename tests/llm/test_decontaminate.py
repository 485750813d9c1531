import hashlib
import random
import re

from disarm.llm.decontaminate import contamination


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        named = sorted(str(i) for i in named if i is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_equals_plain_search(spark):
    rng = random.Random(4)
    few = ["the", "of", "and", "Straße", "naïve", "x1"]
    item = lambda n: " ".join(rng.choice(few) if rng.random() < 0.5 else f"r{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 3, 5, 12, 13, 14, 40]))) for i in range(25)] + [(100, None), (101, "--"), (102, ""), (None, item(20)), (7, item(20))]
    items += [(i + 200, t) for i, t in items[:5]]
    docs = []
    for d in range(120):
        text = item(rng.randint(0, 60))
        if d % 3 == 0:
            planted = rng.choice(items)[1] or ""
            text += " -- " + (planted if d % 2 else " ".join(words(planted)[:rng.randint(1, 14)])).upper() + "! " + item(rng.randint(0, 200))
        docs.append((d, text))
    docs += [(500, None), (500, ""), (501, docs[3][1]), (501, docs[3][1]), (None, docs[6][1])]
    frame = spark.createDataFrame([(d, t, "k", 3) for d, t in docs], "doc_id long, text string, key string, n_words int").repartition(4)
    got = contamination(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=repr) == plain(docs, items)
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    row = contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert contamination(docs.where("false"), items).collect() == []
