import hashlib
import random
import re

from pyspark.sql import functions as F

from disarm.llm import chat, url_filter


def fitting(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = re.sub("[A-Z]", lambda m: m.group().lower(), rest[:cut]), rest[cut:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules_equal_plain_matching(spark):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "ab", "net", "com", "x-y", "é"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 5)))
    path = lambda: "".join(rng.choice(["/", "/a", "/ab/", "b"]) for _ in range(rng.randint(0, 3)))
    rules = [(host(), "/" + path().lstrip("/"), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host().upper() if rng.random() < 0.2 else host()}{path()}{rng.choice(['', '?q=://z/', '#f', '?'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/", "http://net", "http://NET/", "http://x\ny/a", urls[0], urls[0]]
    frame = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, key int").repartition(3)
    messy = rules + rules[:4] + [("", "/", "block"), (None, "/", "block"), ("net", None, "block")]
    got = url_filter.filter_urls(frame, spark.createDataFrame(messy, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: fitting(u, rules) for i, u in enumerate(urls)}
    none = url_filter.filter_urls(frame, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert len(none) == len(urls) and all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filter.filter_urls(frame.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_chats_come_back(spark):
    rng = random.Random(8)
    bits = ["\\", "</turn>", "###", "### User: ", " </turn>\n", "<\\/turn>", "é", "\n", "$1", ": ", "@", "", "\\\\", "</", "turn>"]
    talk = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = []
    for c in range(80):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "odd: </turn>", None, ""]) if c % 2 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, t if t != 5 else None, role, None if rng.random() < 0.1 else talk(), 5))
    rows += rows[:3]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    made = chat.format_conversations(turns).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for r in made.collect():
        asked = [w[2:] for w in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == asked
        assert r.loss == "".join(t for role, t in asked if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted and r.n_turns == len(asked)
        state, fault = "start", None
        for k, (role, _) in enumerate(asked):
            state = chat.Template().steps.get((state, role), "fault")
            fault = k if state == "fault" and fault is None else fault
        assert (r.valid, r.fault_turn, r.final_state) == (state == "assistant" and fault is None, fault, state)
    assert chat.format_conversations(turns.where("false")).collect() == []


def test_a_very_long_role(spark):
    role = "r:\\</turn>###" * 80_000  # a megabyte
    turns = spark.createDataFrame([(1, 0, role, "hi"), (1, 1, "x" * 1_000_000, "")], "conv_id long, turn long, role string, text string")
    back = chat.format_conversations(turns).select(chat.parse(F.col("formatted")).alias("turns")).first().turns
    assert [(t.role, t.text) for t in back] == [(role, "hi"), ("x" * 1_000_000, "")]


def test_digest_of_the_probe(spark):
    text = "\\### Assistant: </turn> ok"
    turns = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).select(F.sha2(chat.loss_text(F.col("segments")), 256).alias("d"), "valid").first()
    assert row.d == hashlib.sha256(text.encode()).hexdigest() and row.valid
