"""The operators applied to whole tables, as registered queries, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disarm.llm import chat, decontaminate, fill_middle, jaccard_join, licenses, packing, page_text, token_counts, toxicity, turn_repair, url_filter, vector_dedup, warc

OP2_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common, any_value(x.n + y.n) AS total
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (total - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN roots USING (doc_id)
"""

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_index(warc.write_archives(pages))
    return warc.read_records(warc.wanted_pages(pages), index, payloads=False).drop("payload")


OP3_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM sized)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS verified
FROM firsts
"""


#: Personal data and keys that are redacted: addresses, numbers of several groups, long runs of hexadecimal digits.
#: Matches start where a run of their characters does, so that long runs without one take no longer than they are.
REDACTED = (
    r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++"
    r"|(?<!\d)(?<!\d[ ().-])(?<!\d[().-] )\+?\d[\d().-]*(?: [\d().-]+)*\d{3}|[0-9a-f]{24,}")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data are redacted."""
    docs = token_counts.with_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("edits", token_counts.redactions(F.col("text"), REDACTED, "[redacted]")).withColumn("tokens_before", F.get("tree.tokens", F.lit(1)))
    edited = token_counts.apply_edits(docs.withColumn("n_edits", F.size("edits")))
    return edited.select("doc_id", "n_edits", "tokens_before", F.col("n_tokens").alias("tokens_after"), "encoded_chars", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text", "hits")


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN windows USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    # the digest stands for the ids, which needn't travel further
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, ["doc_id", "piece", "start"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.scores(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
won AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN won USING (page_id)
"""

PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    made = chat.format_conversations(turns.unionByName(probe))
    back = made.withColumn("_turns", chat.parse(F.col("formatted"))).withColumn("_loss", chat.loss_text(F.col("segments")))
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###')) + 9
    + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
      ELSE 7 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###'), ':', '\:')) END AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL AND after IS NOT NULL WHEN 'user' THEN (before IS NULL OR before IN ('system', 'assistant')) AND after IS NOT NULL
    WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE false END) AS valid
FROM sized GROUP BY conv_id
"""


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_copies(table(spark, sf_dir, "embeddings"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by a checksum of their key; dropped ones stay as rows that are not ``present``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select(
        "conv_id", "turn", F.when(drawn == 4, "user").otherwise(role).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (drawn != 0).alias("present"), F.array_repeat(F.lit(0), F.when(drawn == 3, 2).otherwise(1)).alias("_times"))
    return rows.withColumn("_times", F.explode("_times")).drop("_times")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.conversation_report(turn_repair.repair_turns(turns, present="present"))


def _op12_sql() -> str:
    poly = 3988292384  # the reversed polynomial of crc32
    bit = f"list_reduce(list_concat([xor(c, b)], [1, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: xor(x // 2, {poly} * (x % 2)))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda h: ascii(h)::BIGINT)), lambda c, b: {bit}), 4294967295)"
    put = lambda s, cost, letters, line: (
        f"{{'c': {s}.c + {cost}, 'a': {s}.a || {letters}, 't': {s}.t || CASE WHEN {s}.t = '' THEN '' ELSE chr(10) END || {line}}}")
    here = lambda initial, role: (f"CASE WHEN i0 = '{initial}' THEN 0 ELSE 1 END + tr", f"CASE WHEN i0 = '{initial}' THEN 'K' ELSE 'R' END", f"CASE WHEN i0 = '{initial}' THEN role ELSE '{role}' END || ':' || text")

    def stay(s: str, initial: str, role: str, before: str = "") -> str:
        cost, letter, line = here(initial, role)
        if before:
            return put(s, f"5 + {cost}", f"'I' || {letter}", f"'{before}:' || chr(10) || {line}")
        return put(s, cost, letter, line)

    gone = lambda s: f"{{'c': {s}.c + 2, 'a': {s}.a || 'D', 't': {s}.t}}"
    never = "{'c': 1000000000000::BIGINT, 'a': '', 't': ''}"
    pick = lambda drop, *kept: f"list_min(CASE WHEN must THEN [{drop}] ELSE [{', '.join([drop, *kept])}] END)"
    system = "{'c': e.c + tr, 'a': e.a || 'K', 't': role || ':' || text}"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT *, {crc} % 20 AS f FROM keyed),
rows_after AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, LATERAL (SELECT unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE f <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS i0,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM rows_after),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM numbered),
judged AS (
  SELECT *, said = '' OR copy > 1 AS must, said = '' AS blank, said <> '' AND copy > 1 AS again, said <> '' AND copy = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS cut,
    CASE WHEN said <> '' AND copy = 1 AND right(said, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS tr,
    lag(i0) OVER (PARTITION BY conv_id ORDER BY i) || i0 AS pair FROM counted),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, {never} AS s, {never} AS u, {never} AS a FROM conversations
  UNION ALL
  SELECT conv_id, n + 1, {gone('e')},
    CASE WHEN i0 = 's' AND NOT must THEN {pick(gone('s'), system)} ELSE {gone('s')} END,
    {pick(gone('u'), stay('e', 'u', 'user'), stay('s', 'u', 'user'), stay('a', 'u', 'user'), stay('u', 'u', 'user', 'assistant'))},
    {pick(gone('a'), stay('u', 'a', 'assistant'), stay('e', 'a', 'assistant', 'user'), stay('s', 'a', 'assistant', 'user'), stay('a', 'a', 'assistant', 'user'))}
  FROM walk JOIN judged USING (conv_id) WHERE i = n + 1),
ends AS (
  SELECT conv_id, list_min([e, a, {put('u', 5, "'I'", "'assistant:'")}, {put('s', 10, "'II'", "'user:' || chr(10) || 'assistant:'")}]) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS last FROM walk) WHERE last = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id)
"""


OP12_SQL = _op12_sql()


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || d[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || d[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || d[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', s, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_page_text": op11_page_text,
    "op12_turn_repair": op12_turn_repair,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op3_warc": OP3_SQL, "op5_decontaminate": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_chat_format": OP9_SQL,
    "op12_turn_repair": OP12_SQL, "op13_fill_middle": OP13_SQL}
