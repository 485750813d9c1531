"""Rules on archive entries: unsafe paths, dangerous Office parts, bombs, nesting and what ends an archive.

The rule functions take columns, so the same rule serves a table of entries (one row per entry) and
the listing array that travels with a file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import latin1
from disarm.functions.names import base_name
from disarm.operators.findings import finding

# Entry numbers are 32-bit, so blocks of 2^16 entries leave at most 2^15 blocks per archive:
# neither the entries of one block nor the blocks of one archive can outgrow a task.
ENTRY_BLOCK = 1 << 16


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _cases(branches) -> Column:
    (first, value), *rest = branches
    return reduce(lambda c, b: c.when(b[0], b[1]), rest, F.when(first, value))


def path_finding(name: Column, office: bool = False) -> Column:
    """Finding struct for an unsafe entry path (first rule that hits), or null."""
    size = F.octet_length(name)
    branches = []
    for test, arg, in_office, kind, severity, text in rules.ENTRY_PATH_RULES:
        if office and not in_office:
            continue
        if test == "longer":
            hit, where, text = size > arg, F.lit("entry name"), F.format_string(text, size)
        else:
            hit, where = getattr(F, test)(name, F.lit(arg)), base_name(name)
        branches.append((hit, finding(kind, where, text, severity)))
    return _cases(branches)


def is_unsafe_path(name: Column, office: bool = False) -> Column:
    """Whether any path rule hits."""
    size = F.octet_length(name)
    return _any(
        size > arg if test == "longer" else getattr(F, test)(name, F.lit(arg))
        for test, arg, in_office, *_ in rules.ENTRY_PATH_RULES
        if in_office or not office
    )


def _part_tests(name: Column) -> list[Column]:
    whole = F.lower(name)
    base = base_name(whole)
    tests = []
    for on, prefix, suffixes, *_ in rules.OFFICE_PART_RULES:
        if on == "path":
            tests.append(_any(F.endswith(whole, F.lit(s)) for s in suffixes))
            continue
        if prefix == "=":
            hit = base == suffixes[0]
        else:
            hit = F.startswith(base, F.lit(prefix)) & _any(F.endswith(base, F.lit(s)) for s in suffixes)
        # a cheap test on the whole path first: few names get as far as their base
        tests.append(F.contains(whole, F.lit(suffixes[0] if prefix in ("", "=") else prefix)) & hit)
    return tests


def is_dangerous_part(name: Column) -> Column:
    """Whether any part rule hits."""
    return _any(_part_tests(name))


def part_finding(name: Column) -> Column:
    """Finding struct for a dangerous Office part name (first rule that hits), or null."""
    base = base_name(name)

    def described(text: str) -> Column:
        head, _, tail = text.partition("%s")
        return F.concat(F.lit(head), base, F.lit(tail)) if "%s" in text else F.lit(text)

    branches = [
        (hit, finding(kind, name, described(text), severity))
        for hit, (_, _, _, kind, severity, text) in zip(_part_tests(name), rules.OFFICE_PART_RULES)
    ]
    return _cases(branches)


def is_rels(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".rels"))


def is_external_rels(body: Column) -> Column:
    """A relationship part that is marked external and names a remote target."""
    text = F.lower(latin1(body))
    return F.contains(text, F.lit(rules.RELS_EXTERNAL_MARK)) & _any(
        F.contains(text, F.lit(t)) for t in rules.RELS_REMOTE_TARGETS
    )


def rels_finding(name: Column, body: Column) -> Column:
    text = F.concat(F.lit('relationship file "'), base_name(name), F.lit('" contains external references'))
    return F.when(is_rels(name) & is_external_rels(body), finding("external_ref", name, text, "medium"))


# --- operators on a table of entries -------------------------------------------------------------


def _once(name: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule on a name that is itself an expression: worked out once, not once for each use in the rule."""
    return F.get(F.transform(F.array(name), rule), F.lit(0))


def entry_path_safety(entries: DataFrame, office: bool = False) -> DataFrame:
    """Entries with an unsafe path, one finding each."""
    unsafe = entries.where(is_unsafe_path(F.col("name"), office))
    return unsafe.select("archive_id", "entry_idx", path_finding(F.col("name"), office).alias("f")).select(
        "archive_id", "entry_idx", "f.*"
    )


def entry_name_rules(entries: DataFrame) -> DataFrame:
    """Entries that are dangerous Office parts, one finding each."""
    found = entries.select("archive_id", "entry_idx", _once(F.col("name"), part_finding).alias("f"))
    return found.where("f IS NOT NULL").select("archive_id", "entry_idx", "f.*")


def rels_external_refs(parts: DataFrame) -> DataFrame:
    """Relationship parts ``(archive_id, entry_idx, name, content)`` that point outside."""
    return parts.select(
        "archive_id", "entry_idx", rels_finding(F.col("name"), F.col("content")).alias("f")
    ).where("f IS NOT NULL").select("archive_id", "entry_idx", "f.*")


def oversized_entries(entries: DataFrame) -> DataFrame:
    """Entries over the per-entry cap that no path rule has already dropped."""
    kept = entries.where(~is_unsafe_path(F.col("name")) & (F.col("size") > rules.MAX_ENTRY_BYTES))
    return kept.select(
        "archive_id", "entry_idx", F.lit("oversized_entry").alias("type"), base_name(F.col("name")).alias("location"),
        F.lit("medium").alias("severity"),
    )


def counted_size(office: bool = False) -> Column:
    """Bytes an entry adds to the decompressed total: nothing if it is dropped or oversized."""
    dropped = is_unsafe_path(F.col("name"), office)
    if office:
        dropped = dropped | _once(F.col("name"), is_dangerous_part)
    return F.when(~dropped & (F.col("size") <= rules.MAX_ENTRY_BYTES), F.col("size")).otherwise(0)


def running_totals(entries: DataFrame, office: bool = False) -> DataFrame:
    """Add ``counted`` and ``running``, the decompressed total of the archive up to each entry.

    Totals are taken per block of entries first; only the block sums are ordered per archive, and
    only the entries of one block are ordered together.
    """
    rows = entries.withColumn("counted", counted_size(office).cast("bigint")).withColumn(
        "_block", F.floor(F.col("entry_idx") / ENTRY_BLOCK)
    )
    order = W.partitionBy("archive_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        rows.groupBy("archive_id", "_block")
        .agg(F.sum("counted").alias("_sum"))
        .select("archive_id", "_block", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_before"))
    )
    within = W.partitionBy("archive_id", "_block").orderBy("entry_idx").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_within", F.sum("counted").over(within))
        .join(carried, ["archive_id", "_block"])
        .withColumn("running", F.col("_before") + F.col("_within"))
        .drop("_block", "_within", "_before")
    )


def zip_bomb(entries: DataFrame, office: bool = False) -> DataFrame:
    """Archives whose kept entries decompress to more than the cap, with the entry that crosses it."""
    crossing = running_totals(entries, office).where(F.col("running") > rules.MAX_ARCHIVE_BYTES)
    return crossing.groupBy("archive_id").agg(
        F.min("entry_idx").alias("entry_idx"), F.min("running").alias("total_at_entry")
    )


def archive_terminal(entries: DataFrame) -> DataFrame:
    """Outcome per archive, decided by the first terminal event in entry order.

    ``entries`` also has ``read_error BOOLEAN`` and ``member_status STRING``. A bomb or a blocked
    member blocks and keeps the findings up to it; an entry that cannot be read is an error without findings.
    """
    kept = ~F.col("dropped") & (F.col("size") <= rules.MAX_ENTRY_BYTES)
    event = (
        F.when(kept & F.col("read_error"), "read_error")
        .when(kept & (F.col("running") > rules.MAX_ARCHIVE_BYTES), "zip_bomb")
        .when(kept & (F.col("member_status") == "BLOCKED"), "nested_blocked")
    )
    # an entry that cannot be read adds nothing to the total
    readable = entries.withColumn("size", F.when(F.col("read_error"), 0).otherwise(F.col("size")))
    totals = running_totals(readable).withColumn("dropped", is_unsafe_path(F.col("name")))
    rows = totals.select(
        "archive_id", "entry_idx", event.alias("event"), "dropped",
        ((F.col("member_status") == "SANITIZED") & kept).alias("member_sanitized"),
    )
    first = rows.groupBy("archive_id").agg(
        F.min(F.when(F.col("event").isNotNull(), F.struct("entry_idx", "event"))).alias("t")
    )
    joined = rows.join(first, "archive_id")
    upto = F.col("t").isNull() | (F.col("entry_idx") <= F.col("t.entry_idx"))
    # a bomb adds a finding of its own
    found = F.when(upto, F.col("dropped").cast("bigint")).otherwise(0) + F.when(
        (F.col("t.event") == "zip_bomb") & (F.col("entry_idx") == F.col("t.entry_idx")), 1
    ).otherwise(0)
    folded = joined.groupBy("archive_id").agg(
        F.first("t").alias("t"), F.sum(found).alias("n"),
        F.coalesce(F.bool_or("member_sanitized"), F.lit(False)).alias("member_sanitized"),
    )
    event_of = F.col("t.event")
    return folded.select(
        "archive_id",
        F.when(event_of == "read_error", "ERROR")
        .when(event_of.isNotNull(), "BLOCKED")
        .when((F.col("n") > 0) | F.col("member_sanitized"), "SANITIZED")
        .otherwise("CLEAN")
        .alias("status"),
        F.col("t.entry_idx").alias("terminal_idx"),
        F.coalesce(event_of, F.lit("none")).alias("terminal_event"),
        F.when(event_of == "read_error", 0).otherwise(F.col("n")).cast("bigint").alias("n_findings"),
    )


def nested_findings(findings: DataFrame, members: DataFrame, levels: int = rules.MAX_ARCHIVE_DEPTH) -> DataFrame:
    """Carry findings up the entry tree, prefixing the location with each entry name on the way.

    ``findings`` is keyed by ``file_id``; ``members`` holds ``(child_id, parent_id, name)`` with one
    row per child. A finding ends at the topmost archive it belongs to.
    """
    up = members.select(F.col("child_id").alias("file_id"), "parent_id", "name")
    result = findings
    for _ in range(levels):
        result = result.join(up, "file_id", "left").select(
            F.coalesce("parent_id", "file_id").alias("file_id"),
            F.when(F.col("parent_id").isNotNull(), F.concat("name", F.lit("/"), "location"))
            .otherwise(F.col("location"))
            .alias("location"),
            *[c for c in findings.columns if c not in ("file_id", "location")],
        )
    return result.select(*findings.columns)
