"""The whole inspection: detect, route by type, recurse into archives, one outcome row per file."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disarm import rules
from disarm.functions.content import apply_spans
from disarm.functions.names import base_name
from disarm.functions.segments import image_segments
from disarm.functions.zips import read_members, zip_rebuild
from disarm.operators import image, pdf
from disarm.operators.archive import path_finding
from disarm.operators.detect import (
    detect_type, extension_type, looks_like_markup, magic_type, may_be_container, type_of, with_listing,
)
from disarm.operators.findings import finding, no_findings
from disarm.operators.markup import inspect_markup
from disarm.operators.office import inspect_office
from disarm.staging import bound_batches, stage

OUTCOME = ("file_id", "original_type", "status", "original_size", "findings", "error_message", "output")
Inspector = Callable[[DataFrame], DataFrame]


class Registry:
    """Which inspector handles which type; the last registration of a type wins.

    An inspector takes ``(file_id, filename, content, original_type)`` and returns ``file_id, status,
    findings, error_message, output``.
    """

    def __init__(self) -> None:
        self._by_type: dict[str, Inspector] = {}

    def register(self, types: list[str], inspector: Inspector) -> None:
        for name in types:
            self._by_type[name] = inspector

    def items(self) -> list[tuple[Inspector, list[str]]]:
        grouped: dict[Inspector, list[str]] = {}
        for name, inspector in self._by_type.items():
            grouped.setdefault(inspector, []).append(name)
        return list(grouped.items())

    def types(self) -> list[str]:
        return sorted(self._by_type)


def _size() -> Column:
    return F.octet_length("content").cast("bigint")


def _inspect_single(files: DataFrame, kinds: set[str], enabled: set[str]) -> DataFrame:
    """Files decided inside their own row: PDF, images, damaged files of any type, and types without an inspector.

    ``kinds`` are the types that can occur; expressions for others are left out. Nothing is shuffled.
    """
    content, kind = F.col("content"), F.col("original_type")
    size = F.octet_length(content)
    images = [t for t in rules.IMAGE_TYPES if t in kinds & enabled]
    errors: list[tuple[Column, Column]] = []
    found: list[tuple[Column, Column]] = []
    cleaned: list[tuple[Column, Column]] = []
    rows = files
    if images:
        is_image = kind.isin(*images)
        rows = rows.withColumn("_segments", image_segments(F.when(is_image, content), kind))
        rows = rows.withColumns(
            {
                "_size": image.dimensions(content, kind, F.col("_segments")),
                "_whole": F.coalesce(image.is_whole(kind, F.col("_segments")), F.lit(False)),
                "_ruled": image.with_rules(content, kind, F.col("_segments")),
                "_blocks": F.when(kind == "gif", image.gif_hits("content")),
            }
        )
        pixels = F.col("_size.width") * F.col("_size.height")
        broken = (size > rules.MAX_FILE_BYTES) | F.col("_size").isNull() | ~F.col("_whole")
        image_error = (
            F.when(size == 0, "empty file")
            .when(broken, F.concat(F.lit("decoding "), kind, F.lit(" image: malformed data")))
            .when(
                pixels > rules.MAX_PIXELS,
                F.format_string(f"decoded image exceeds pixel limit (%d pixels, max {rules.MAX_PIXELS})", pixels),
            )
        )
        errors.append((is_image, image_error))
        found.append((is_image, image.segment_findings(content, kind, F.col("_ruled"), F.col("_blocks"))))
        cleaned.append((is_image, image.strip_segments(content, F.col("_ruled"))))
    if "pdf" in kinds & enabled:
        rows = rows.withColumn("_hits", F.when(kind == "pdf", pdf.name_hits("content")))
        rows = rows.withColumn("_masks", pdf.mask_spans(F.col("_hits")))
        errors.append((kind == "pdf", pdf.error_of(content)))
        found.append((kind == "pdf", pdf.findings_of(F.col("_hits"))))
        cleaned.append((kind == "pdf", apply_spans(content, F.col("_masks"))))
    # markup and containers get here only when their bytes are not what they should be
    if "svg" in kinds & enabled:
        markup_error = (
            F.when(size == 0, "svg: empty file")
            .when(size > rules.MAX_FILE_BYTES, F.format_string("svg: file exceeds maximum size (%d bytes)", size))
            .otherwise("svg: input does not appear to be SVG/XML")
        )
        errors.append((kind == "svg", markup_error))
    if "zip" in kinds & enabled:
        empty = F.when(size == 0, "archive sanitize: empty input")
        errors.append((kind == "zip", empty.otherwise("archive sanitize: invalid zip")))
    if office := [t for t in rules.OFFICE_TYPES if t in kinds & enabled]:
        errors.append((kind.isin(*office), F.lit("office sanitize: invalid zip")))

    rows = rows.withColumns({"error_message": _first(errors, F.lit(None).cast("string")), "_found": _first(found, no_findings())})
    rows = rows.withColumn(
        "findings", F.coalesce(F.when(F.col("error_message").isNull(), F.col("_found")), no_findings())
    )
    status = (
        F.when(F.col("error_message").isNotNull(), "ERROR")
        .when(~kind.isin(*enabled), "UNSUPPORTED")
        .when(F.size("findings") > 0, "SANITIZED")
        .otherwise("CLEAN")
    )
    rows = rows.withColumn("status", status)
    output = F.when(F.col("status").isin("CLEAN", "UNSUPPORTED"), content).when(
        F.col("status") == "SANITIZED", _first(cleaned, F.lit(None).cast("binary"))
    )
    return rows.withColumn("output", output)


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    if not cases:
        return default
    (test, value), *rest = cases
    return reduce(lambda chain, case: chain.when(case[0], case[1]), rest, F.when(test, value)).otherwise(default)


def inspect_files(
    files: DataFrame,
    registry: Registry | None = None,
    types: Sequence[str] = rules.FILE_TYPES,
    report_oversized: bool = True,
) -> DataFrame:
    """``(file_id, filename, content)`` → one outcome row per file.

    ``file_id`` is unique. ``types`` are the types inspected; any other type is UNSUPPORTED and passes
    through. Types in ``registry`` go to its inspectors instead of the built-in ones.
    Oversized archive entries are dropped; ``report_oversized=False`` does so without a finding.
    """
    bound_batches(files.sparkSession)
    rows = files.where("content IS NOT NULL").select("file_id", "filename", "content")
    content, name = F.col("content"), F.col("filename")
    container = may_be_container(content, name)
    plain = rows.where(~container).withColumn("original_type", F.coalesce(magic_type(content), extension_type(name)))
    # containers are needed several times (listing, entries, rebuilding): read and listed once, then staged
    listed = with_listing(rows.where(container)).withColumn("original_type", type_of(content, name, F.col("listing")))
    packed = stage(listed, "containers")
    run = _Run(registry or Registry(), set(types), report_oversized)
    outcome = _inspect(plain, packed, {*rules.FILE_TYPES, "unknown"}, 0, run)
    return outcome.unionByName(_unread(files))


def _unread(files: DataFrame) -> DataFrame:
    """Files without content, as those over the size cap are: an error each, with the reason if there is one."""
    given = set(files.columns)
    size = F.col("content_length") if "content_length" in given else F.lit(None)
    reason = F.col("reject_reason") if "reject_reason" in given else F.lit(None).cast("string")
    return files.where("content IS NULL").select(
        "file_id", F.lit("unknown").alias("original_type"), F.lit("ERROR").alias("status"), size.cast("bigint").alias("original_size"),
        no_findings().alias("findings"), F.coalesce(reason, F.lit("no content")).alias("error_message"), F.lit(None).cast("binary").alias("output"))


def _occurring(typed: DataFrame) -> dict[str, bool]:
    """Types that occur in a staged table, and whether any file of the type has no listing (one small row per type)."""
    rows = typed.groupBy("original_type").agg(F.bool_or(F.col("listing").isNull()).alias("unlisted")).collect()
    return {r.original_type: r.unlisted for r in rows}


@dataclass(frozen=True)
class _Run:
    registry: Registry
    enabled: set[str]
    report_oversized: bool


def _inspect(plain: DataFrame, packed: DataFrame, occurring: set[str], depth: int, run: _Run) -> DataFrame:
    """Route typed files. ``packed`` holds the ZIP containers, with their ``listing``; ``plain`` the rest.

    Branches for types that do not occur are left out; ``occurring`` are the types ``plain`` may hold.
    """
    kind = F.col("original_type")
    custom = set(run.registry.types())
    mine = occurring - custom
    held = {t: unlisted for t, unlisted in _occurring(packed).items() if t not in custom}
    opens = {t for t in held if t in run.enabled and t in ("zip", *rules.OFFICE_TYPES)}
    too_deep = depth >= rules.MAX_ARCHIVE_DEPTH

    parts: list[DataFrame] = []
    single = plain.where(kind.isin(*mine))
    if "svg" in mine & run.enabled:
        # SVG with a plausible start goes to the tokenizer; the rest of it fails in its own row
        to_tokens = (kind == "svg") & looks_like_markup(F.col("content")) & (_size() <= rules.MAX_FILE_BYTES)
        documents = _dealt(single.where(to_tokens).select("file_id", "content"))
        parts.append(inspect_markup(documents).withColumn("original_type", F.lit("svg")).select(*OUTCOME))
        single = single.where(~to_tokens)
    unopened = [t for t, unlisted in held.items() if t not in opens or (unlisted and not (t == "zip" and too_deep))]
    if unopened:
        left = packed.where(kind.isin(*unopened) & (F.col("listing").isNull() | ~kind.isin(*opens)))
        single = single.unionByName(left.drop("listing"))
    kinds = mine | set(unopened)
    images = sorted(kinds & run.enabled & set(rules.IMAGE_TYPES))
    # image walks run in Python, and Spark keeps the rows that wait for it: others don't go that way
    for some, theirs in ((set(images), kind.isin(*images)), (kinds - set(images), ~kind.isin(*images))):
        if some:
            parts.append(_inspect_single(single.where(theirs).withColumn("original_size", _size()), some, run.enabled).select(*OUTCOME))
    opened = packed.where(F.col("listing").isNotNull())
    if office_types := sorted(opens - {"zip"}):
        office = opened.where(kind.isin(*office_types)).withColumn("original_size", _size())
        parts.append(inspect_office(office).select(*OUTCOME))
    if "zip" in opens:
        if too_deep:
            parts.append(_too_deep(packed.where(kind == "zip"), depth))
        else:
            parts.append(_inspect_archives(opened.where(kind == "zip"), depth, run))
    typed = plain.unionByName(packed.drop("listing"))
    for inspector, names in run.registry.items():
        theirs = typed.where(kind.isin(*names))
        done = inspector(theirs).select("file_id", "status", "findings", "error_message", "output")
        # a file that the inspector says nothing about is an error, not a loss
        told = theirs.select("file_id", "original_type", _size().alias("original_size")).join(done.withColumn("told", F.lit(True)), "file_id", "left")
        silent = F.col("told").isNull()
        parts.append(told.withColumns({
            "status": F.when(silent, "ERROR").otherwise(F.col("status")), "findings": F.coalesce("findings", no_findings()),
            "error_message": F.when(silent, "inspector gave no result").otherwise(F.col("error_message")),
        }).select(*OUTCOME))
    return reduce(DataFrame.unionByName, parts)


def _dealt(documents: DataFrame) -> DataFrame:
    """Documents spread over all tasks. Markup takes time by the tag and packs well, so that one file split can hold most of it."""
    return documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")


def _too_deep(archives: DataFrame, depth: int) -> DataFrame:
    """An archive at the depth cap is blocked unopened, whatever its bytes are."""
    bomb = finding(
        "zip_bomb", base_name(F.col("filename")),
        f"archive nesting depth {depth} exceeds maximum of {rules.MAX_ARCHIVE_DEPTH}", "critical",
    )
    return archives.select(
        "file_id", "original_type", F.lit("BLOCKED").alias("status"), _size().alias("original_size"),
        F.array(bomb).alias("findings"), F.lit(f"archive sanitize: nesting too deep ({depth} levels)").alias("error_message"),
        F.lit(None).cast("binary").alias("output"),
    )


def _inspect_archives(archives: DataFrame, depth: int, run: _Run) -> DataFrame:
    """Archives → outcomes. Members are expanded once, into a staged table, and inspected like any file.

    Everything grouped per archive is bounded by the archive cap.
    """
    # name rules on the listing; only entries that survive them are read
    named = F.transform(
        "listing",
        lambda e: F.struct(
            e["entry_idx"].alias("entry_idx"), e["name"].alias("name"), e["declared_size"].alias("declared_size"),
            path_finding(e["name"]).alias("f"),
        ),
    )
    opened = archives.withColumn("_named", named)
    wanted = F.transform(
        F.filter("_named", lambda e: e["f"].isNull() & (e["declared_size"] <= rules.MAX_ENTRY_BYTES)),
        lambda e: e["entry_idx"],
    )
    opened = opened.withColumn("_wanted", wanted)
    members = stage(detect_type(_read_members(opened)), f"members{depth}")
    types = {r[0] for r in members.where("readable").select("original_type").distinct().collect()}
    outcomes = None
    if types:
        typed = members.where("readable").select("file_id", "filename", "content", "original_type", "listing")
        container = may_be_container(F.col("content"), F.col("filename"))
        inner = _inspect(
            typed.where(~container).drop("listing"), typed.where(container), types, depth + 1, run
        )
        outcomes = stage(
            inner.select(
                "file_id", F.col("status").alias("m_status"), F.col("findings").alias("m_findings"),
                F.when(F.col("status") == "SANITIZED", F.col("output")).alias("m_output"),
            ),
            f"outcomes{depth}",
        )
    return _fold_members(opened, members, outcomes, run.report_oversized)


def _read_members(opened: DataFrame) -> DataFrame:
    names = F.transform("listing", lambda e: e["name"])
    owner = F.struct(F.col("file_id").alias("id"), names.alias("names"))
    body = opened.select(owner.alias("file_id"), F.col("content").alias("body"), F.col("_wanted").alias("wanted"))
    return read_members(body).select(
        F.concat(F.col("file_id.id").cast("string"), F.lit("/"), F.col("entry_idx")).alias("file_id"),
        F.col("file_id.id").alias("archive_id"), "entry_idx",
        F.get("file_id.names", F.col("entry_idx")).alias("filename"), "size", "content", "error",
        F.col("content").isNotNull().alias("readable"),
    )


def _fold_members(opened: DataFrame, members: DataFrame, outcomes: DataFrame | None, report_oversized: bool) -> DataFrame:
    """Per archive: first terminal event, findings in entry order, and the rebuilt container."""
    rows = members.select("file_id", "archive_id", "entry_idx", "filename", "size", "error")
    if outcomes is None:
        rows = rows.select(
            "*", F.lit(None).cast("string").alias("m_status"), no_findings().alias("m_findings"),
            F.lit(None).cast("binary").alias("m_output"),
        )
    else:
        rows = rows.join(outcomes, "file_id", "left")
    member = F.struct(
        "entry_idx", "size", "error", "m_status",
        F.transform(
            "m_findings",
            lambda f: finding(
                f["type"], F.concat("filename", F.lit("/"), f["location"]), f["description"], f["severity"]
            ),
        ).alias("found"),
        "m_output",
    )
    grouped = rows.groupBy("archive_id").agg(F.array_sort(F.collect_list(member)).alias("_members"))
    joined = opened.join(grouped.withColumnRenamed("archive_id", "file_id"), "file_id", "left").withColumn(
        "_members", F.coalesce("_members", F.array().cast(grouped.schema["_members"].dataType))
    )
    total = F.aggregate(
        "_members", F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.when(m["size"] <= rules.MAX_ENTRY_BYTES, m["size"]).otherwise(0),
    )
    # reading stops at the entry that crosses the cap, so that is the last one read
    bomb_idx = F.when(total > rules.MAX_ARCHIVE_BYTES, F.element_at("_members", -1)["entry_idx"])
    joined = joined.withColumn("_bomb", bomb_idx)

    def event(m: Column) -> Column:
        return (
            F.when(m["error"].isNotNull(), "read_error")
            .when(m["entry_idx"] == F.col("_bomb"), "zip_bomb")
            .when(m["m_status"] == "BLOCKED", "nested_blocked")
        )

    ends = F.filter(
        F.transform("_members", lambda m: F.struct(m["entry_idx"].alias("i"), event(m).alias("e"))),
        lambda x: x["e"].isNotNull(),
    )
    joined = joined.withColumn("_end", F.get(ends, F.lit(0)))
    upto = lambda i: F.col("_end").isNull() | (i <= F.col("_end.i"))
    name_of = lambda i: F.get(F.col("listing"), i)["name"]
    oversized = lambda i: finding(
        "oversized_entry", base_name(name_of(i)), "Entry skipped: exceeds size limit", "medium"
    )
    bomb = finding(
        "zip_bomb", base_name(F.col("filename")),
        f"total decompressed size exceeds {rules.MAX_ARCHIVE_BYTES} bytes", "critical",
    )
    slot = lambda i, fs: F.struct(i.alias("i"), fs.alias("fs"))
    by_name = F.transform(
        F.filter("_named", lambda e: e["f"].isNotNull() | (F.lit(report_oversized) & (e["declared_size"] > rules.MAX_ENTRY_BYTES))),
        lambda e: slot(e["entry_idx"], F.array(F.coalesce(e["f"], oversized(e["entry_idx"])))),
    )
    by_member = F.transform(
        "_members",
        lambda m: slot(
            m["entry_idx"],
            F.when(m["entry_idx"] == F.col("_bomb"), F.array(bomb))
            .when((m["size"] > rules.MAX_ENTRY_BYTES) & F.lit(report_oversized), F.array(oversized(m["entry_idx"])))
            .otherwise(F.coalesce(m["found"], no_findings())),
        ),
    )
    slots = F.array_sort(F.filter(F.concat(by_name, by_member), lambda s: upto(s["i"])))
    found = F.flatten(F.transform(slots, lambda s: s["fs"]))
    dropped = F.concat(
        F.transform(
            F.filter("_named", lambda e: e["f"].isNotNull() | (e["declared_size"] > rules.MAX_ENTRY_BYTES)),
            lambda e: e["entry_idx"],
        ),
        F.transform(F.filter("_members", lambda m: m["size"] > rules.MAX_ENTRY_BYTES), lambda m: m["entry_idx"]),
    )
    replaced = F.filter("_members", lambda m: (m["m_status"] == "SANITIZED") & m["m_output"].isNotNull())
    status = (
        F.when(F.col("_end.e") == "read_error", "ERROR")
        .when(F.col("_end").isNotNull(), "BLOCKED")
        .when((F.size("_found") > 0) | (F.size("_replaced") > 0), "SANITIZED")
        .otherwise("CLEAN")
    )
    joined = (
        joined.withColumn("_found", found).withColumn("_dropped", dropped).withColumn("_replaced", replaced)
        .withColumn("status", status)
    )
    rebuilt = zip_rebuild(
        F.when(F.col("status") == "SANITIZED", F.col("content")),
        F.col("_dropped"),
        F.transform("_replaced", lambda m: m["entry_idx"]),
        F.transform("_replaced", lambda m: m["m_output"]),
    )
    entry_name = base_name(name_of(F.col("_end.i")))
    message = (
        F.when(F.col("status") == "ERROR", F.concat(F.lit('archive sanitize: reading entry "'), entry_name, F.lit('"')))
        .when(F.col("_end.e") == "zip_bomb", f"archive sanitize: total decompressed size exceeds {rules.MAX_ARCHIVE_BYTES} bytes")
        .when(F.col("status") == "BLOCKED", F.concat(F.lit('archive sanitize: nested entry "'), entry_name, F.lit('" blocked')))
    )
    return joined.select(
        "file_id", F.lit("zip").alias("original_type"), "status", _size().alias("original_size"),
        F.when(F.col("status") == "ERROR", no_findings()).otherwise(F.col("_found")).alias("findings"),
        message.alias("error_message"),
        F.when(F.col("status") == "CLEAN", F.col("content")).otherwise(rebuilt).alias("output"),
    )
