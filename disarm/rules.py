"""Rule sets and limits, as plain data.

Everything in this module is a fixed value: names, severities, patterns and
message texts that have to be exactly these for the results to be right.
Operators turn them into Catalyst expressions or small rule tables.
"""

from __future__ import annotations

MIB = 1024 * 1024

# --- Limits (fixed values) ---------------------------------------------------
MAX_FILE_BYTES = 50 * MIB
MAX_ENTRY_BYTES = 50 * MIB
MAX_ARCHIVE_BYTES = 100 * MIB
MAX_ARCHIVE_DEPTH = 3
MAX_ENTRY_NAME = 4096
MAX_PIXELS = 100_000_000
MAX_TOKENS = 1_000_000
SNIFF_BYTES = 512
CHUNK_BYTES = 64 * 1024
MAX_TAGS = 16
MAX_TAG_KEY = 64
MAX_TAG_VALUE = 256

# --- Closed vocabularies (fixed values) --------------------------------------
FILE_TYPES = ("pdf", "docx", "xlsx", "pptx", "jpeg", "png", "gif", "svg", "zip")
OFFICE_TYPES = ("docx", "xlsx", "pptx")
IMAGE_TYPES = ("jpeg", "png", "gif")
STATUSES = ("CLEAN", "SANITIZED", "BLOCKED", "ERROR", "UNSUPPORTED")
MODES = ("ENFORCE", "REPORT_ONLY", "BYPASS_WITH_REPORT")
REPORT_MODES = ("REPORT_ONLY", "BYPASS_WITH_REPORT")
SEVERITIES = ("low", "medium", "high", "critical")
METRIC_TAGS = ("direction", "dest_category")

EXTENSION_TYPES = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "jpg": "jpeg",
    "jpeg": "jpeg", "png": "png", "gif": "gif", "svg": "svg", "zip": "zip",
}
OOXML_PREFIXES = (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))

# --- PDF names: name, finding type, severity, description (fixed values) ------
PDF_NAMES = (
    ("/JavaScript", "javascript", "critical", "JavaScript action type neutralized"),
    ("/JS", "javascript", "critical", "JavaScript reference neutralized"),
    ("/Launch", "launch_action", "critical", "Launch action neutralized"),
    ("/EmbeddedFile", "embedded_file", "high", "Embedded file reference neutralized"),
    ("/SubmitForm", "form_submit", "high", "Form submit action neutralized"),
    ("/OpenAction", "auto_action", "high", "Auto-open action neutralized"),
    ("/XFA", "xfa", "high", "XFA form reference neutralized"),
    ("/RichMedia", "rich_media", "high", "RichMedia content (Flash) neutralized"),
    ("/GoToR", "remote_goto", "high", "Remote file reference neutralized"),
    ("/GoToE", "embedded_goto", "high", "Embedded file goto neutralized"),
    ("/Movie", "movie_action", "medium", "Movie action neutralized"),
    ("/Sound", "sound_action", "medium", "Sound action neutralized"),
    ("/ImportData", "import_data", "high", "Data import action neutralized"),
    ("/Rendition", "rendition", "medium", "Rendition action neutralized"),
)
PDF_AA = ("/AA", "auto_action", "high", "Additional Actions dictionary neutralized")

# --- Archive entry paths (fixed values): ordered, first hit wins --------------
# test, argument, office too, finding type, severity, description
ENTRY_PATH_RULES = (
    ("contains", "..", True, "path_traversal", "critical", "ZIP entry contains path traversal sequence"),
    ("longer", MAX_ENTRY_NAME, True, "oversized_path", "medium", "ZIP entry name exceeds maximum length (%d chars)"),
    ("startswith", "/", False, "path_traversal", "critical", "ZIP entry contains absolute path"),
    ("startswith", "\\", False, "path_traversal", "critical", "ZIP entry contains Windows absolute path"),
    ("contains", "\0", False, "path_traversal", "critical", "ZIP entry name contains null byte"),
)

# --- Office part names (fixed values): ordered, first hit wins ----------------
# on ("base" name or full "path", both lower-cased), prefix, suffixes, type, severity, description (%s = base name)
OFFICE_PART_RULES = (
    ("base", "=", ("vbaproject.bin",), "macro", "critical", "VBA macro code (vbaProject.bin)"),
    ("base", "", (".vba",), "macro", "critical", "VBA source file (%s)"),
    ("path", "", (".vbs",), "vbscript", "critical", "Visual Basic Script file (%s)"),
    ("path", "", (".vbe",), "vbscript", "critical", "Encoded VBScript file (%s)"),
    ("path", "", (".wsf",), "script", "critical", "Windows Script File (%s)"),
    ("base", "oleobject", (".bin",), "ole_object", "high", "OLE embedded object (%s)"),
    ("base", "activex", (".xml", ".bin"), "activex", "high", "ActiveX control (%s)"),
    ("base", "=", ("connections.xml",), "external_ref", "medium", "external data connections file"),
)
RELS_EXTERNAL_MARK = 'targetmode="external"'
RELS_REMOTE_TARGETS = ('target="http://', 'target="https://', 'target="ftp://')

# --- PNG chunks that change how the pixels look (fixed values) -----------------
PNG_SHOWN = ("tRNS", "gAMA", "cHRM", "sRGB", "sBIT", "bKGD", "hIST", "pHYs", "sPLT")

# --- PNG chunks (fixed values): name, type, severity, description -------------
PNG_CHUNKS = (
    ("tEXt", "text_metadata", "low", "tEXt text metadata chunk stripped"),
    ("zTXt", "text_metadata", "low", "zTXt text metadata chunk stripped"),
    ("iTXt", "text_metadata", "low", "iTXt text metadata chunk stripped"),
    ("eXIf", "exif", "medium", "EXIF metadata stripped from PNG"),
    ("iCCP", "icc_profile", "low", "ICC color profile stripped (can contain embedded payloads)"),
    ("tIME", "timestamp", "low", "Modification timestamp stripped"),
)
XMP_NAMESPACE = "http://ns.adobe.com/xap/"

# --- Markup (fixed values) ----------------------------------------------------
MARKUP_ELEMENTS = (
    ("script", "script", "critical"),
    ("foreignobject", "foreign_object", "high"),
    ("iframe", "iframe", "high"),
    ("embed", "embed", "high"),
    ("object", "object", "high"),
)
CSS_PATTERNS = (
    ("expression(", "css_expression", "high"),
    ("url(javascript:", "javascript_uri", "critical"),
    ("-moz-binding", "css_binding", "high"),
)
URI_ATTRIBUTES = ("href", "xlink:href", "src", "data", "action", "formaction", "poster", "background")
LINK_ATTRIBUTES = ("href", "xlink:href")
STYLE_PATTERNS = ("expression(", "javascript:", "-moz-binding", "behavior:")
XML_VOID_ELEMENTS = (
    "area", "base", "basefont", "br", "col", "frame", "hr", "img", "input", "isindex", "link", "meta", "param",
)
HTML_VOID_ELEMENTS = ("embed", "source", "track", "wbr")

# --- Profile (fixed values) ---------------------------------------------------
DEFAULT_PROFILE = "default"
PROFILE_DESCRIPTION = (
    "Strip common threats from all supported file types (macros, OLE, ActiveX, external refs, "
    "JS, XFA, image metadata, SVG scripts, nested archives)."
)
CAPABILITIES = (
    "strip_macros", "strip_ole", "strip_activex", "strip_external_refs", "strip_js",
    "strip_launch_actions", "strip_embedded_files", "strip_xfa", "re_encode_images",
    "svg_script_removal", "archive_recursive",
)

# --- Histograms (fixed values) ------------------------------------------------
DURATION_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0)
SIZE_BOUNDS = (1024, 10240, 102400, 1048576, 10485760, 52428800)

# --- Event rules (fixed values) -----------------------------------------------
STREAK_ALERT = 5
DOWNLOAD_MAX_AGE_S = 600
DOWNLOAD_MAX_ITEMS = 100
DOWNLOAD_MAX_BYTES = 500 * MIB
TOKEN_TTL_S = 24 * 3600
LIMIT_WINDOW_S = 3600
CERT_WARN_DAYS = 14
LEDGER_VERSION = 1
