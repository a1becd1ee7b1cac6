"""Text sizes, labels, project names and redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode White_Space code points, as ranges.
WHITE_SPACE_RANGES = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
)

#: Body of a regex character class, understood alike by Java and RE2.
WHITE_SPACE_CLASS = "".join(
    rf"\x{{{low:02X}}}" if low == high else rf"\x{{{low:02X}}}-\x{{{high:02X}}}"
    for low, high in WHITE_SPACE_RANGES
)
_WHITE_SPACE_CHARS = "".join(
    chr(code) for low, high in WHITE_SPACE_RANGES for code in range(low, high + 1)
)
WORD_PATTERN = f"[^{WHITE_SPACE_CLASS}]+"
# Fixed value: what makes a label look like an absolute path.
ABSOLUTE_PATH_PATTERN = r"^(?:[/\\]|(?i:file:)|[A-Za-z]:[/\\])"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_unicode(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE_SPACE_CHARS))


def words(c: Column) -> Column:
    """Runs of characters between Unicode white space.

    Every white-space character becomes a blank and the text is cut at single
    blanks, which needs no regular expression: twice as fast as counting matches.
    """
    blanks = F.translate(c, _WHITE_SPACE_CHARS, " " * len(_WHITE_SPACE_CHARS))
    return F.array_size(F.array_remove(F.split(blanks, " "), "")).cast("long")


def characters(c: Column) -> Column:
    """Unicode code points."""
    return F.length(c).cast("long")


def has_text(c: Column) -> Column:
    return F.coalesce(trim_unicode(c) != "", F.lit(False))


def safe_label(c: Column, limit: int) -> Column:
    """A short printable label, NULL when blank or when it looks like a path."""
    printable = F.regexp_replace(trim_unicode(c), r"\p{Cc}", "")
    label = trim_unicode(F.substring(printable, 1, limit))
    return F.when((label != "") & ~label.rlike(ABSOLUTE_PATH_PATTERN), label)


def _last_component(path: Column) -> Column:
    plain = blank_to_null(F.regexp_extract(path, "([^/]+)/*$", 1))
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(kept: Column, part: Column) -> Column:
        can_pop = (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
        popped = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (F.when((part == "..") & can_pop, popped)
                 .when((part == "..") & rooted, kept)
                 .otherwise(F.concat(kept, F.array(part))))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    # The fold is only evaluated for the rare paths with dot components.
    dotted = path.startswith(".") | path.contains("/.")
    return F.when(dotted, F.try_element_at(folded, F.lit(-1))).otherwise(plain)


def project_name(path: Column) -> Column:
    """Final directory name of a path of any OS; NULL for a root or a drive."""
    name = _last_component(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(~name.endswith(":"), safe_label(name, 80))


def project_from_uri(uri: Column) -> Column:
    """Base name of the URI's path, or of the text itself when it has none."""
    path = blank_to_null(F.try_parse_url(F.replace(uri, F.lit(" "), F.lit("%20")), F.lit("PATH")))
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return project_name(F.coalesce(decoded, uri))


def project_from_file_uris(uris: Column) -> Column:
    """First ``file:`` URI of an array that yields a usable name."""
    names = F.transform(
        F.filter(uris, lambda u: u.rlike("^(?i:file):")), project_from_uri)
    return F.try_element_at(F.filter(names, lambda n: n.isNotNull()), F.lit(1))


def decode_directory(name: Column) -> Column:
    """Percent-decoded directory name; an undecodable name stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def chat_folder_project(path: Column) -> Column:
    """Folder above ``chats``; hash-named folders carry no project."""
    name = blank_to_null(F.regexp_extract(path, r"([^/]+)/chats/(?:[^/]+/)*[^/]+$", 1))
    return F.when(~name.rlike("^[0-9a-fA-F]{32,}$"), safe_label(name, 80))


def single_label(ids: Column, limit: int = 80) -> Column:
    """The one distinct usable label of an array, else NULL."""
    labels = F.array_distinct(F.filter(F.transform(ids, lambda x: safe_label(x, limit)),
                                       lambda x: x.isNotNull()))
    return F.when(F.size(labels) == 1, F.try_element_at(labels, F.lit(1)))


def clean_text(c: Column, fallback: str, limit: int) -> Column:
    """Control characters to spaces, local paths masked, spaces collapsed, clipped."""
    text = F.regexp_replace(c, r"[\x00-\x1F\x7F]+", " ")
    text = F.regexp_replace(text, r"/(?:Users|home)/[^\s,;]+", "[local path]")
    text = F.regexp_replace(text, r"[A-Za-z]:\\[^\s,;]+", "[local path]")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    clipped = F.concat(F.rtrim(F.substring(text, 1, max(1, limit - 1))), F.lit("…"))
    return (F.when(text.isNull() | (text == ""), F.lit(fallback))
             .when(F.length(text) > limit, clipped).otherwise(text))
