"""Text functions as Column expressions; all run inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that counts, in both engines.
BLANK = " \t\r\n\f\x0b"
_WS = r"[ \t\r\n\f\x0B]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def normalize_whitespace(c: Column) -> Column:
    """Any run of white space becomes one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(c, _WS + "+", " "), F.lit(" "))


def clean_refs(c: Column) -> Column:
    """[[Text|id]] and then [[Text]] become Text."""
    c = F.regexp_replace(c, r"\[\[(.*?)\|.*?\]\]", "$1")
    return F.regexp_replace(c, r"\[\[(.*?)\]\]", "$1")


def clean_clozes(c: Column) -> Column:
    """{{c1::hidden::hint}} becomes hidden."""
    return F.regexp_replace(c, r"\{\{c\d+::(.*?)(::.*?)?\}\}", "$1")


def strip_markdown(c: Column) -> Column:
    """Bold and italic marks go; an image becomes its alternative text."""
    c = F.replace(F.replace(c, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    return F.regexp_replace(c, r"!\[(.*?)\]\(.*?\)", "$1")


def clean_text(c: Column) -> Column:
    return strip(strip_markdown(clean_clozes(clean_refs(normalize_whitespace(c)))))


def mask_images(clean: Column, raw: Column, host: str, mark: str = "[IMG URL]") -> Column:
    """A line that cleans to nothing but holds the image host is kept as a mark."""
    return F.when((clean == "") & raw.contains(host), F.lit(mark)).otherwise(clean)


def indent_level(c: Column) -> Column:
    return F.floor((F.length(c) - F.length(F.ltrim(c, F.lit(BLANK)))) / 2).cast("int")


def header_level(c: Column) -> Column:
    """Number of # in the first run, after bullets; null if there is none."""
    n = F.length(F.regexp_extract(strip(c), r"^[ \t\r\n\f\x0B-]*(#+)", 1))
    return F.when(n > 0, n)


def strip_bullets(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"^[-*]+", ""))


def extract_link(c: Column) -> Column:
    """struct(name, url) of the first Markdown link, else of the first raw URL; a name equal to the URL is null."""
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    name, url = F.regexp_extract(c, link, 1), F.regexp_extract(c, link, 2)
    raw = F.regexp_extract(c, r"(https?://[^ \t\r\n\f\x0B)]+)", 1)
    return F.struct(
        F.when((url != "") & (name != url), name).alias("name"),
        F.coalesce(F.nullif(url, F.lit("")), F.nullif(raw, F.lit(""))).alias("url"),
    )


def link_slug(name: Column, url: Column, extension: str, most: int = 100) -> Column:
    """File name of a linked resource; a name without usable characters falls back to a hash of the URL."""
    own = F.replace(strip(F.regexp_replace(name, r"[^A-Za-z0-9_ \t\r\n\f\x0B-]", "")), F.lit(" "), F.lit("_"))
    own = F.concat(F.when(own == "", F.substring(F.sha2(url, 256), 1, 32)).otherwise(own), F.lit(extension))
    last = F.element_at(F.split(F.element_at(F.split(url, "/"), -1), r"\?"), 1)
    last = F.when(last.endswith(extension), last).otherwise(F.concat(last, F.lit(extension)))
    return F.right(F.when(F.coalesce(name, F.lit("")) != "", own).otherwise(last), F.lit(most))


def route_content_type(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.contains("application/pdf"), "pdf").when(low.contains("image/"), "image").when(low.contains("text/html") | low.contains("text/plain"), "text").otherwise("other")
    )


def fence_strip(c: Column) -> Column:
    """The inside of a surrounding code fence, else the text as it is."""
    pattern = r"(?s)^```(?:json|JSON)?[ \t\r\n\f\x0B]*\n?(.*?)\n?```$"
    bare = strip(c)
    return F.when(bare.rlike(pattern), strip(F.regexp_extract(bare, pattern, 1))).otherwise(c)


def smart_truncate(c: Column, limit: int, mark: str = " …[truncated]") -> Column:
    """Cut at the last sentence end within the limit if it lies at 60 % or beyond, else at the limit."""
    head = F.substring(c, 1, limit)

    def last(sep: str) -> Column:
        at = F.locate(sep[::-1], F.reverse(head))
        return F.when(at > 0, F.length(head) - at - len(sep) + 1).otherwise(-1)

    cut = head
    for sep in reversed((". ", "! ", "? ", "\n")):
        at = last(sep)
        cut = F.when(at * 10 >= limit * 6, F.substring(head, F.lit(1), at + 1)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(cut, F.lit(BLANK)), F.lit(mark)))


def truncate_marked(c: Column, limit: int) -> Column:
    more = F.concat(F.substring(c, 1, limit), F.lit("\n... [+"), (F.length(c) - limit).cast("string"), F.lit(" chars truncated]"))
    return F.when(F.length(c) <= limit, c).otherwise(more)


def classify_error(name: Column, message: Column) -> Column:
    """Exception name and message to a coarse kind; rules in order."""
    low = F.lower(message)
    return (
        F.when((name == "UnicodeEncodeError") | message.contains("surrogates not allowed"), "unicode_encode_error")
        .when(name.isin("OutputParserException", "ValidationError") | low.contains("validation error"), "structured_output_parse_error")
        .when(name.isin("TimeoutError", "ReadTimeout", "WriteTimeout", "ConnectTimeout") | low.contains("timeout"), "timeout")
        .when(low.contains("connection") | name.isin("ConnectError", "ConnectionError"), "connection_error")
        .otherwise(F.concat(F.lit("unexpected:"), name))
    )


def entity_id(label: Column, name: Column) -> Column:
    whole = F.when(F.coalesce(label, F.lit("")) == "", name).otherwise(F.concat(label, F.lit(":"), name))
    return F.substring(F.sha2(whole, 256), 1, 16)


def node_text_split(crumbs: Column) -> Column:
    """struct(text, path) of a breadcrumb split on '>'."""
    parts = F.transform(F.split(crumbs, ">"), strip)
    return F.struct(F.element_at(parts, -1).alias("text"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("path"))


def token_count(c: Column) -> Column:
    """Words and single marks, as a stand-in where no tokenizer is plugged in."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f\x0B]"), 0))
