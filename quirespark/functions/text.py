"""Text scalars as column expressions: digests, encodings, entities, font names, headers, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c

#: Letters of scripts that put no space between words, and their punctuation.
CJK = r"[⺀-鿿豈-﫿︰-﹏＀-￯　-〿]"


def is_cjk(char) -> Column:
    return F.coalesce(F.rlike(_c(char), F.lit(CJK)), F.lit(False))


def ascii_hex(data) -> Column:
    """ASCIIHexDecode: white space is skipped, > ends, an odd digit is padded with 0."""
    digits = F.regexp_replace(F.regexp_replace(_c(data), ">(?s).*$", ""), r"[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def md5_bytes(x) -> Column:
    return F.unhex(F.md5(_c(x)))


def sha_bytes(x, bits: int = 256) -> Column:
    return F.unhex(F.sha2(_c(x), bits))


def crc32(x) -> Column:
    """The checksum of ZIP entries, of text as UTF-8 or of bytes."""
    return F.crc32(F.col(x).cast("binary") if isinstance(x, str) else x.cast("binary"))


def lenient_base64(x) -> Column:
    """Base64 with everything outside its alphabet ignored."""
    return F.unbase64(F.regexp_replace(_c(x), r"[^A-Za-z0-9+/=]", ""))


def pdf_text_string(data) -> Column:
    """UTF-16BE or UTF-8 by byte order mark, else Latin-1."""
    b = _c(data)
    return (
        F.when(F.substring(b, 1, 2) == F.unhex(F.lit("FEFF")), F.decode(F.expr(f"substring({_name(data)}, 3)"), "UTF-16BE"))
        .when(F.substring(b, 1, 3) == F.unhex(F.lit("EFBBBF")), F.decode(F.expr(f"substring({_name(data)}, 4)"), "UTF-8"))
        .otherwise(F.decode(b, "ISO-8859-1"))
    )


def _name(x) -> str:
    return x if isinstance(x, str) else x._jc.toString()


#: The five named entities.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def unescape(x) -> Column:
    out = _c(x)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape(x) -> Column:
    """XML text: control characters that XML doesn't allow go."""
    out = F.regexp_replace(_c(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for entity, char in reversed(ENTITIES):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


#: Pattern of a font's name (without subset tag, lower case, no space or hyphen) and the name shown.
FONT_ALIASES = [
    (r"^(arial|helvetica)", "Arial"), (r"^(timesnewroman|times)", "Times New Roman"), (r"^(couriernew|courier)", "Courier New"), (r"^(simsun|songti|nsimsun)", "SimSun"),
    (r"^(simhei|heiti)", "SimHei"), (r"^(microsoftyahei|msyh)", "Microsoft YaHei"), (r"^(kaiti|simkai)", "KaiTi"), (r"^(calibri)", "Calibri"), (r"^(cambria)", "Cambria"), (r"^(segoeui)", "Segoe UI"),
]


def font_name(raw) -> Column:
    """A font's name to show: the six-letter subset tag goes, known families get their usual name."""
    bare = F.regexp_replace(_c(raw), r"^[A-Z]{6}\+", "")
    key = F.regexp_replace(F.lower(bare), r"[\s_-]", "")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in FONT_ALIASES:
        chain = chain.when(F.rlike(key, F.lit(pattern)), name)
    return chain.otherwise(bare)


def is_bold(name, weight=None, flags=None) -> Column:
    """By name, weight of 600 or more, or the ForceBold flag; the stem width says nothing reliable."""
    out = F.rlike(F.lower(_c(name)), F.lit(r"bold|black|heavy|semibold|demi"))
    if weight is not None:
        out = out | F.coalesce(_c(weight) >= 600, F.lit(False))
    if flags is not None:
        out = out | F.coalesce(_c(flags).bitwiseAND(F.lit(1 << 18)) != 0, F.lit(False))
    return F.coalesce(out, F.lit(False))


def is_italic(name, angle=None) -> Column:
    out = F.rlike(F.lower(_c(name)), F.lit(r"italic|oblique"))
    return F.coalesce(out if angle is None else out | F.coalesce(_c(angle) != 0, F.lit(False)), F.lit(False))


def headers(block) -> Column:
    """name -> value of a MIME header block: folded lines are joined, names lower case, the last of equal names stays."""
    unfolded = F.regexp_replace(F.regexp_replace(_c(block), "\r\n", "\n"), r"\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, "\n"), lambda x: F.rlike(x, F.lit(r"^[\x21-\x39\x3b-\x7e]+:")))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def mime_type(headers_map) -> Column:
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(F.element_at(_c(headers_map), "content-type"), F.lit("text/plain")), ";"), 1)))


def charset(content_type) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(content_type), r"(?i)charset\s*=\s*\"?([\w-]+)\"?", 1)), F.lit(""))


def repeat_key(x) -> Column:
    """How repeated headers and footers are told: digits as #, white space as one space, 60 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"[0-9]+", "#"), r"\s+", " ")), 1, 60)


#: What a page number alone looks like.
PAGE_NUMBER = r"^[\-—–\s]*[0-9]{1,4}[\-—–\s]*$"
#: File kinds by extension.
KINDS = [(r"\.pdf$", "pdf"), (r"\.(pptx|potx)$", "pptx"), (r"\.(mht|mhtml|htm|html)$", "html"), (r"\.(png|jpe?g|gif|bmp|webp|svg)$", "image"), (r"\.ppt$", "ppt-unsupported")]


def file_kind(path) -> Column:
    low = F.lower(_c(path))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, kind in KINDS:
        chain = chain.when(F.rlike(low, F.lit(pattern)), kind)
    return chain.otherwise(F.lit("other"))


#: What the creating program's name tells.
ORIGINS = [("slides", r"powerpoint|keynote|impress|canva|figma|sketch"), ("document", r"word|wps|pages"), ("latex", r"latex|pdftex|xetex|luatex"), ("scan", r"scan|scanner")]


def origin(creator, producer) -> Column:
    name = F.lower(F.concat_ws(" ", F.coalesce(_c(creator), F.lit("")), F.coalesce(_c(producer), F.lit(""))))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in ORIGINS:
        chain = chain.when(F.rlike(name, F.lit(pattern)), kind)
    return chain


def first_font(css) -> Column:
    """The first family of a CSS list that isn't a generic one."""
    names = F.transform(F.split(_c(css), ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", "")))
    generic = ["serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "inherit", "initial", ""]
    return F.get(F.filter(names, lambda x: ~F.lower(x).isin(generic)), F.lit(0))


def safe_name(url) -> Column:
    """The last part of a URL without its query, 80 characters at most."""
    return F.substring(F.regexp_extract(F.regexp_replace(_c(url), r"[?#].*$", ""), r"([^/\\]*)$", 1), 1, 80)
