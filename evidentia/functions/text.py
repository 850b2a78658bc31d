"""Text: markup, white space, patterns, escapes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of what is looked for in texts.
_LOCAL = "[A-Za-z0-9._%+-]"
#: It begins where a run of such characters begins or the last hit ended, and takes the run at once: a long run without @ is read once.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The edge of a word of ASCII letters, digits and underscores; it takes no character, so neighbours are all found.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
IPV4 = rf"{EDGE}{OCTET}(?:\.{OCTET}){{3}}{EDGE}"
HOST = rf"{EDGE}[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){{2,}}{EDGE}"
#: The capital comes first and what stands before it is looked at afterwards: most places fail at their first letter.
NAME = r"(\p{Lu}(?<![\p{L}\p{N}_]\p{Lu})\p{L}+(?:\s+\p{Lu}\p{L}+){1,3})"
#: What every text with a hit of a kind has, and is found faster than the hit.
HAS_EMAIL, HAS_IPV4, HAS_HOST = "@", r"\.\d{1,3}\.\d{1,3}\.\d", r"\.[A-Za-z0-9-]+\.[A-Za-z0-9-]"
SECRET_KEY = r"sk-[A-Za-z0-9_-]{4,}"
STOP_WORDS = (
    "The", "This", "That", "These", "Those", "A", "An", "In", "On", "For", "And", "Or", "But", "Our",
    "Your", "We", "It", "As", "At", "By", "To", "Of", "If", "Is", "Are", "With", "From", "Per", "Via",
    "All", "Each", "When", "While", "Note", "See", "Table", "Figure", "Section", "Summary", "Overview",
)
NAMED_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def strip(text: Column) -> Column:
    """Without white space at the ends, the no-break space included."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def collapse(text: Column) -> Column:
    """Blanks within lines become one, none stand at line ends, and at most one line stays empty."""
    one = F.regexp_replace(text, r"[ \t\f\x0B\r]+", " ")
    ends = F.regexp_replace(one, r" *\n *", "\n")
    return strip(F.regexp_replace(ends, r"\n{3,}", "\n\n"))


def decode_entities(text: Column) -> Column:
    """The six named entities in any case, and numeric ones; all others stay as they are.

    Numeric entities are decoded piece by piece between the places where they stand; the
    ampersand comes last, so that nothing is decoded twice.
    """
    numeric = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    marked = F.regexp_extract_all(text, F.lit(numeric), F.lit(0))
    gaps = F.split(text, numeric, -1)

    def one(m: Column) -> Column:
        body = F.substring(m, 3, 16)
        hexed = F.regexp_extract(body, "^[xX]([0-9a-fA-F]+);", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(body, "^([0-9]+);", 1)).try_cast("int")
        # A code point as its big-endian UTF-32 bytes.
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.when(code == 38, F.lit("&amp;")).otherwise(char)).otherwise(m)

    out = F.concat_ws("", F.zip_with(gaps, F.transform(marked, one), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))))
    out = F.when(F.size(marked) > 0, out).otherwise(text)
    for name, char in NAMED_ENTITIES:
        out = F.regexp_replace(out, f"(?i)&{name};", F.lit(char.replace("\\", "\\\\").replace("$", "\\$")))
    return out


def strip_code(html: Column) -> Column:
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


# What counts as a link's target.
LINK = r'(?i)\b(?:href|src|data-[\w-]+)\s*=\s*"(mailto:[^"]+|https?://[^"]+|[^"\s]*@[^"\s]+)"'


def link_targets(html: Column) -> Column:
    """Mail, web and address-like targets of links outside code, each once in order."""
    found = F.regexp_extract_all(strip_code(html), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "(?i)^mailto:", "")))


def html_text(html: Column) -> Column:
    """Readable text: no code or tags, line ends after blocks, entities decoded, link targets at the end."""
    lines = F.regexp_replace(strip_code(html), r"(?i)<br\s*/?>", "\n")
    lines = F.regexp_replace(lines, r"(?i)</(?:p|div|li|tr|h[1-6]|table|section|article|header|footer|ul|ol|blockquote)\s*>", "\n")
    text = collapse(decode_entities(F.regexp_replace(lines, "<[^>]+>", " ")))
    targets = link_targets(html)
    return F.when(F.size(targets) > 0, F.concat(text, F.lit("\n"), F.array_join(targets, " "))).otherwise(text)


def xml_text(xml: Column) -> Column:
    text = collapse(decode_entities(F.regexp_replace(strip_code(xml), "<[^>]+>", " ")))
    targets = link_targets(xml)
    return F.when(F.size(targets) > 0, F.concat(text, F.lit("\n"), F.array_join(targets, " "))).otherwise(text)


def paragraphs(xml: Column, tag: str = "w:t", block: str = "w:p", most: int = 2_000_000) -> Column:
    """The text runs of an office document, one line per block that has any."""
    blocks = F.split(xml, rf"</{block}>")
    run = rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    lines = F.transform(blocks, lambda b: F.array_join(F.regexp_extract_all(b, F.lit(run), F.lit(1)), ""))
    return F.left(decode_entities(F.array_join(F.filter(lines, lambda x: x != ""), "\n")), F.lit(most))


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def slug(text: Column, most: int | None = None, default: str = "") -> Column:
    """Lower-case letters and digits with dashes between."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.left(out, F.lit(most)) if most else out
    return F.when(out == "", F.lit(default)).otherwise(out) if default else out


def redact_keys(text: Column, key: Column | None = None) -> Column:
    """A known key, then anything that looks like one, becomes three stars."""
    out = F.when(F.length(key) > 0, F.replace(text, key, F.lit("***"))).otherwise(text) if key is not None else text
    return F.regexp_replace(out, SECRET_KEY, "***")


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, in either case, without overlaps."""
    low, p = F.lower(text), F.lower(phrase)
    return F.when(F.length(p) > 0, (F.length(low) - F.length(F.replace(low, p, F.lit("")))) / F.length(p)).otherwise(0).cast("long")


def is_noise(text: Column) -> Column:
    """Blank, or opening like a greeting or footer without anything about sizes."""
    t = strip(text)
    facts = t.rlike(r"[0-9]") & t.rlike(r"(?i)\b(shard|replica|vcpu|core|node|cpu|ram|tb|gb|iops|ops|storage|data\s*size|utiliz|backup)\b")
    opening = t.rlike(r"(?im)\A(--\s*$|regards|sincerely|best regards|thanks|thank you|sent from my|confidential|this email|disclaimer)")
    return (t == "") | (~facts & opening)


def role_token(text: Column) -> Column:
    """dr, secondary or primary, as the words of a header say; null if they say none."""
    t = norm(text)
    return (
        F.when(t.rlike(r"\b(dr|disaster|standby|recovery)\b"), "dr")
        .when(t.rlike(r"\b(secondary|analytics|electable|replica)\b"), "secondary")
        .when(t.rlike(r"\bprimary\b"), "primary")
    )


def looks_like_time(text: Column) -> Column:
    """Seconds or milliseconds since 1970, or an ISO date or time."""
    t = strip(text)
    iso = r"^[+-]?\d{4,6}-\d{2}(-\d{2})?([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    day = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return t.rlike(r"^\d{10,13}$") | (t.rlike(iso) & (day.isNotNull() | t.rlike(r"^\d{4}-\d{2}$")))


def is_currency(header: Column, filled: Column, dollars: Column) -> Column:
    """A column of money: its header says so, or half of its filled cells start with a dollar sign."""
    return header.rlike(r"(?i)\$|cost|price|usd|amount") | F.coalesce((filled > 0) & (dollars / filled >= 0.5), F.lit(False))
