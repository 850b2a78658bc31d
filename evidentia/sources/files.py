"""Mixed files: type by content, and the text, tables, pairs and images in them.

Files come from ``folder`` or from Spark's binaryFile reader. Everything that has a built-in function is an
expression; containers, mail and quoted fields are read by small functions inside tasks,
one file at a time, and a file that cannot be read becomes a report, not a failure.
"""

import datetime
import email
import email.policy
import html
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import html_text, paragraphs, strip, xml_text
from evidentia.scratch import prepare
from evidentia.sources.folder import Folder, plain_path

MOST_BYTES = 25 << 20
MOST_INFLATED = 200 << 20
MOST_ENTRIES = 10_000
MOST_ROWS, MOST_COLUMNS = 50_000, 1024
#: Pictures taken from one container.
MOST_IMAGES = 50
MAGIC = (("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"))
#: How a page may start. Fixed values.
HTML_START = r"^<(head|body|div|table|p|span|ul|ol|h[1-6]|article|section|nav|main|aside|form|figure|header|footer|script|style|meta|link)[\s>/]"
PARTS = "name string, type string, kind string, part string, text string, headers array<string>, rows array<array<string>>, pairs map<string,string>, bytes binary, error string"


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, every_type: bool = False) -> DataFrame:
    """(name, length, head, content) of all files below a path; the content of those that are refused is never read.

    A folder that all machines mount is read in ranges (``folder.FolderReader``): a file's first bytes tell whether the rest is read;
    ``every_type`` reads the rest of types without a reader too, for readers that a caller brings.
    Of another store, listing and length come first, and only files of up to ``most_bytes`` are opened; Spark's
    reader passes over empty files there.
    """
    if plain_path(path):
        prepare(spark)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(Folder)
        return spark.read.format(Folder.name()).option("path", path).option("most_bytes", most_bytes).option("every_type", every_type).load().drop("n_read")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none = F.lit(None).cast("binary")
    small = files.where(F.col("length") <= most_bytes).select(F.col("path").alias("name"), "length", none.alias("head"), "content")
    return small.unionByName(files.where(F.col("length") > most_bytes).select(F.col("path").alias("name"), "length", none.alias("head"), none.alias("content")))


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content: text or bytes) as files below a folder that all machines mount; all of them appear, or none."""
    spark = files.sparkSession
    prepare(spark)
    spark.dataSource.register(Folder)
    files.select("name", "content").write.format(Folder.name()).mode("append").option("path", path).save()


def unquoted_count(line: Column, delimiter: str) -> Column:
    plain = F.regexp_replace(line, '"[^"]*"?', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(delimiter), F.lit("")))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def delimiter_of(text: Column) -> Column:
    """Comma or tab, if the first ten lines that are not empty hold it equally often, at least once; else null."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: x != ""), 1, 10)

    def even(d: str) -> Column:
        counts = F.array_distinct(F.transform(lines, lambda x: unquoted_count(x, d)))
        return (F.size(counts) == 1) & (F.get(counts, F.lit(0)) >= 1)

    return F.when(even(","), F.lit(",")).when(even("\t"), F.lit("\t"))


def looks_like_mail(text: Column) -> Column:
    """A block of two header lines or more at the start, one of a mail's own and one with an address."""
    head = F.left(text, F.lit(8192))
    block = F.split(head, r"\r?\n\r?\n", 2)[0]
    lines = F.split(block, r"\r?\n")
    fine = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z][A-Za-z0-9-]*:|^[ \t]+\S"))
    return (
        fine & (F.size(lines) >= 2) & head.rlike(r"(?im)^(Received|Message-ID|Return-Path|MIME-Version|From|To|Subject|Date):")
        & head.rlike(r"(?im)^(From|To|Cc|Reply-To):.*[@<]")
    )


def text_type(text: Column) -> Column:
    """rtf, html, xml, eml, json, csv, tsv or text."""

    def by_start(t: Column) -> Column:
        low = F.lower(F.left(t, F.lit(64)))
        return (
            F.when(t.startswith("{\\rtf"), "rtf")
            .when(low.startswith("<!doctype html") | low.startswith("<html") | low.rlike(HTML_START), "html")
            .when(t.startswith("<"), "xml")
            .when(looks_like_mail(text), "eml")
            .when((t.startswith("{") | t.startswith("[")) & F.try_parse_json(t).isNotNull(), "json")
            .otherwise(_once(delimiter_of(text), lambda d: F.when(d == ",", "csv").when(d == "\t", "tsv").otherwise("text")))
        )

    return _once(strip(text), by_start)


def content_type(content: Column) -> Column:
    """The type of a file by its bytes alone; containers are zip or ole here, and told apart by what is in them."""
    # The first bytes as characters, one for each.
    return _once(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), lambda head: _type_by_head(content, head))


def _type_by_head(content: Column, head: Column) -> Column:
    start = F.hex(F.substring(content, 1, 12))
    size = F.length(head)
    plain = F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F]+", ""))
    binary = head.contains("\u0000") | ((size > 0) & ((size - plain) / size > 0.05))
    found = F.when(start == "", "text")
    for magic, kind in MAGIC:
        found = found.when(start.startswith(magic), kind)
    found = found.when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "webp")
    # Names inside old office files are UTF-16; where they stand in the first megabyte tells the program.
    names = F.hex(F.substring(content, 1, 1 << 20))

    def named(word: str) -> Column:
        return names.contains(word.encode("utf-16-le").hex().upper())

    old = F.when(named("__substg1.0") | named("__properties_version1.0"), "msg").when(named("WordDocument"), "doc").when(named("Workbook") | named("Book"), "xls").otherwise("ole")
    found = found.when(start.startswith("D0CF11E0"), old).when(start.startswith("504B0304"), "zip").when(binary, "unknown")
    return found.otherwise(_once(F.decode(F.make_valid_utf8(content.cast("string")).cast("binary"), "UTF-8"), text_type))


def parse_delimited(text: str, delimiter: str) -> list[list[str]]:
    """Records of quoted fields: doubled quotes, quotes that open within a field, line ends in quotes; a blank line is one empty field."""
    records, record, field = [], [], []
    token = re.compile(r'"((?:[^"]|"")*)(?:"|$)|([^"\r\n' + re.escape(delimiter) + r"]+)|(\r)|(\n)|(" + re.escape(delimiter) + ")")
    for m in token.finditer(text):
        if m[1] is not None:
            field.append(m[1].replace('""', '"'))
        elif m[2] is not None:
            field.append(m[2])
        elif m[5]:
            record.append("".join(field))
            field = []
        elif m[4]:
            records.append([*record, "".join(field)])
            record, field = [], []
    if field and "".join(field) or record:
        records.append([*record, "".join(field)])
    return records


def _has_long_sizes(extra: bytes) -> bool:
    """Whether an entry's extra fields hold 64-bit sizes (field 1)."""
    at = 0
    while at + 4 <= len(extra):
        if int.from_bytes(extra[at:at + 2], "little") == 1:
            return True
        at += 4 + int.from_bytes(extra[at + 2:at + 4], "little")
    return False


def container_type(names: list[str]) -> str:
    """docx, pptx or xlsx by the folders of a container's parts, ooxml where none is known."""
    for folder, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")):
        if any(n.startswith(folder) for n in names):
            return kind
    return "ooxml"


def _opened(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    entries = z.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_INFLATED:
        raise ValueError("the container is too large")
    if any(_has_long_sizes(e.extra) for e in entries):
        raise ValueError("the container's sizes are in an extension that is refused")
    return z


#: Built-in number formats of dates and times. Fixed values.
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))


def number_text(text: str) -> str:
    """A stored number in its shortest form; anything else as it is."""
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and abs(x) < 1e21 else repr(x)


def _dated_styles(styles: str) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    own = {int(n) for n, code in re.findall(r'<numFmt\b[^>]*numFmtId="(\d+)"[^>]*formatCode="([^"]*)"', styles)
           if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|&quot;.*?&quot;|\[[^\]]*\]|\\.', "", code), re.I)}
    formats = re.search(r"<cellXfs\b.*?</cellXfs>", styles, re.S)
    used = re.findall(r'<xf\b[^>]*?numFmtId="(\d+)"', formats[0]) if formats else []
    return {k for k, n in enumerate(used) if int(n) in DATE_FORMATS or int(n) in own}


def _day_text(serial: str, since: datetime.datetime) -> str:
    """Days since an epoch as an ISO time to the millisecond."""
    at = since + datetime.timedelta(milliseconds=round(float(serial) * 86_400_000))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _sheet(xml: str, shared: list[str], dated: set[int] = frozenset(), since: datetime.datetime = datetime.datetime(1899, 12, 30)) -> list[list[str]]:
    """A sheet's cells by place: texts from the shared table or inline, formulas by their results, truth values as words, dates by the style."""
    table: list[list[str]] = []
    for row in re.findall(r"<row\b[^>]*>(.*?)</row>", xml, re.S)[: MOST_ROWS + 1]:
        cells: list[str] = []
        for attributes, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
            name = re.search(r'\br="([A-Z]+)', attributes)
            at = len(cells)
            if name:
                at = 0
                for letter in name[1]:
                    at = at * 26 + ord(letter) - 64
                at -= 1
            value = re.search(r"<v>(.*?)</v>", body, re.S)
            text = value[1] if value else "".join(re.findall(r"<t[^>]*>(.*?)</t>", body, re.S))
            kind, style = re.search(r'\bt="(\w+)"', attributes), re.search(r'\bs="(\d+)"', attributes)
            kind = kind[1] if kind else "n"
            if kind == "s" and value:
                text = shared[int(text)]
            elif kind == "b":
                text = "true" if text == "1" else "false" if text == "0" else text
            elif kind == "n" and text and style and int(style[1]) in dated:
                text = _day_text(text, since)
            elif kind == "n":
                text = number_text(text)
            else:
                text = html.unescape(text)
            if at < MOST_COLUMNS:
                cells += [""] * (at + 1 - len(cells))
                cells[at] = text
        table.append(cells)
    return table


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def _part(z: zipfile.ZipFile, name: str) -> str:
    return z.read(name).decode("utf-8", "replace")


def _sheets(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    shared = []
    if "xl/sharedStrings.xml" in names:
        items = re.findall(r"<si>(.*?)</si>", _part(z, "xl/sharedStrings.xml"), re.S)
        shared = [html.unescape("".join(re.findall(r"<t(?:\s[^>]*)?>(.*?)</t>", s, re.S))) for s in items]
    dated = _dated_styles(_part(z, "xl/styles.xml")) if "xl/styles.xml" in names else set()
    later = "xl/workbook.xml" in names and re.search(r'date1904="(?:1|true)"', _part(z, "xl/workbook.xml"))
    since = datetime.datetime(1904, 1, 1) if later else datetime.datetime(1899, 12, 30)
    for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
        rows = _sheet(_part(z, n), shared, dated, since)
        cut = " (cut)" if len(rows) > MOST_ROWS else ""
        yield {"type": "xlsx", "kind": "table", "part": f"sheet{_number(n)}{cut}", "headers": rows[0] if rows else [], "rows": rows[1:]}


def _document(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    """The body, then headers, footers, notes and comments by name, then who commented."""
    parts = [n for n in names if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n, re.I)]
    for n in sorted(parts, key=lambda n: (n != "word/document.xml", n)):
        yield {"type": "docx", "kind": "xml:w:t:w:p", "part": n, "text": _part(z, n)}
    authors = [html.unescape(a) for n in parts if n.lower().endswith("comments.xml") for a in re.findall(r'w:author="([^"]+)"', _part(z, n), re.I)]
    if authors:
        yield {"type": "docx", "kind": "text", "part": "word/comments.xml authors", "text": "comment authors: " + "; ".join(authors)}


def _slides(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    for folder in ("slides/slide", "notesSlides/notesSlide"):
        for n in sorted((n for n in names if re.fullmatch(rf"ppt/{folder}\d+\.xml", n)), key=_number):
            yield {"type": "pptx", "kind": "xml:a:t:a:p", "part": n, "text": _part(z, n)}


def _pictures(z: zipfile.ZipFile, names: list[str]) -> Iterator[dict]:
    """The first pictures of a container; empty, very large and unreadable ones are passed over."""
    for n in [n for n in names if re.fullmatch(r"(word|ppt|xl)/media/[^/]+\.(png|jpe?g|gif|webp)", n, re.I)][:MOST_IMAGES]:
        try:
            data = z.read(n) if 0 < z.getinfo(n).file_size <= MOST_BYTES else b""
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
            continue
        if data:
            yield {"type": n.rsplit(".", 1)[1].lower().replace("jpg", "jpeg"), "kind": "image", "part": n, "bytes": data}


CONTAINERS = {"xlsx": _sheets, "docx": _document, "pptx": _slides}


def read_office(name: str, content: bytes) -> Iterator[dict]:
    """Tables of sheets; the xml of documents and slides, which expressions turn to text; pictures. Other containers have nothing."""
    with _opened(content) as z:
        names = z.namelist()
        read = CONTAINERS.get(container_type(names))
        if read:
            yield from read(z, names)
            yield from _pictures(z, names)


def read_mail(name: str, content: bytes) -> Iterator[dict]:
    """The body and the pairs of its headers; people as name and address, so that no address is lost."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    if body is not None:
        yield {"type": "eml", "kind": "html" if body.get_content_type() == "text/html" else "text", "part": "body", "text": body.get_content()}
    pairs = {k: str(message[k]) for k in ("subject", "date") if message[k]}
    for k in ("from", "to", "cc", "bcc", "reply-to"):
        people = [f"{a.display_name} <{a.addr_spec}>" if a.display_name and a.addr_spec else a.display_name or a.addr_spec for a in getattr(message[k], "addresses", ())]
        if any(people):
            pairs[k] = "; ".join(p for p in people if p)
    if pairs:
        yield {"type": "eml", "kind": "keyvalue", "part": "headers", "pairs": pairs}


def image_mime(kind: Column) -> Column:
    """The media type of a picture's type; null for anything else."""
    return F.when(kind.isin("png", "jpeg", "gif", "webp"), F.concat(F.lit("image/"), kind))


#: Groups of a rich text that hold no text. Fixed values.
RTF_SKIPPED = {"pict", "object", "bin", "fonttbl", "colortbl", "stylesheet", "themedata", "datastore", "info"}
RTF_TOKEN = re.compile(r"\\u(-?\d+) ?\??|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d*) ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.S)


def rtf_text(rtf: str) -> str:
    """The words of a rich text: groups without text are skipped by keeping one flag for each open brace."""
    out, skipped = [], [False]
    for m in RTF_TOKEN.finditer(rtf):
        code, byte, word, _, _, brace, text = m.groups()
        if brace == "{":
            skipped.append(skipped[-1])
        elif brace == "}":
            if len(skipped) > 1:
                skipped.pop()
        elif word and word.lower() in RTF_SKIPPED:
            skipped[-1] = True
        elif skipped[-1]:
            continue
        elif code:
            out.append(chr(int(code) & 0xFFFF))
        elif byte:
            out.append(chr(int(byte, 16)))
        elif word in ("par", "pard", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif text:
            out.append(text)
    joined = re.sub(r" *\n *", "\n", re.sub(r"[ \t\f\v\r]+", " ", "".join(out)))
    return re.sub(r"\n{3,}", "\n\n", joined).strip().encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_rich_text(name: str, content: bytes) -> Iterator[dict]:
    yield {"type": "rtf", "kind": "text", "part": "", "text": rtf_text(content.decode("utf-8", "replace"))}


def _delimited(kind: str, delimiter: str):
    def read(name: str, content: bytes) -> Iterator[dict]:
        records = parse_delimited(content.decode("utf-8", "replace"), delimiter)
        yield {"type": kind, "kind": "table", "part": "", "headers": records[0] if records else [], "rows": records[1:]}

    return read


#: A reader of one file's bytes by type; extract() takes others beside or instead of these.
Reader = Callable[[str, bytes], Iterator[dict]]
READERS: dict[str, Reader] = {"zip": read_office, "eml": read_mail, "csv": _delimited("csv", ","), "tsv": _delimited("tsv", "\t"), "rtf": read_rich_text}

#: What a person can do about a type that is not read.
ADVICE = {"pdf": "export its text or its pictures", "msg": "save it as .eml", "doc": "save it as .docx", "xls": "save it as .xlsx or .csv", "ole": "save it in a current format"}


def _reads(readers: dict[str, Reader]):
    columns = [c.split()[0] for c in PARTS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, kind, content in batch.itertuples(index=False):
                try:
                    out += [{"name": name} | p for p in readers[kind](name, bytes(content))] or [{"name": name, "type": kind, "error": "nothing was found in it"}]
                except Exception as e:  # one bad file is one report
                    out.append({"name": name, "type": kind, "error": " ".join(str(e).split())[:120]})
            yield pd.DataFrame(out, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return read


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(name, type, kind, part, text, headers, rows, pairs, bytes, error): what is in each file, or why it could not be read.

    ``readers`` by type come beside READERS or take their place. Formats without one (pdf, old office files, which
    need libraries of their own) are reported as unsupported, with what to do about it.
    """
    readers = READERS | (readers or {})
    # A file whose content was not read is told by its first bytes.
    known = F.coalesce(F.col("content"), F.col("head")) if "head" in files.columns else F.col("content")
    size = F.col("length") if "length" in files.columns else F.length("content")
    kind = F.when((size > MOST_BYTES) | known.isNull(), "too large").otherwise(content_type(known))
    # Made by a generator, so that the conditions on it below do not work it out once more; an outer one, from which none is inferred.
    typed = files.select("*", F.explode_outer(F.array(kind)).alias("type"))
    nothing = {c.split()[0]: F.lit(None).cast(c.split(None, 1)[1]) for c in PARTS.split(", ")}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*[given.get(c, F.col(c) if c in ("name", "type") else none).alias(c) for c, none in nothing.items()])

    text = F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")
    own = F.when(F.col("type") == "html", html_text(text)).when(F.col("type") == "xml", xml_text(text)).otherwise(text)
    texts, pictures = [[k for k in kinds if k not in readers] for kinds in (("html", "xml", "json", "text"), ("png", "jpeg", "gif", "webp"))]
    packed = typed.where(F.col("type").isin(*readers)).select("name", "type", "content").mapInPandas(_reads(readers), PARTS)
    packed = packed.withColumn("text", F.when(F.col("kind") == "html", html_text(F.col("text")))
                               .when(F.col("kind") == "xml:w:t:w:p", paragraphs(F.col("text")))
                               .when(F.col("kind") == "xml:a:t:a:p", paragraphs(F.col("text"), "a:t", "a:p")).otherwise(F.col("text")))
    packed = packed.withColumn("kind", F.when(F.col("kind").rlike("^(html|xml:)"), "text").otherwise(F.col("kind")))
    why = F.when(F.col("type") == "too large", F.lit(f"over {MOST_BYTES} bytes")).when(F.col("type") == "unknown", F.lit("unrecognized file type"))
    for kind, advice in ADVICE.items():
        why = why.when(F.col("type") == kind, F.lit(f"unsupported format; {advice}"))
    why = why.otherwise(F.lit("unsupported format; save it as one that is read"))
    is_text, is_picture = F.col("type").isin(*texts), F.col("type").isin(*pictures)
    # All that is not read by Python in one pass: a file's type is worked out twice, here and for the readers.
    whole = rows(typed.where(~F.col("type").isin(*readers)), kind=F.when(is_text, "text").when(is_picture, "image"), text=F.when(is_text, own),
                 bytes=F.when(is_picture, F.col("content")), error=F.when(~is_text & ~is_picture, why))
    return whole.unionByName(packed)


def cells_of(parts: DataFrame) -> DataFrame:
    """(source, row_idx, col_idx, header, cell) of extracted tables; missing cells of short rows are empty."""
    tables = parts.where("kind = 'table' and size(headers) > 0")
    source = F.when(F.coalesce("part", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("#", "name", "part"))
    rows = tables.select(source.alias("source"), "headers", F.posexplode("rows").alias("row_idx", "row"))
    cells = rows.select("source", "row_idx", "row", F.posexplode("headers").alias("col_idx", "header"))
    return cells.select("source", "row_idx", "col_idx", "header", F.coalesce(F.get("row", F.col("col_idx")), F.lit("")).alias("cell"))


def quarantine(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """With ``flag``: why a file's text is not to be rewritten (image, large, binary, not UTF-8), or null."""
    content = F.coalesce(F.col("content"), F.col("head")) if "head" in files.columns else F.col("content")
    text = content.cast("string")
    image = F.lower("name").rlike(r"\.(png|jpe?g|gif|webp|bmp|tiff?|ico)$")
    controls = F.length(F.regexp_replace(text, r"[\x01-\x08\x0E-\x1F]", ""))
    binary = text.contains("\u0000") | ((F.length(text) > 0) & ((F.length(text) - controls) / F.length(text) > 0.05))
    return files.withColumn(
        "flag", F.when(image, "image").when(F.col("length") > most_bytes, "large").when(~F.is_valid_utf8(text), "not UTF-8").when(binary, "binary")
    )
