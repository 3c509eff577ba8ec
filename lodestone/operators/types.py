"""What a file is, by its content and, for what a system runs, by its name. Rules are columns; only a zip's directory is read
in Python, and only of files that begin like one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.signs import EXECUTABLE, EXTENSIONS, TEXTS
from lodestone.session import ship_package

HEAD, LONG_HEAD = 4096, 65536

# First bytes (as Latin-1 characters) of programs, of containers, and of documents and pictures.
PROGRAMS = [("elf", "\x7fELF"), *[("macho-or-class", x) for x in ("\xfe\xed\xfa\xce", "\xfe\xed\xfa\xcf", "\xce\xfa\xed\xfe", "\xcf\xfa\xed\xfe", "\xca\xfe\xba\xbe")], ("lnk", "\x4c\0\0\0\x01\x14\x02\0")]
CONTAINERS = [("7z", "7z\xbc\xaf\x27\x1c"), ("rar", "Rar!\x1a\x07"), ("gz", "\x1f\x8b"), ("bz2", "BZh"), ("xz", "\xfd7zXZ\0")]
DOCUMENTS = [("document", "pdf", "%PDF-"), ("document", "rtf", "{\\rtf"), ("image", "png", "\x89PNG\r\n\x1a\n"), ("image", "jpg", "\xff\xd8\xff"), ("image", "tiff", "II*\0"), ("image", "tiff", "MM\0*")]
ZIPS = ["PK\x03\x04", "PK\x05\x06", "PK\x07\x08"]
OLE = "\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
SIDECAR = "\0\x05\x16\x07"
OPEN_DOCUMENTS = {
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp", "application/epub+zip": "epub",
}
OFFICE_FOLDERS = [("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("visio/", "vsdx")]
OFFICE = ["docx", "xlsx", "pptx", "vsdx", "odt", "ods", "odp", "epub"]
# Header fields of letters, and those that ordinary texts never have.
MAIL_FIELDS = "from to subject date message-id received return-path mime-version delivered-to content-type x-mailer reply-to cc".split()
MAIL_ONLY = "received return-path delivered-to message-id mime-version".split()

KIND = "struct<family:string,type:string,macros:boolean>"


def _zip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds names (lower case; null if the directory can't be read) and the first bytes of a leading `mimetype` member."""
    import io
    import zipfile

    for batch in batches:
        names, kinds = [], []
        for content in batch.column("content"):
            data = content.as_py()
            found, kind = None, None
            if data is not None and data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        listed = z.namelist()
                        if listed[:1] == ["mimetype"]:
                            with z.open("mimetype") as member:  # a member can unpack to any size
                                kind = member.read(80).decode("ascii", "replace").strip()
                        found = [n.lower() for n in listed]
                except Exception:  # whatever a broken archive does to its reader: it has no directory
                    pass
            names.append(found)
            kinds.append(kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.list_(pa.string())), pa.array(kinds, pa.string())], [*batch.schema.names, "__names", "__mime"])


def _kind(family: str | Column, type_: str | Column, macros: bool | Column = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(family).alias("family"), lit(type_).alias("type"), lit(macros).alias("macros"))


def _zip_kind(names: Column, mime: Column) -> Column:
    has, some = (lambda n: F.array_contains(names, n)), (lambda p: F.exists(names, lambda n: n.rlike(p)))
    office = F.coalesce(*[F.when(some(f"^{folder}"), kind) for folder, kind in OFFICE_FOLDERS])
    return (
        F.when(names.isNull(), _kind("other", "broken-zip")).when(some(r"^index/.*\.iwa$"), _kind("other", "iwork"))
        .when(has("androidmanifest.xml") & has("classes.dex"), _kind("executable", "apk")).when(has("meta-inf/manifest.mf") | some(r"\.class$"), _kind("executable", "jar"))
        .when(mime.isin(list(OPEN_DOCUMENTS)), _kind("document", F.coalesce(*[F.when(mime == m, k) for m, k in OPEN_DOCUMENTS.items()])))
        .when(has("[content_types].xml") & office.isNotNull(), _kind("document", office, some(r"vbaproject\.bin$"))).otherwise(_kind("archive", "zip"))
    )


def _headers(head: Column) -> Column:
    """Whether a head (Latin-1, \\n) begins with a letter's header: fields only, one that only letters have or three known ones."""
    block = F.lower(F.split_part(head, F.lit("\n\n"), F.lit(1)))
    lines = F.filter(F.split(block, "\n"), lambda x: (x != "") & ~x.rlike("^[ \t]"))
    cut = ~F.contains(head, F.lit("\n\n")) & (F.regexp_count(block, F.lit("\n")) > 3) & (F.size(lines) > 1)  # the last line may go on
    whole = F.when(cut, F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)

    def judged(lines: Column) -> Column:
        fields = (F.size(lines) > 0) & F.forall(F.slice(lines, 1, 8), lambda x: x.rlike("^[!-9;-~]+:"))
        named = F.array_distinct(F.transform(lines, lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
        return fields & (F.arrays_overlap(named, F.array(*map(F.lit, MAIL_ONLY))) | (F.size(F.array_intersect(named, F.array(*map(F.lit, MAIL_FIELDS)))) >= 3))

    return T.bound(whole, judged)


def _mail(head: Column, long_head: Column, extension: Column) -> Column:
    """By the first bytes; where they hold nothing but fields (a long list of recipients) by more of them."""
    flat, long_flat = F.replace(head, F.lit("\r\n"), F.lit("\n")), F.replace(long_head, F.lit("\r\n"), F.lit("\n"))
    lines = F.filter(F.split(F.lower(flat), "\n"), lambda x: (x != "") & ~x.rlike("^[ \t]"))
    begun = (
        ~F.contains(flat, F.lit("\n\n")) & (F.size(lines) > 0) & F.forall(F.slice(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), 1, 8), lambda x: x.rlike("^[!-9;-~]+:"))
        & F.exists(lines, lambda x: x.rlike(f"^(?:{'|'.join(MAIL_FIELDS)}):"))
    )
    more = (F.char_length(long_head) > F.char_length(head)) & _headers(long_flat)
    return _headers(flat) | begun & (more | (extension == "eml") & ~F.contains(long_flat, F.lit("\n\n")))


def _is_text(content: Column, head: Column) -> Column:
    """The first bytes as text (null if they aren't): UTF-16 after its mark, else without zero bytes and with few control characters."""
    wide = head.startswith("\xff\xfe") | head.startswith("\xfe\xff")
    first = F.substring(content, 1, HEAD)
    few = lambda t: F.regexp_count(t, F.lit(r"[\x01-\x08\x0b\x0e-\x1a\x1c-\x1f]")) <= F.floor(F.char_length(t) / 200)
    wide_text = F.decode(first, "UTF-16")
    narrow = F.regexp_replace(F.try_validate_utf8(first), "^﻿", "")
    # A head that's cut within a character isn't valid as a whole: up to three bytes off its end still are the same text.
    shorter = [F.try_validate_utf8(F.substring(first, F.lit(1), F.octet_length(first) - k)) for k in (1, 2, 3)]
    plain = F.coalesce(narrow, *[F.when(F.octet_length(first) == HEAD, x) for x in shorter], head)
    return F.when(wide, wide_text).when(~F.contains(head, F.lit("\0")) & few(plain), plain)


def kinds(files: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """files with kind: struct<family, type, macros>. A null or empty content is `other`, `empty`; a null name has no extension.

    Families: document, image, mail, text, archive, executable, other. Containers of old Office formats aren't taken apart.
    """
    ship_package(files.sparkSession)
    row = files.withColumn("__row", F.struct("*")).select("__row", F.coalesce(F.col(f"`{name_col}`"), F.lit("")).alias("__name"), F.col(f"`{content_col}`").alias("content"))
    schema = f"__row {row.schema['__row'].dataType.simpleString()}, __name string, content binary, __names array<string>, __mime string"
    zips = F.coalesce(F.substring("content", 1, 2) == F.lit(b"PK"), F.lit(False))
    none = row.where(~zips).select("*", F.lit(None).cast("array<string>").alias("__names"), F.lit(None).cast("string").alias("__mime"))
    both = row.where(zips).mapInArrow(_zip_rows, schema).unionByName(none)
    latin = lambda n: F.decode(F.substring("content", 1, n), "ISO-8859-1")
    given = both.withColumn("__head", latin(HEAD)).withColumn("__ext", F.regexp_replace(T.extension(F.col("__name")), r"^\.", ""))
    return given.select("__row.*", kind_of(F.col("content"), F.col("__head"), latin(LONG_HEAD), F.col("__ext"), F.col("__names"), F.col("__mime")).alias("kind"))


def kind_of(content: Column, head: Column, long_head: Column, extension: Column, names: Column, mime: Column) -> Column:
    zipped = F.coalesce(*[F.when(head.startswith(z), True) for z in ZIPS], F.lit(False))
    inside = _zip_kind(names, mime)
    named = F.when(head.startswith("PK"), T.bound(inside, lambda k: F.when(k["family"] == "executable", k).otherwise(_kind("executable", "by-extension")))).otherwise(_kind("executable", "by-extension"))
    office = {e: t for t in OFFICE for e in EXTENSIONS[t]}
    torn = F.coalesce(*[F.when(extension == e, t) for e, t in office.items()])
    container = T.bound(inside, lambda k: F.when((k["type"] == "broken-zip") & torn.isNotNull(), _kind("document", torn)).otherwise(k))
    rules = F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, _kind("other", "empty"))
    rules = rules.when(head.startswith(SIDECAR) & F.contains(F.substring(head, 1, 32), F.lit("Mac OS X")), _kind("other", "macos-sidecar"))
    rules = rules.when(head.startswith("MZ") & F.contains(F.substring(head, 1, 256), F.lit("\0")), _kind("executable", "pe"))
    for kind, magic in PROGRAMS:
        rules = rules.when(head.startswith(magic), _kind("executable", kind))
    rules = rules.when(extension.isin(EXECUTABLE), named).when(zipped, container).when(head.startswith(OLE), _kind("other", "ole"))
    for kind, magic in CONTAINERS:
        rules = rules.when(head.startswith(magic), _kind("archive", kind))
    rules = rules.when((F.octet_length(content) > 262) & (F.substring(head, 258, 5) == "ustar"), _kind("archive", "tar"))
    for family, kind, magic in DOCUMENTS:
        rules = rules.when(head.startswith(magic), _kind(family, kind))

    def of_text(t: Column) -> Column:
        start = F.regexp_replace(t, "^[﻿ \t\r\n]+", "")
        page = F.lower(F.substring(start, 1, 15)).rlike("^(?:<!doctype html|<html)")
        return (
            F.when(t.isNull(), _kind("other", "binary")).when(start.startswith("#!"), _kind("executable", "script")).when(page, _kind("document", "html"))
            .when(_mail(head, long_head, extension), _kind("mail", "eml")).otherwise(_kind("text", F.when(extension.isin(TEXTS), extension).otherwise("txt")))
        )

    return rules.otherwise(T.bound(_is_text(content, head), of_text))
