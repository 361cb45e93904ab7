"""Text as column expressions: white space, paragraphs, sections, chunks, snippets, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CHUNK_CHARS, FILE_TYPES, MIME, MIME_DEFAULT

#: A heading of level 1 to 3. Only a line feed ends a line, white space is Unicode's.
HEADING = r"(?mdU)^(#{1,3})\s+(.+)"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def snippet(text: Column, n: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def paragraphs(text: Column) -> Column:
    """The non-blank paragraphs between blank lines, stripped."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")


def pack(parts: Column, most: int = CHUNK_CHARS) -> Column:
    """Paragraphs joined greedily by blank lines while the result has ``most`` characters; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, p: Column) -> Column:
        full = F.length(s["open"]) + 2 + F.length(p) > most
        return F.struct(
            F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"),
            F.when(s["open"].isNull() | full, p).otherwise(F.concat(s["open"], F.lit("\n\n"), p)).alias("open"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def sections(body: Column) -> Column:
    """The text before the first heading, and each heading with what follows it up to the next, unstripped."""
    # \u0001 marks a heading; where a text has it (or the escape) it is escaped meanwhile
    safe = F.replace(F.replace(body, F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    cut = F.split(F.regexp_replace(safe, HEADING, "\u0001$0"), "\u0001")
    return F.transform(cut, lambda s: F.replace(F.replace(s, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002")))


def section_chunks(body: Column, most: int = CHUNK_CHARS) -> Column:
    """Chunks (text, heading) of a note's body, in order.

    A section up to ``most`` characters is a chunk. A longer one is packed by paragraphs; its heading line goes before the
    first part only, and counts for nothing in packing.
    """

    def chunk(text: Column, heading: Column) -> Column:
        return F.struct(text.alias("text"), heading.alias("heading"))

    none = F.lit(None).cast("string")

    def headed(raw: Column) -> Column:
        line = F.regexp_extract(raw, HEADING, 0)
        title = strip(F.regexp_extract(raw, HEADING, 2))
        parts = pack(paragraphs(strip(F.substr(raw, F.length(line) + 1))), most)
        longer = F.transform(parts, lambda p, i: chunk(F.when(i == 0, F.concat(line, F.lit("\n"), p)).otherwise(p), title))
        longer = F.when(F.size(parts) > 0, longer).otherwise(F.array(chunk(line, title)))
        return F.when(F.length(strip(raw)) <= most, F.array(chunk(strip(raw), title))).otherwise(longer)

    def plain(raw: Column) -> Column:
        text = strip(raw)
        return F.when(F.length(text) <= most, F.array(chunk(text, none))).otherwise(F.transform(pack(paragraphs(text), most), lambda p: chunk(p, none)))

    made = F.transform(sections(body), lambda raw, i: F.when(strip(raw) == "", F.array().cast("array<struct<text:string,heading:string>>")).when(i == 0, plain(raw)).otherwise(headed(raw)))
    return F.flatten(made)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)$", 1))


def file_type(ext: Column) -> Column:
    """The type of an extension, null for those that are not taken."""
    out = F.lit(None).cast("string")
    for name, exts in FILE_TYPES.items():
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    defaults = F.create_map(*[F.lit(x) for pair in MIME_DEFAULT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.try_element_at(defaults, file_type(ext)))


def hidden(rel_path: Column) -> Column:
    """Whether any part of the path starts with a dot."""
    return F.exists(F.split(rel_path, "/"), lambda p: p.startswith("."))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::chunk_"), index.cast("string"))
