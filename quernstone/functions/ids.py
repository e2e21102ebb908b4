"""Identity and hashing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of URLs, RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL name space; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def stable_id(*parts: Column | str) -> Column:
    """uuid5 of the parts joined by colons. A null part gives null: an id must not silently drop one."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = columns[0].cast("string")
    for c in columns[1:]:
        text = F.concat(text, F.lit(":"), c.cast("string"))
    return uuid5(text)


def document_id(domain: Column, source_type: Column, location: Column) -> Column:
    """Of a source file or address; only the location ignores letter case."""
    return stable_id(domain, source_type, F.lower(location))


def chunk_fingerprint(retrieval_text: Column, image_paths: Column) -> Column:
    """SHA-256 of what makes two chunks the same: text without case, and the set-like list of images."""
    return F.sha2(F.concat_ws("\n", F.lower(retrieval_text), F.lit("Images:"), F.array_sort(image_paths)), 256)


def content_hash(clean: Column) -> Column:
    return F.sha2(F.lower(clean), 256)


def embedding_input_hash(text: Column, images: Column, version: str) -> Column:
    """SHA-256 over version, text, and path and file digest of each image in order. images: ARRAY<STRUCT<path, sha256>>."""
    return F.sha2(F.concat(F.lit(version), text, F.array_join(F.transform(images, lambda i: F.concat(i["path"], i["sha256"])), "")), 256)


def file_digests(files):
    """(path, sha256) of a ``binaryFile`` frame."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


PARSER_PACKAGES: dict[str, str] = {}


def parser_version(parser: str, packages: dict[str, str] | None = None) -> str | None:
    """Version of the installed package behind a parser's name, null if there is none."""
    from importlib import metadata

    try:
        return metadata.version((packages or PARSER_PACKAGES).get(parser, parser))
    except metadata.PackageNotFoundError:
        return None


def relative_path(path: Column, root: str) -> Column:
    """A path below a root without it, with forward slashes; null for a path outside."""
    clean, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(base)), F.substring(clean, len(base) + 1, 1 << 30))
