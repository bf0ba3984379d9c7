"""Names of font binaries."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, n_names int, family string, variant string, postscript string, typographic_family string, typographic_variant string"
#: Of a name table, the identifiers of what is read.
NAMES = {1: "family", 2: "variant", 6: "postscript", 16: "typographic_family", 17: "typographic_variant"}


def name_table(font: bytes) -> tuple[int, dict[int, str]]:
    """The number of names of a TrueType or OpenType font, and the first text of each identifier; none for any other file."""
    if len(font) < 12 or font[:4] not in (b"\x00\x01\x00\x00", b"OTTO", b"true"):
        return 0, {}
    for k in range(struct.unpack_from(">H", font, 4)[0]):
        if len(font) < 28 + 16 * k:
            return 0, {}
        tag, _, at, size = struct.unpack_from(">4sIII", font, 12 + 16 * k)
        if tag == b"name" and size >= 6 and at + size <= len(font):
            _, n, texts = struct.unpack_from(">HHH", font, at)
            found = {}
            for i in range(min(n, (size - 6) // 12)):
                platform, _, _, ident, length, place = struct.unpack_from(">6H", font, at + 6 + 12 * i)
                raw = font[at + texts + place : at + texts + place + length]
                found.setdefault(ident, raw.decode("utf-16-be" if platform in (0, 3) else "mac-roman", "replace"))
            return n, found
    return 0, {}


def names(files: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for each font of ``files(path, content)``; one that can't be read has no names; S28."""

    def run(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"]):
                n, found = name_table(bytes(content) if content is not None else b"")
                out.append((path, n, *(found.get(i) for i in NAMES)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def layout_names() -> Column:
    """(family, variant, full name) as a layout program shows a font: typographic names where there are 18 names or more, and no Regular; P7, S28."""
    advanced = (F.col("n_names") >= 18) & (F.coalesce("typographic_family", F.lit("")) != "")
    family = F.when(advanced, F.col("typographic_family")).otherwise(F.col("family"))
    variant = F.coalesce(F.when(advanced, F.col("typographic_variant")).otherwise(F.col("variant")), F.lit(""))
    variant = F.when(variant == "Regular", "").otherwise(variant)
    return F.struct(family.alias("family"), variant.alias("variant"), F.concat(family, F.when(variant != "", F.concat(F.lit(" "), variant)).otherwise("")).alias("full_name"))
