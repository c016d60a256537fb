"""Reports as a declared list of sections, a long frame, and ordered text.

A section names its rows' key, and a number or a text; the long frame is
(section_no, section, ord, key, value, text). The text sink deals the lines out by ranges of their order, so
part files in the order of their names are the report, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """``rows`` with a column ``key`` and the column ``value`` (a number, shown to ``places``) or ``text``; ``ord``: a column that orders them before the key."""
    name: str
    rows: DataFrame
    key: str
    value: str | None = None
    text: str | None = None
    ord: str | None = None
    places: int = 4

    def long(self, number: int) -> DataFrame:
        return self.rows.select(
            F.lit(number).cast("long").alias("section_no"), F.lit(self.name).alias("section"),
            (F.col(self.ord) if self.ord else F.lit(0)).cast("long").alias("ord"), F.col(self.key).cast("string").alias("key"),
            (F.col(self.value) if self.value else F.lit(None)).cast("double").alias("value"),
            (F.col(self.text) if self.text else F.lit(None)).cast("string").alias("text"))


def facts(name: str, row: DataFrame, names: dict, places: int = 4) -> Section:
    """A section from one row: ``names`` maps its columns, in order, to keys."""
    entries = F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(key).alias("_key"), F.col(c).cast("double").alias("_value"))
                        for i, (c, key) in enumerate(names.items())])
    return Section(name, row.select(F.inline(entries)), "_key", "_value", ord="_ord", places=places)


def report(sections: list[Section]) -> DataFrame:
    """The sections, numbered from 1, as one long frame."""
    out = sections[0].long(1)
    for i, s in enumerate(sections[1:], 2):
        out = out.unionByName(s.long(i))
    return out


def line(places: dict[int, int] | None = None) -> Column:
    """``section | key | what it says``; ``places``: digits after the point by section number, else 4."""
    shown = F.format_number("value", 4)
    for number, digits in (places or {}).items():
        shown = F.when(F.col("section_no") == number, F.format_number("value", digits)).otherwise(shown)
    return F.concat_ws(" | ", "section", "key", F.coalesce("text", shown))


def render(sections: list[Section], path: str, parts: int | None = None) -> None:
    """Write the report as text lines in order: by section, ``ord`` and key."""
    order = ["section_no", "ord", "key"]
    frame = report(sections)
    ranged = frame.repartitionByRange(parts, *order) if parts else frame.repartitionByRange(*order)
    places = {i: s.places for i, s in enumerate(sections, 1)}
    ranged.sortWithinPartitions(*order).select(line(places).alias("value")).write.mode("overwrite").text(path)
