"""Order-dependent folds as higher-order functions: segmentation, table text, cell repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK_EDGE, strip

_STRINGS = "array<string>"


def split_text(c: Column, size: int = 800, overlap: int = 120, least: int = 30) -> Column:
    """Chunks of a text: lines packed up to ``size``, a full chunk's last ``overlap`` characters opening the next.

    A line longer than size is cut at a stride of size - overlap; its rest is packed on. Chunks of
    ``least`` characters or fewer go. A chunk may reach size + overlap + 1.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")
    stride = size - overlap
    zero = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        flushed = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        count = F.greatest(F.ceil((F.length(line) - size) / stride).cast("int"), F.lit(1))
        cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(line, i * stride + 1, F.lit(size)))
        rest = F.substr(line, count * stride + 1, F.lit(size))
        fits = F.length(acc["cur"]) + F.length(line) + 1 <= size
        return (
            F.when(F.length(line) > size, F.struct(F.concat(flushed, cuts).alias("out"), rest.alias("cur")))
            .when(fits, F.struct(acc["out"].alias("out"), F.when(acc["cur"] == "", line).otherwise(F.concat(acc["cur"], F.lit("\n"), line)).alias("cur")))
            .otherwise(
                F.struct(
                    flushed.alias("out"),
                    F.when((F.length(acc["cur"]) > 0) & F.lit(overlap > 0), F.concat(F.right(acc["cur"], F.lit(overlap)), F.lit("\n"), line)).otherwise(line).alias("cur"),
                )
            )
        )

    def close(acc: Column) -> Column:
        done = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        return F.filter(F.transform(done, strip), lambda x: F.length(x) > least)

    return F.aggregate(lines, zero, step, close)


def row_text(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "-").otherwise(x)), " | ")


def table_to_text(title: Column, rows: Column) -> Column:
    """A title line if there is one, then a line for each row with cells between bars, blanks as dashes."""
    body = F.transform(rows, row_text)
    return F.array_join(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.array(title), body)).otherwise(body), "\n")


def split_table_rows(title: Column, rows: Column, size: int = 800, least: int = 40) -> Column:
    """Texts of a table's parts; each repeats title and header, and a part with a row is closed before it outgrows size."""
    header = F.slice(rows, 1, 1)
    zero = F.struct(F.array().cast("array<array<array<string>>>").alias("out"), F.array().cast("array<array<string>>").alias("cur"))

    def step(acc: Column, row: Column) -> Column:
        longer = F.concat(acc["cur"], F.array(row))
        over = (F.length(table_to_text(title, F.concat(header, longer))) > size) & (F.size(acc["cur"]) > 0)
        return F.when(over, F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), F.array(row).alias("cur"))).otherwise(
            F.struct(acc["out"].alias("out"), longer.alias("cur"))
        )

    def close(acc: Column) -> Column:
        return F.when((F.size(acc["cur"]) > 0) | (F.size(acc["out"]) == 0), F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    parts = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), zero, step, close)
    return F.filter(F.transform(parts, lambda p: table_to_text(title, F.concat(header, p))), lambda t: F.length(t) > least)


def cell_join(parts: Column) -> Column:
    """Lines of a wrapped cell as one: no space where either side is CJK, else one."""
    rows = F.filter(F.transform(parts, strip), lambda x: x != "")

    def step(acc: Column, part: Column) -> Column:
        tight = F.rlike(acc, F.lit(f"[{CJK_EDGE}]$")) | F.rlike(part, F.lit(f"^[{CJK_EDGE}]"))
        return F.when(acc == "", part).when(tight, F.concat(acc, part)).otherwise(F.concat(acc, F.lit(" "), part))

    return F.aggregate(rows, F.lit(""), step)


def clean_cell(c: Column) -> Column:
    return cell_join(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("　"), F.lit(" ")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"))


def keep_table(rows: Column) -> Column:
    """Rows with a cell that isn't blank; null unless two rows and two columns are left."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    wide = F.coalesce(F.array_max(F.transform(kept, F.size)), F.lit(0))
    return F.when((F.size(kept) >= 2) & (wide >= 2), kept)
