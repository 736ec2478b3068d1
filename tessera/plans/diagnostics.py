"""Diagnostics as rows: (subject, severity, code, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Suppressed:
    """Codes that are not to be told; ``all`` stands for every warning."""

    def __init__(self, codes: list[str] | str):
        self.codes = [c.upper() for c in (codes.replace(",", " ").split() if isinstance(codes, str) else codes)]

    def warnings(self, found: DataFrame) -> DataFrame:
        """Each distinct warning once, without suppressed ones."""
        left = F.lit(False) if "ALL" in self.codes else ~F.col("code").isin(self.codes)
        return found.where((F.col("severity") != "warning") | left).dropDuplicates()

    def downgrade(self, found: DataFrame, where: Column | None = None) -> DataFrame:
        """Errors of suppressed codes become warnings."""
        hit = F.col("code").isin(self.codes) & (F.lit(True) if where is None else where)
        return found.withColumn("severity", F.when(hit, "warning").otherwise(F.col("severity")))


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files (subject, path) that the listing (path) lacks."""
    gone = files.join(listing.select("path").distinct(), "path", "left_anti")
    return gone.select("subject", F.lit("error").alias("severity"), F.lit("E31").alias("code"), F.concat(F.lit("no such file: "), "path").alias("message"))


def rendered(severity: Column, code: Column, message: Column, causes: Column, help_text: Column) -> Column:
    """A diagnostic as plain text: its heading, then its causes and the lines of its help as a tree."""
    lines = F.when(F.coalesce(help_text, F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(help_text, r"\r?\n\z", ""), r"\r?\n"))
    notes = F.concat(F.transform(F.coalesce(causes, F.expr("cast(array() as array<string>)")), lambda x: F.concat(F.lit("caused by: "), x)), F.transform(lines, lambda x: F.concat(F.lit("help: "), x)))
    tree = F.transform(notes, lambda x, i: F.concat(F.when(i == F.size(notes) - 1, "\n ╰─› ").otherwise("\n ├─› "), x))
    return F.concat(severity, F.when(code.isNotNull(), F.concat(F.lit("["), code, F.lit("]"))).otherwise(""), F.lit(": "), message, F.array_join(tree, ""))
