"""Free text: the identifier's own reading where it is sure, else whole pages, with their dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.functions import dates
from docgrid.functions import text as T
from docgrid.operators import rows


def read_text(mode: Column, line: Column, primary: Column, enhanced: Column, order: str = "auto") -> Column:
    """Struct of raw_text, dates (see ``dates.scanned``), fast (whether the line's reading was taken; null unless the
    mode is ``identifier``), reason (why not) and confidence. Readings are arrays of box, text, confidence; nulls are empty.

    The line counts only where it is one sure identifier. Else the primary reading does, or, if that shows nothing, the
    enhanced one; readings are never mixed. Branches that a row does not take are not evaluated for it."""
    some = lambda c: F.exists(F.coalesce(c, F.array()), lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")

    def chosen(d: Column) -> Column:
        text = F.when(F.coalesce(d["accepted"], F.lit(False)), rows.reading_text(line)).when(some(primary), rows.reading_text(primary)).otherwise(rows.reading_text(enhanced))
        return T.let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("raw_text"), dates.scanned(t, order)["dates"].alias("dates"), d["accepted"].alias("fast"), d["reason"].alias("reason"), d["confidence"].alias("confidence")))

    return T.let(F.when(mode == "identifier", T.line_decision(line)), chosen)
