"""Code lines and evidence of scripts as DataFrame operations; script.code_lines() and evidence() are the same for one text.

Whether a line lies in a block comment depends on the last line before it that
opens or closes one and on no other, so it is a window's last value; no state
is carried through rows of Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .paths import BLANK
from .script import BATCH, KIXTART, POWERSHELL, SIGNALS, VBSCRIPT
from .text import EVIDENCE_LINES, lines_column

_NOT_CODE = {
    BATCH: r"(?i)^@*\s*(?:rem(?:[ \t]|$)|::|echo(?:[ .\t]|$))",
    KIXTART: r"^;",
    VBSCRIPT: r"(?i)^(?:'|rem(?: |$))",
    POWERSHELL: r"^#",
}


def numbered_lines(files: DataFrame, key: list[str]) -> DataFrame:
    """files (key, language, text) -> key, language, number from 1, line."""
    each = F.posexplode(lines_column(F.coalesce("text", F.lit("")))).alias("number", "line")
    return files.select(*key, "language", each).withColumn("number", F.col("number") + 1)


def code_lines(files: DataFrame, key: list[str]) -> DataFrame:
    """Lines without blank ones, comments and what a batch file only prints: key, language, number, line.

    Key names a file; a file of any language but those of script.py has none.
    """
    lines = numbered_lines(files, key).withColumn("bare", F.trim("line", F.lit(BLANK)))
    powershell = F.col("language") == POWERSHELL
    opens, closes = F.col("bare").startswith("<#"), F.col("bare").contains("#>")
    event = F.when(powershell & closes, F.lit(False)).when(powershell & opens, F.lit(True))
    before = W.partitionBy(*key).orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    marked = lines.withColumn("event", event).withColumn("inside", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False)))
    code = F.lit(False)
    for language, pattern in _NOT_CODE.items():
        code |= (F.col("language") == language) & ~F.col("bare").rlike(pattern)
    return marked.where((F.col("bare") != "") & ~F.col("inside") & ~(powershell & opens) & code).select(*key, "language", "number", "line")


def telling(line) -> Column:
    """Lines that show what a script does."""
    c = F.lower(F.col(line) if isinstance(line, str) else line)
    out = F.lit(False)
    for s in SIGNALS:
        out |= c.contains(s)
    return out


def evidence(code: DataFrame, key: list[str], most: int = EVIDENCE_LINES) -> DataFrame:
    """Of each file's code lines the first telling ones, then the first others, `most` in all."""
    order = W.partitionBy(*key).orderBy(telling("line").desc(), "number")
    return code.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")
