"""Windows paths as columns: the form in which they are compared, and what they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a path.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# the shortest beginning of three bytes or more
THREE_BYTES = r"(?:[\x00-\x7F]{2}.|[\x00-\x7F][^\x00-\x7F]|[\x{80}-\x{7FF}].|[\x{800}-\x{10FFFF}])"
SCRIPT_EXTENSIONS = ("vbs", "vbe", "wsf", "wsc", "hta")


def _col(path) -> Column:
    return F.col(path) if isinstance(path, str) else path


def normalize(path) -> Column:
    r"""Backslashes, lower case, without surrounding blanks and quotes, `\\?\` and trailing backslashes beyond `X:\`."""
    # the two patterns are rare, so they stand behind cheap tests
    p = F.translate(F.trim(F.trim(_col(path), F.lit(BLANK)), F.lit('"')), "/", "\\")
    p = F.when(p.startswith("\\\\?\\"), F.regexp_replace(p, r"^\\\\\?\\(?:UNC(\\))?", "$1$1")).otherwise(p)
    p = F.lower(p)
    return F.when(p.endswith("\\"), F.regexp_replace(p, rf"(?s)^({THREE_BYTES}.*?)\\+$", "$1")).otherwise(p)


def is_network(path) -> Column:
    return _col(path).startswith("\\\\")


def refusal(path) -> Column:
    r"""Why a path that an entry names isn't opened: networkPath, devicePath (`\\.\`, a volume) or relativePath; null for one of a local drive.

    Entries are followed on their own machine only, and never to what may block.
    """
    p = F.translate(_col(path), "/", "\\")
    drive = p.rlike(r"^(?:\\\\\?\\)?[A-Za-z]:\\")
    share = p.rlike(r"(?i)^\\\\(?:\?\\UNC\\)?(?![?.]\\)[^\\]+\\+[^\\]")
    return F.when(drive, F.lit(None)).when(share, "networkPath").when(p.startswith("\\\\"), "devicePath").otherwise("relativePath")


def is_absolute(path) -> Column:
    """A whole local or network path without variables."""
    p = _col(path)
    return (p.rlike(r"^[A-Za-z]:\\") | is_network(p)) & ~p.contains("%")


def file_name(path) -> Column:
    return F.substring_index(_col(path), "\\", -1)


def extension(path) -> Column:
    """What follows the last dot of the file name; null without one."""
    name = file_name(path)
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def is_script_file(path) -> Column:
    return F.coalesce(extension(path).isin(*SCRIPT_EXTENSIONS), F.lit(False))


def in_component_store(path) -> Column:
    return _col(path).contains("\\windows\\winsxs\\")


def is_windows_location(path) -> Column:
    """Places that hold only the operating system's own files."""
    p = _col(path)
    usage = p.contains("\\windows\\system32\\logfiles\\sum\\") & F.coalesce(extension(p) == "mdb", F.lit(False))
    # the first \windowsfilter\ counts: what follows its layer has to be the Windows folder
    layer = p.contains("\\windowsfilter\\") & F.regexp_extract(p, r"(?s)^.*?\\windowsfilter\\(.*)$", 1).rlike(r"^[^\\]*\\(utilityvm\\)?files\\windows\\")
    return in_component_store(p) | p.contains("\\windows\\servicing\\") | p.contains("\\windows\\softwaredistribution\\") | usage | layer
