"""Failures of the report engine: each has a kind, a message, a hint and its own fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class ReportError(Exception):
    """Base of all failures; ``kind`` names the class in status tables."""

    kind = "report_error"
    hint: str | None = None

    def __init__(self, message: str, **fields):
        super().__init__(message)
        self.message, self.fields = message, fields

    def as_row(self) -> dict:
        return {"kind": self.kind, "message": self.message, "hint": self.hint, "fields": {k: str(v) for k, v in self.fields.items()}}


# The kinds, messages and hints below are what status tables and logs must show.


def _basename(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _caused(message: str, cause) -> str:
    return f"{message} {cause}" if cause is not None and str(cause) else message


class BookmarkMissing(ReportError):
    kind = "bookmark_missing"
    hint = "Check that the bookmark name in the config table matches exactly (case-sensitive) the bookmark in the Word file."

    def __init__(self, name: str):
        super().__init__(f"Bookmark '{name}' not found in the Word document.", bookmark=name)


class BookmarkBadContext(ReportError):
    kind = "bookmark_bad_context"
    hint = "Move the bookmark to the document body (not inside any table, header, footer, or text box)."
    places = {"table": "inside a table cell", "header": "in a page header", "footer": "in a page footer", "textbox": "inside a text box"}

    def __init__(self, name: str, context: str):
        where = self.places.get(context, f"in an unsupported location ({context})")
        super().__init__(f"Bookmark '{name}' is {where}. Injecting a table or image here will produce invalid output.", bookmark=name, context=context)


class BookmarkDuplicate(ReportError):
    kind = "bookmark_duplicate"
    hint = "Each bookmark should appear in at most one config row. Remove or rename the duplicate entries."

    def __init__(self, name: str, rows: Iterable[int]):
        listed = ", ".join(map(str, rows))
        super().__init__(f"Bookmark '{name}' is mapped in multiple rows: {listed}.", bookmark=name, rows=listed)


class RtfUnreadable(ReportError):
    kind = "rtf_unreadable"
    hint = "Check that the file exists, is not open in another application, and is a valid RTF file."

    def __init__(self, path: str, cause=None):
        super().__init__(_caused(f"Cannot read RTF file '{_basename(path)}'.", cause), path=path)


class RtfParseFailed(ReportError):
    kind = "rtf_parse_failed"
    hint = "The RTF file may be malformed or use unsupported SAS ODS features. Try opening it in a text editor to inspect the structure."

    def __init__(self, path: str, stage: str, cause=None):
        super().__init__(_caused(f"Failed to parse RTF file '{_basename(path)}' (stage: {stage}).", cause), path=path, stage=stage)


class ImageExtractFailed(ReportError):
    kind = "image_extract_failed"
    hint = "Check that the RTF contains a valid embedded PNG image (\\pngblip). WMF and EMF formats are not supported."

    def __init__(self, path: str, cause=None):
        super().__init__(_caused(f"Could not extract image from RTF file '{_basename(path)}'.", cause), path=path)


class XmlInjectFailed(ReportError):
    kind = "xml_inject_failed"
    hint = "The generated Word XML may be malformed. Check that the RTF table structure is valid and re-run validation."

    def __init__(self, bookmark: str, cause=None):
        super().__init__(_caused(f"Failed to inject table at bookmark '{bookmark}'.", cause), bookmark=bookmark)


class ImageInjectFailed(ReportError):
    kind = "image_inject_failed"
    hint = "Check that the Word document is not password-protected and that the bookmark context is valid."

    def __init__(self, bookmark: str, cause=None):
        super().__init__(_caused(f"Failed to inject image at bookmark '{bookmark}'.", cause), bookmark=bookmark)


class ExclusionOutOfRange(ReportError):
    kind = "exclusion_out_of_range"
    hint = "Re-open the table preview and re-apply column exclusions. The table structure may have changed since the config was last saved."

    def __init__(self, bookmark: str, indices: Iterable[int], max_col: int):
        listed = ", ".join(map(str, indices))
        plural = "" if max_col == 1 else "s"
        super().__init__(
            f"Excluded column index {listed} is out of range for bookmark '{bookmark}' (table has {max_col} column{plural}).",
            bookmark=bookmark, indices=listed, max_col=max_col,
        )


def hint_of(error: BaseException) -> str | None:
    return error.hint if isinstance(error, ReportError) else None


def formatted(error: BaseException) -> str:
    """The message, and the hint on a line of its own."""
    hint = hint_of(error)
    return f"{error}\nHint: {hint}" if hint is not None else str(error)


def formatted_column(message: Column, hint: Column) -> Column:
    return F.concat_ws("\nHint: ", message, hint)
