"""Scalar expressions as column builders. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists decide results and have to be exactly so.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "heic", "heif", "psd")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v", "ts", "mp")
EXCLUDED_NAMES = (
    ".git", ".svn", "node_modules", "__pycache__", ".cache", "_duplicate_quarantine", "_dedupe_reports", "_logs", "_zips",
    ".vscode", ".idea", "$RECYCLE.BIN", "System Volume Information", ".venv", "venv",
)
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml",
    "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "mkv": "video/x-matroska", "pdf": "application/pdf", "csv": "text/csv", "sh": "application/x-sh",
}
TRASH_MARKS = ("/trash/", "/.trash", "/recycle", "$recycle.bin")
COPY_MARKS = (" - copy", "-copy", "_copy", "(copy)", " copy.", " copy ")
COPY_STARTS = ("copy ", "copy_", "copy of ")
STORE_SUFFIXES = (".db", ".db-wal", ".db-shm", ".db-journal")
MB = 1048576


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; '' for none and for names whose only dot leads."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_image(ext: Column) -> Column:
    return ext.isin(*IMAGE_EXTENSIONS)


def is_video(ext: Column) -> Column:
    return ext.isin(*VIDEO_EXTENSIONS)


def category(ext: Column) -> Column:
    return F.when(is_video(ext), "VIDEO").when(is_image(ext), "PHOTO").otherwise("FILE")


def is_excluded(path: Column, root: str = "") -> Column:
    """Whether an entry below the root has an excluded name; the root itself is not looked at."""
    parts = F.split(F.substr(path, F.lit(len(root) + 1)), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED_NAMES]))


def mime_type(ext: Column) -> Column:
    out = F.lit("application/octet-stream")
    for kind in dict.fromkeys(MIME_TYPES.values()):
        out = F.when(ext.isin(*[e for e, k in MIME_TYPES.items() if k == kind]), kind).otherwise(out)
    return out


def keeper_score(path: Column) -> Column:
    """100, less 500 in a trash folder, 25 for a copy's name, 50 for a thumbnail's, 10 for an edited file's."""
    whole, name = F.lower(F.translate(path, "\\", "/")), F.lower(file_name(path))
    trash = any_of([whole.contains(m) for m in TRASH_MARKS])
    copy = any_of([name.contains(m) for m in COPY_MARKS] + [name.startswith(m) for m in COPY_STARTS])
    less = lambda test, n: F.when(test, n).otherwise(0)
    return (F.lit(100) - less(trash, 500) - less(copy, 25) - less(name.contains("thumb"), 50) - less(name.contains("edited"), 10)).cast("long")


def path_order(path: Column) -> Column:
    """Sort key: paths compare component by component."""
    return F.split(path, "/")


def size_mb(size: Column) -> Column:
    return size.cast("double") / MB


def rounded(x: Column, digits: int) -> Column:
    """Half up, for numbers from 0."""
    return F.floor(x * 10**digits + 0.5).cast("double") / float(10**digits)


def bytes_of_mb(mb: Column) -> Column:
    return F.floor(mb * MB + 0.5).cast("long")


def similarity_label(score: Column) -> Column:
    return F.when(F.abs(score - 1) < 1e-4, "100%").otherwise(F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%")))


def progress_pct(done: Column, total: Column) -> Column:
    """Percent of a known total; of an unknown one a curve that ends at 85."""
    known = F.least(F.lit(100.0), done.cast("double") * 100 / F.when(total > 0, total))
    curve = F.least(F.lit(85.0), F.log10(F.when(done > 0, done.cast("double"))) * 18)
    return F.when(total > 0, known).when(done > 0, curve).otherwise(0.0).cast("int")


def is_relevant_path(path: Column, store_name: str = "tidemark.db") -> Column:
    store = any_of([path.endswith(s) for s in STORE_SUFFIXES]) | path.contains(store_name)
    return ~store & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in EXCLUDED_NAMES]))


def is_relevant_event(kind: Column, paths: Column) -> Column:
    """Not a read, and either without paths or with a relevant one."""
    return (kind != "access") & ((F.size(paths) == 0) | F.exists(paths, lambda p: is_relevant_path(p)))


def is_drive_root(path: Column) -> Column:
    """Roots that are watched without their sub-folders: /, and what stands directly in /mnt or /Volumes."""
    return path.rlike(r"^(/|/(mnt|Volumes)/[^/]+/?)$")


def csv_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def shell_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def with_thousands(n: Column) -> Column:
    """Digits in groups of three, with commas."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, the last three of a longer text as dots."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(max(0, most - 3))), F.lit("...")))


def _tenths(x: Column) -> Column:
    """A number of at least 1 with one decimal, its exact binary value rounded half to even as printf does; Java's formatter rounds its shortest decimal form, half up."""
    whole = F.floor(x)
    scaled = ((x - whole) * float(1 << 52)).cast("long") * 10  # exact: such a number has at most 52 bits below the point
    digit, rest = F.shiftrightunsigned(scaled, 52), scaled.bitwiseAND(F.lit((1 << 52) - 1))
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (digit % 2 == 1))
    digit = digit + up.cast("long")
    return F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def rate(done: Column, seconds: Column) -> Column:
    """Items a second; thousands as k."""
    r = done.cast("double") / F.greatest(seconds.cast("double"), F.lit(0.001))
    return F.when(r >= 1000, F.concat(_tenths(r / 1000), F.lit("k/s"))).otherwise(F.concat(F.bround(r, 0).cast("long").cast("string"), F.lit("/s")))


def clock(seconds: Column) -> Column:
    """Minutes and seconds, as 02:05."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)
