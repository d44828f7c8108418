"""Path and text expressions over columns. Paths may be POSIX or Windows text; nothing here touches a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the audit contract excludes and recognises.
EXCLUDED_COMPONENTS = (".seekmeta", ".seektrash", "_extracted_workflows", "_test_20260728", "_organized_v2", "_系统", "test", "tests")
TEMPORARY_SUFFIXES = (".tmp", ".part", ".partial", ".crdownload", ".download", ".incomplete")
POSTED_BUCKETS = ("已发帖", "posted", "published")
IMAGE_SUFFIXES = (".avif", ".bmp", ".gif", ".heic", ".heif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
POSTED_STATE, PENDING_STATE, UNSORTED = "已发帖", "待复核", "待分拣"
NO_ENTITY, NO_SUBJECT, NO_ENGINE = ("_未归档", "未识别"), ("未识别", "待分类"), ("other", "未知模型")
HELPER_FOLDERS = ("_json", "_txt", "_hitl", "json", "txt")
NESTED_MODELS = ("krea2_turbo", "grok imagine")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: str | Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def first_filled(*columns: str | Column) -> Column:
    """The first value that isn't blank, stripped; null if all are."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def alias_column(names: Sequence[str], *aliases: str) -> Column:
    """first_filled over the columns that carry one of the aliases, whatever their case."""
    by_name = {n.lower(): n for n in names}
    found = [F.col(f"`{by_name[a.lower()]}`").cast("string") for a in aliases if a.lower() in by_name]
    return first_filled(*found) if found else F.lit(None).cast("string")


def casefold(c: str | Column) -> Column:
    """Case folding in the JVM: upper then lower case, so that "STRASSE" and "Straße" are one; a dotless i stays itself."""
    return F.lower(F.translate(F.upper(F.translate(col(c), "ı", "\ue000")), "\ue000", "ı"))


def slashed(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[\\/]+", "/")


def components(c: str | Column) -> Column:
    return F.split(slashed(c), "/")


def portable_name(c: str | Column) -> Column:
    """The last component of POSIX or Windows text."""
    return F.element_at(components(c), -1)


def suffix(c: str | Column) -> Column:
    """The file name's suffix in lower case; names like ".png" have none."""
    return F.lower(F.regexp_extract(portable_name(c), r".(\.[^.]+)$", 1))


def stem(c: str | Column) -> Column:
    name = portable_name(c)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(c)))


def is_image(c: str | Column) -> Column:
    return suffix(c).isin(*IMAGE_SUFFIXES)


def is_excluded(c: str | Column, excluded: Sequence[str] = EXCLUDED_COMPONENTS) -> Column:
    """An excluded component anywhere, a lock file or a temporary suffix."""
    name = casefold(portable_name(c))
    temporary = F.lit(False)
    for s in TEMPORARY_SUFFIXES:
        temporary = temporary | name.endswith(s)
    return F.arrays_overlap(F.transform(components(c), casefold), F.array(*(F.lit(x.casefold()) for x in excluded))) | name.startswith("~$") | temporary


def valid_sha256(c: str | Column) -> Column:
    """The digest in lower case if it is one, else null."""
    return F.when(col(c).rlike("^[0-9a-fA-F]{64}$"), F.lower(col(c)))


def integer_or_null(c: str | Column) -> Column:
    return strip(c).try_cast("bigint")


def occurrence_id(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def is_posted(bucket: str | Column) -> Column:
    return F.coalesce(casefold(bucket).isin(*POSTED_BUCKETS), F.lit(False))


def safe_component(c: str | Column, fallback: str) -> Column:
    """One Windows-safe path component of at most 120 characters."""
    text = F.coalesce(blank_to_null(c), F.lit(fallback))
    text = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = F.substring(F.regexp_replace(text, r"[. ]+$", ""), 1, 120)
    return F.when(text != "", text).otherwise(fallback)


def relative(path: str | Column, root: str) -> Column:
    """The path below root; null outside it, empty for root itself."""
    root = root.rstrip("/")
    p = col(path)
    return F.when(p == root, "").when(p.startswith(root + "/"), F.substring(p, F.lit(len(root) + 2), F.length(p)))


def source_directory(path: str | Column, root: str) -> Column:
    """The first component below root."""
    below = relative(path, root)
    return F.when(below.isNull(), "(outside-root)").when(below == "", "(root)").otherwise(F.split(below, "/")[0])


def feature_root(path: str | Column) -> Column:
    """The prefix up to the first component "output", else the parent."""
    parts = F.split(col(path), "/")
    at = F.array_position(F.transform(parts, F.lower), "output").cast("int")
    return F.array_join(F.slice(parts, F.lit(1), F.when(at > 0, at).otherwise(F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def nested_context(path: str | Column, root: str, entity: str | Column, subject: str | Column, engine: str | Column) -> Column:
    """struct(entity, subject, engine): gaps filled from the folders of the export trees that nest them."""
    below = relative(path, root)
    parts = F.split(below, "/")
    model = parts[0]

    def meaningful(part: Column) -> Column:
        low = F.lower(part)
        return ~(low.isin(*HELPER_FOLDERS) | low.startswith("p1-") | part.rlike(r"^(\d{2}|\d{4})$"))

    folders = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), meaningful)
    applies = F.coalesce((F.length(below) > 0) & F.lower(model).isin(*NESTED_MODELS), F.lit(False))

    def filled(value: Column, empty: Sequence[str], other: Column) -> Column:
        lacks = F.coalesce((value == "") | value.isin(*empty), F.lit(True))
        return F.when(applies & lacks, F.coalesce(other, value)).otherwise(value)

    return F.struct(
        filled(col(entity), NO_ENTITY, F.get(folders, F.lit(0))).alias("entity"),
        filled(col(subject), NO_SUBJECT, F.get(folders, F.lit(1))).alias("subject"),
        filled(col(engine), NO_ENGINE, model).alias("engine"),
    )


def destination(path: str | Column, root: str, target: str, entity: str | Column, subject: str | Column, engine: str | Column, posted: Column, mtime_ns: str | Column) -> Column:
    """struct(path, state): where a source belongs in the sorted tree. Months are of the session's time zone; mtime_ns may be a decimal beyond a bigint."""
    state = F.when(posted, POSTED_STATE).otherwise(PENDING_STATE)
    moment = F.timestamp_micros(F.floor(col(mtime_ns).cast("decimal(38,0)") / 1000).cast("bigint"))
    year = F.year(moment)  # a pattern's year would have a sign beyond 9999
    month = F.concat(F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string")), F.lit("/"), F.date_format(moment, "MM"))
    maker, own = safe_component(engine, NO_ENGINE[1]), safe_component(stem(path), "image")
    name = F.when(F.lower(own).startswith(F.lower(maker)), portable_name(path)).otherwise(F.concat(maker, F.lit("__"), own, suffix(path)))
    ent, sub = F.coalesce(col(entity), F.lit("")), F.coalesce(col(subject), F.lit(""))
    unclassified = (ent == "") | ent.isin(*NO_ENTITY) | (sub == "") | sub.isin(*NO_SUBJECT)
    unsorted = F.concat_ws("/", F.lit(target), F.lit(UNSORTED), state, month, name)
    top = safe_component(ent, NO_ENTITY[0])
    placed = F.concat_ws("/", F.lit(target), top, safe_component(sub, NO_SUBJECT[0]), state, month, name)
    if target == root:  # never back into the directory that is being drained
        unclassified = unclassified | (F.lower(top) == F.lower(source_directory(path, root)))
    return F.struct(F.when(unclassified, unsorted).otherwise(placed).alias("path"), state.alias("state"))


def utc_text(c: str | Column) -> Column:
    """ISO text of a moment in UTC with six digits of a second, which sorts like the moment; times without a zone are taken as UTC."""
    return F.concat(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def in_order(rows: DataFrame, path: str = "source_path") -> DataFrame:
    """rows in the order that reports list paths: without case first, then as they are."""
    return rows.orderBy(casefold(path), path)
