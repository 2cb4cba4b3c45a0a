"""Column functions for cleaning and assembling item text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space plus the four ASCII separators.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
ELLIPSIS = "..."
TEXT_FIELDS = ("title", "brand", "categories", "description", "feature")
IMAGE_URL_FIELDS = ("imUrl", "imageURL", "imageURLHighRes")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: Column | str) -> Column:
    """Collapse white space runs to one blank and trim; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(_c(col), _BLANKS, " ")), F.lit(""))


def clean_text_list(col: Column | str) -> Column:
    """Join the non-empty elements of a string array with blanks, then clean."""
    return clean_text(F.array_join(F.filter(_c(col), lambda x: x != ""), " "))


def join_categories(col: Column | str) -> Column:
    """'A > B' from one category path (string array); empty elements are dropped."""
    return F.coalesce(F.array_join(F.filter(_c(col), lambda x: x != ""), " > "), F.lit(""))


def first_category_path(col: Column | str) -> Column:
    """'A > B' from the first path of a list of paths."""
    return join_categories(F.get(_c(col), F.lit(0)))


def truncate_text(col: Column | str, max_chars: int) -> Column:
    """Cut after ``max_chars`` characters, drop trailing white space and mark the cut."""
    text = _c(col)
    cut = F.regexp_replace(F.substring(text, 1, max_chars), r"(?U)[\s\x1c-\x1f]+\z", "")
    return F.when(F.length(text) > max_chars, F.concat(cut, F.lit(ELLIPSIS))).otherwise(text)


def item_text(fields: dict[str, Column], item_id: Column | str) -> Column:
    """'title: … ; brand: … ; …' over non-empty fields, or the item id when all are empty."""
    parts = [
        F.when(fields[name] != "", F.concat(F.lit(f"{name}: "), fields[name]))
        for name in TEXT_FIELDS
        if name in fields
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ; ", *parts), F.lit("")), _c(item_id))


def target_text(title: Column | str, categories: Column | str) -> Column:
    """Title, else categories, else ''."""
    return F.coalesce(
        F.nullif(clean_text(title), F.lit("")), F.nullif(clean_text(categories), F.lit("")), F.lit("")
    )


def first_non_blank(candidates: Column) -> Column:
    """First element of a string array that is not blank, trimmed; '' when there is none."""
    kept = F.filter(F.transform(candidates, _strip), lambda x: x != "")
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def file_name_of_url(col: Column | str) -> Column:
    """Last path segment of a URL without its query string."""
    return F.coalesce(
        _strip(F.substring_index(F.substring_index(_c(col), "?", 1), "/", -1)), F.lit("")
    )


def code_key(code: Column | str) -> Column:
    """[1, 2, 3] -> '1-2-3'."""
    return F.array_join(_c(code).cast("array<string>"), "-")


def parse_code_key(key: Column | str) -> Column:
    """'1-2-3' -> [1, 2, 3]."""
    return F.split(_c(key), "-").cast("array<int>")
