"""Names: sanitising, prefixes, similarity; and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitise(name: Column, strict: bool = True, longest: int = 128) -> Column:
    """A name that is safe in a path. Strict: letters, digits, _ and - stay, a space becomes _, the rest goes.

    Otherwise dots and slashes become _ as well, and the result is cut to ``longest`` characters.
    """
    separators = " " if strict else r"[ ./\\]"
    kept = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), separators, "_"), "[^A-Za-z0-9_-]", "")
    kept = kept if strict else F.substring(kept, 1, longest)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("unnamed"))


def bare(name: Column) -> Column:
    """A joint name without its rig's prefix: what is up to the first colon, then Bip01_ or 'Bip01 '."""
    return F.regexp_replace(F.regexp_replace(name, "^[^:]*:", ""), "^Bip01[_ ]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names, the ratio of lengths where one holds the other, else 1 - edit distance / longer length."""
    a, b = F.lower(bare(a)), F.lower(bare(b))
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), shorter / longer)
        .otherwise(1 - F.levenshtein(a, b) / longer)
    )


def numbered(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def json_value(text: Column, path: str, kind: str, default) -> Column:
    """A field of a JSON text; the default where it is missing, null, or the text is not JSON."""
    return F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(default).cast(kind))
