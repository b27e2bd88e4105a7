"""Column expressions over vault paths and link targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(c: Column) -> Column:
    """Unicode NFC, composed in the JVM by the library that Spark sorts texts with.

    Strings of ASCII only are passed on as they are.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7f]"), composed).otherwise(c)


def normal_path(c: Column) -> Column:
    """NFC, ``\\`` read as ``/``, no outer blanks, no leading ``./``."""
    slashed = F.regexp_replace(nfc(c), r"^\s+|\s+$", "")
    return F.regexp_replace(F.translate(slashed, "\\", "/"), r"^(\./+)+", "")


def bare_target(c: Column) -> Column:
    """A target up to its first ``|``, ``?`` or ``#``, trimmed."""
    return F.regexp_replace(F.regexp_extract(c, r"(?s)^([^|?#]*)", 1), r"^\s+|\s+$", "")


def is_path_target(c: Column) -> Column:
    """True for a target that is written as a path (not a web address)."""
    bare = bare_target(c)
    return F.coalesce(~c.contains("://") & (bare.rlike(r"[/\\]") | bare.rlike(r"(?i)\.mdx?$")), F.lit(False))


def percent_decode(c: Column) -> Column:
    """Percent-decoding that keeps ``+`` and stray ``%`` as they stand."""
    safe = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))).otherwise(c)


def _fold_dots(c: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` above the root is ignored."""
    def step(acc: Column, s: Column) -> Column:
        return (
            F.when((s == "") | (s == "."), acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.array_append(acc, s))
        )

    folded = F.array_join(F.aggregate(F.split(c, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(c.rlike(r"(^|/)\.{1,2}(/|$)"), folded).otherwise(c)


def path_key(c: Column) -> Column:
    """The form in which a normal path compares with another.

    Lower case, without outer slashes, then without a leading ``docs/``, the
    ending ``.md`` or ``.mdx``, and a closing ``/index``.
    """
    k = F.regexp_replace(F.lower(c), r"^[/\s]+|[/\s]+$", "")
    k = F.regexp_replace(k, r"^docs/", "")
    k = F.regexp_replace(k, r"\.mdx?$", "")
    return F.regexp_replace(k, r"/index$", "")


def target_key(target: Column, referring_path: Column) -> Column:
    """The comparison key of the document that a path target means."""
    t = F.translate(percent_decode(bare_target(target)), "\\", "/")
    t = F.regexp_replace(nfc(t), r"^\s+|\s+$", "")
    home = F.regexp_replace(normal_path(referring_path), r"[^/]*$", "")
    full = F.when(t.rlike(r"^\.{1,2}/"), F.concat(F.coalesce(home, F.lit("")), t)).otherwise(t)
    return path_key(F.regexp_replace(_fold_dots(full), r"^(\./+)+", ""))
