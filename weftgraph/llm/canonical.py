"""Free-entered names mapped to the closest entry of a reference list.

Partition-based pigeonhole join.  A string within ``k`` edits of a reference
must contain one of any ``k + 1`` disjoint segments of it unchanged, at most
``k`` places from where it stands there.  Segments of the references meet the
substrings of the names in an equality join; what meets is verified with the
built-in ``levenshtein``, over the whole and word by word.  What is compared is
the name itself or the name without up to two words at either end.  Such outer
words count as filler only if the data say so: the word is in no reference, and
it stands around several different references.  Everything is SQL expressions;
each distinct name is looked up once, what no reference takes comes out by an
anti-join.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.skew import HOT_ROWS, HOT_SHARE, salted_join
from weftgraph.session import Scratch

#: Edits that a name may be away from its reference.
MAX_EDITS = 4
#: Words that may be left out at each end of a name.
OUTER_WORDS = 2
#: Different references that a word must stand around to count as filler.
MIN_FRAMED = 2
#: A reference list up to this many rows is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 20_000
#: Distinct names that one task cuts into substrings.
NAMES_PER_TASK = 2_000
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсхуіјѕкмтвнԁαεοριν", "aeopcxyijskmtbhdaeopiv"))


def base_letters() -> tuple[str, str]:
    """Accented Latin letters and the letters they carry, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()] + [("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i")] + list(LOOKALIKE.items())
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: A cut word's full stop while separators are removed.
STOP = "\u0001"
#: Steps of ``plain`` after lower case and base letters: what is replaced, by
#: what, and how often in a row (neighbouring places share a letter).
STEPS = (
    ("\\p{M}|[\u00ad\u200b-\u200f\u2060\ufeff]", "", 1),
    (r"^\s*([^,]+?)\s*,\s*([^\s,]+)((?:\s[^,]*)?)$", r"\2 \1\3", 1),
    (r"(\p{L})0", r"\1o", 1), (r"0(\p{L}{2})", r"o\1", 1),
    (r"(\p{L})1(\p{L})", r"\1l\2", 2), (r"(\p{L}{2})1", r"\1l", 1), (r"(^|[^\p{L}\p{N}_])1(\p{L}{2})", r"\1l\2", 1),
    (r"(\p{L})5(\p{L})", r"\1s\2", 2),
    (r"(\p{L})\.(\s)", rf"\1{STOP}\2", 1),
    (rf"[^\p{{L}}\p{{N}}{STOP}]+", " ", 1),
)


def plain(c: Column) -> Column:
    """Lower-case words of a name, without accents, marks and separators.

    What stands in brackets is left out, ``Second, First`` is turned round,
    words joined by capitals are parted, digits inside words are read as the
    letters they resemble.  A word cut with a full stop keeps the stop.
    """
    a, b = base_letters()
    x = F.regexp_replace(c, r"\([^)]*\)", " ")
    x = F.when(x.rlike(r"[\s_.,-]"), x).otherwise(F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    x = F.translate(F.lower(x), a, b)
    for what, by, times in STEPS:
        for _ in range(times):
            x = F.regexp_replace(x, what, by.replace("\\", "$"))
    return F.trim(F.translate(x, STOP, "."))


def _squash(c: Column) -> Column:
    return F.regexp_replace(c, r"[ .]", "")


def _segments(n: Column, k: int) -> Column:
    """0-based (number, start, length) of k + 1 even segments of a string of length n."""
    def seg(i: Column) -> Column:
        at = (i * n / (k + 1)).cast("int")
        end = ((i + 1) * n / (k + 1)).cast("int")
        return F.struct(i.alias("i"), at.alias("at"), (end - at).alias("len"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), seg)


def _cuts() -> list[tuple[int, int, int]]:
    """Number, words left out before and words left out after, of each window."""
    return [(a * (OUTER_WORDS + 1) + b, a, b) for a in range(OUTER_WORDS + 1) for b in range(OUTER_WORDS + 1)]


def _places(sizes: Column) -> Column:
    """Number, place and length in the squashed name of the name itself and of its
    runs of at least two words that leave out outer words; ``sizes`` of its words."""
    n = F.size(sizes)
    size = lambda at: F.coalesce(F.get(sizes, at), F.lit(0))
    total = F.aggregate(sizes, F.lit(0), lambda x, y: x + y)

    def place(i: int, a: int, b: int) -> Column:
        before, after = F.lit(0), F.lit(0)
        for j in range(a):
            before = before + size(F.lit(j))
        for j in range(b):
            after = after + size(n - 1 - j)
        one = F.struct(F.lit(i).alias("id"), before.alias("off"), (total - before - after).alias("len"))
        return one if a + b == 0 else F.when(n - a - b >= 2, one)

    return F.array_compact(F.array(*[place(*c) for c in _cuts()]))


def _window(words: Column, number: Column) -> Column:
    """The window of that number: its words, and those before and after it."""
    before = (number / (OUTER_WORDS + 1)).cast("int")
    after = F.pmod(number, F.lit(OUTER_WORDS + 1))
    n = F.size(words)
    run = F.slice(words, before + 1, F.greatest(n - before - after, F.lit(0)))
    left, right = F.slice(words, F.lit(1), before), F.slice(words, F.greatest(n - after + 1, F.lit(1)), after)
    return F.struct((before + after).alias("cut"), _squash(F.array_join(run, "")).alias("sq"), run.alias("words"), left.alias("before"), right.alias("after"))


def _word_cost(typed: Column, ref: Column) -> Column:
    """Edits between two words; a cut word and swapped letters count 1, too many 99."""
    t = F.regexp_replace(typed, r"\.$", "")
    letters = lambda x: F.array_sort(F.split(x, ""))
    d = F.levenshtein(t, ref)
    allowed = F.when(F.length(ref) <= 5, 1).when(F.length(ref) <= 8, 2).otherwise(3)
    cut = typed.endswith(".") & (F.length(t) >= 3) & ref.startswith(t)
    swapped = (d <= 2) & (letters(t) == letters(ref))
    return F.when(d == 0, 0).when(cut | swapped, 1).when(d <= allowed, d).otherwise(99)


def match(names: DataFrame, name: str, references: DataFrame, ref_id: str, ref_name: str, k: int = MAX_EDITS) -> DataFrame:
    """``names`` with the id of the reference each name is meant to spell, or -1.

    ``names`` keeps its columns and rows, repeated ones too; ``match_id`` is
    added.  Null, blank and very short names match nothing; a null reference
    name is no reference; empty tables give all -1 or no rows.  A name whole
    comes before a name without outer words; where several references are
    equally close, the smallest id is taken.  Names of any length are looked at
    whole.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "canonical")
    rows = names.withColumn("__plain", F.coalesce(plain(F.col(name)), F.lit("")))
    rows = scratch.cut(rows, "names")
    distinct = scratch.cut(rows.groupBy("__plain").agg(F.count(F.lit(1)).alias("n")), "distinct")

    refs = references.where(F.col(ref_name).isNotNull()).select(F.col(ref_id).cast("bigint").alias("rid"), plain(F.col(ref_name)).alias("ref")).distinct()
    refs = refs.withColumn("rsq", _squash("ref")).withColumn("rlen", F.length("rsq")).where("rlen > 0")
    refs = scratch.cut(refs.withColumn("edits", F.least(F.lit(k), F.greatest(F.lit(1), (F.col("rlen") / 3).cast("int")))), "references")
    segs = refs.withColumn("s", F.explode(_segments(F.col("rlen"), k))).where("s.len > 0")
    segs = segs.select("rid", "ref", "rsq", "rlen", "edits", F.col("s.at").alias("at"), F.substring("rsq", F.col("s.at") + 1, F.col("s.len")).alias("piece"))
    bound = refs.agg(F.count(F.lit(1)), F.max("rlen"), F.min("rlen")).first()
    if not bound[0]:
        return rows.withColumn("match_id", F.lit(-1).cast("bigint")).drop("__plain")
    if bound[0] <= BROADCAST_ROWS:
        segs = F.broadcast(segs)
    sizes = sorted({(i + 1) * n // (k + 1) - i * n // (k + 1) for n in range(bound[2], bound[1] + 1) for i in range(k + 1)} - {0})

    # a window much longer or shorter than every reference cannot be within k edits of one
    tasks = -(-distinct.count() // NAMES_PER_TASK)
    near = distinct.select("__plain").repartition(max(1, tasks), "__plain")
    sizes_of = F.transform(F.split("__plain", " "), lambda x: F.length(_squash(x)))
    near = near.select("__plain", _squash("__plain").alias("sq"), F.explode(_places(sizes_of)).alias("w"))
    near = near.select("__plain", "w.id", F.substring("sq", F.col("w.off") + 1, F.col("w.len")).alias("sq"), F.col("w.len").alias("qlen"))
    near = near.where((F.col("qlen") <= bound[1] + k) & (F.col("qlen") >= bound[2] - k) & (F.col("qlen") > 0))
    # only the lengths that segments of references of about this length have
    least, most = F.greatest(F.lit(min(sizes)), F.floor((F.col("qlen") - k) / (k + 1))), F.least(F.lit(max(sizes)), F.ceil((F.col("qlen") + k) / (k + 1)))
    probe = near.withColumn("sizes", F.sequence(least.cast("int"), F.greatest(least, most).cast("int")))
    probe = probe.select("*", F.explode(F.sequence(F.lit(0), F.col("qlen") - 1)).alias("p"))
    probe = probe.select("__plain", "id", "qlen", "p", "sq", F.explode("sizes").alias("size")).select("__plain", "id", "qlen", "p", F.substring("sq", F.col("p") + 1, F.col("size")).alias("piece"))
    hits = probe.join(segs, "piece").where((F.abs(F.col("p") - F.col("at")) <= F.col("edits")) & (F.abs(F.col("qlen") - F.col("rlen")) <= F.col("edits")))
    hits = hits.select("__plain", "rid", "ref", "id").distinct()
    hits = hits.withColumn("w", _window(F.split("__plain", " "), F.col("id")))
    hits = hits.withColumn("rsq", _squash("ref")).withColumn("edits", F.least(F.lit(k), F.greatest(F.lit(1), (F.length("rsq") / 3).cast("int"))))
    near_by = hits.withColumn("d", F.expr(f"levenshtein(w.sq, rsq, {k})")).where("d >= 0 AND d <= edits")

    ref_words = F.split("ref", " ")
    costs = F.zip_with(F.col("w.words"), ref_words, lambda a, b: F.when(a.isNull() | b.isNull(), 99).otherwise(_word_cost(a, b)))
    by_word = F.aggregate(costs, F.lit(0), lambda acc, x: acc + x)
    # words run together or parted at another place are judged as a whole
    score = F.when(F.size("w.words") == F.size(ref_words), by_word).otherwise(F.when(F.col("d") <= 2, F.col("d")).otherwise(99))
    good = near_by.withColumn("score", score).where("score <= 6")
    good = scratch.cut(good.select("__plain", "rid", "score", "d", F.col("w.cut").alias("cut"), F.col("w.before").alias("before"), F.col("w.after").alias("after")), "good")

    # outer words that are filler, by what they stand around
    sided = lambda c, side: F.transform(c, lambda x: F.concat(F.lit(side), x))
    good = good.withColumn("outer", F.concat(sided("before", "<"), sided("after", ">"))).drop("before", "after")
    known = refs.select(F.explode(F.split("ref", " ")).alias("word")).distinct()
    outer = good.where("cut > 0").select("rid", F.explode("outer").alias("o")).withColumn("word", F.substring("o", 2, 1 << 30))
    filler = outer.join(known, "word", "left_anti").groupBy("o").agg(F.countDistinct("rid").alias("n")).where(F.col("n") >= MIN_FRAMED).select("o", F.lit(1).alias("ok"))
    framed = good.where("cut > 0").select("__plain", "rid", "score", "d", "cut", F.explode("outer").alias("o")).join(filler, "o", "left")
    framed = framed.groupBy("__plain", "rid", "score", "d", "cut").agg(F.count("ok").alias("n_ok"), F.count(F.lit(1)).alias("n")).where("n_ok = n")
    every = good.where("cut = 0").select("__plain", "rid", "score", "d", "cut").unionByName(framed.select("__plain", "rid", "score", "d", "cut"))
    best = every.groupBy("__plain").agg(F.min(F.struct("cut", "score", "d", "rid")).alias("b"))
    matched = scratch.cut(best.select("__plain", F.col("b.rid").alias("match_id")), "matched")
    unmatched = distinct.join(matched, "__plain", "left_anti").select("__plain", F.lit(-1).cast("bigint").alias("match_id"))
    total = rows.count()
    hot = [r[0] for r in distinct.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("__plain").collect()]
    spread = F.struct(*[c for c in rows.columns if c != "__plain"])
    return salted_join(rows, matched.unionByName(unmatched), "__plain", spread, hot).drop("__plain")
