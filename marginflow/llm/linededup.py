"""Deletes later copies of repeated runs of lines, by winnowing. DataFrame operations only.

A *unit* is a line or, where a line has several sentences, a sentence of it, or part of a long one up to a comma,
without white space at its ends; blank lines are passed over and always kept. A *gram* is the shortest run of units with ``NOISE_WORDS`` words or more from
a given unit on. Windows of grams select their least hash: for a unit that is a line, the window holds the grams that
begin within ``GUARANTEE_WORDS - NOISE_WORDS`` words, for a sentence it holds ``WINDOW_UNITS`` grams; windows at a
document's end are shorter. So copies of a run of lines of ``GUARANTEE_WORDS`` words or more share a selected gram,
and so do copies of a passage that holds ``WINDOW_UNITS`` grams in whole sentences, wherever in their lines they
begin. A selected gram is linked to its previous occurrence in the same document, or else to the first document that
has it; matches are extended unit by unit both ways, ``REACH`` units beyond the outermost link.

Repeated runs of ``PASSAGE_WORDS`` words or more are deleted as they are, shorter ones as far as they are whole lines
with ``NOISE_WORDS`` words or more together. Every unit that goes has an earlier copy, so a first copy stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import checkpointed

NOISE_WORDS = 8
GUARANTEE_WORDS = 16
WINDOW_UNITS = 3
PASSAGE_WORDS = 24
#: Units that a match is extended beyond the links of a stretch, and units of a stretch.
REACH = 16
STRETCH = 256
#: White space at the ends of a unit and between its words.
BLANKS = " \t\r\f\v\n"
#: Texts are cut behind a line feed, a sign that ends a sentence with the blank after it, and a wide full stop.
ENDS = "[.!?;] "
WIDE_END = "。"
#: Sentences of more bytes are also cut behind a comma and its blank.
LONG_BYTES = 160
#: Put where texts are cut; a code point that no text holds (one that does is cut into lines only).
_MARK = "\ufdd0"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once: a column named in a lambda may be, anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: str) -> Column:
    """The text in pieces that joined give the text: a line's last piece ends with its line feed."""
    marked = F.regexp_replace(F.replace(F.col(text), F.lit("\n"), F.lit("\n" + _MARK)), ENDS, "$0" + _MARK)
    marked = F.split(F.replace(marked, F.lit(WIDE_END), F.lit(WIDE_END + _MARK)), _MARK)
    parts = lambda x: F.split(F.replace(x, F.lit(", "), F.lit(", " + _MARK)), _MARK)
    marked = F.flatten(F.transform(marked, lambda x: F.when(F.octet_length(x) > LONG_BYTES, parts(x)).otherwise(F.array(x))))
    return F.when(F.contains(F.col(text), F.lit(_MARK)), F.split(text, "(?<=\n)")).otherwise(marked)


def _trimmed(x: Column) -> Column:
    """``x`` without white space at its ends. Trimming by a list of characters is slow, so it is left to pieces that
    begin, or apart from spaces end, with a byte below that of ``!``."""
    last = F.substring(F.rtrim(x).cast("binary"), -1, 1)
    return F.when((x >= "!") & (last >= F.lit(b"!")), F.rtrim(x)).otherwise(F.btrim(x, F.lit(BLANKS)))


def _begins(pieces: Column, i: Column) -> Column:
    """Whether the piece begins a line."""
    return F.coalesce(F.endswith(F.get(pieces, i - 1), F.lit("\n")), F.lit(True))


def _units(pieces: Column) -> Column:
    """(at, nl) of the units, as arrays: the piece of each and whether it begins a line."""
    filled = lambda x: F.when(x >= "!", True).otherwise(F.btrim(x, F.lit(BLANKS)) != "")
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: filled(F.get(pieces, i)))
    return _let(at, lambda at: F.struct(at.alias("at"), F.transform(at, lambda i: _begins(pieces, i)).alias("nl")))


def _words(t: Column) -> Column:
    """Words of each unit: one more than blanks, and no more than other bytes, so that wide gaps make none."""
    full = F.transform(t, lambda x: F.octet_length(F.replace(x, F.lit(" "), F.lit(""))))
    return F.zip_with(t, full, lambda x, n: F.least(F.octet_length(x) - n + 1, n))


def _document(docs: DataFrame, doc_id: str) -> Column:
    """An id that orders documents and is never null: whole numbers as such, else text. Null comes first."""
    if isinstance(docs.schema[doc_id].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))


def selected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, th, k, g, i, own) for each document: hashes k of its units; its selected grams' hashes g, their units i,
    and the unit of the previous one like it in the document, -1 where there is none.

    All of it is worked out within the row. d is the document's id (``_document``) and th its text's hash; repeated
    rows (same id and text) give one row.
    """
    rows = docs.where(F.col(text).isNotNull()).select(_document(docs, doc_id).alias("d"), F.xxhash64(text).alias("th"), _pieces(text).alias("p"))
    rows = rows.select("d", "th", "p", F.transform("p", _trimmed).alias("t"))
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i) != "")
    rows = rows.select("d", "th", F.transform(at, lambda i: _begins(F.col("p"), i)).alias("nl"), F.filter("t", lambda x: x != "").alias("t"))
    hashed = F.transform("t", lambda x: F.substring(F.md5(x), 1, 16))
    rows = rows.select("d", "th", "nl", F.transform("t", lambda x: F.xxhash64(x)).alias("k"), hashed.alias("h"), _words(F.col("t")).alias("n"))

    def gram(words: Column, i: Column) -> Column:
        """The gram from a unit on, null where words do not suffice; a unit has a word at least."""
        hashes = [F.get("h", i)]
        out = F.when(words >= NOISE_WORDS, hashes[0])
        for k in range(1, NOISE_WORDS):
            words, hashes = words + F.get("n", i + k), [*hashes, F.get("h", i + k)]
            out = out.when(words >= NOISE_WORDS, F.substring(F.md5(F.concat(*hashes)), 1, 16))
        return out

    grams = F.transform("n", gram)
    line = F.transform("nl", lambda x, i: x & F.coalesce(F.get("nl", i + 1), F.lit(True)))
    rows = rows.select("d", "th", "k", "n", grams.alias("g"), line.alias("line"))
    ahead = GUARANTEE_WORDS - NOISE_WORDS

    def near(i: Column) -> Column:
        """The least gram that begins within ``ahead`` words; s words lie before the one looked at."""
        units = F.sequence(i + 1, F.least(i + ahead, F.size("n") - 1))
        first = F.struct(i.alias("j"), F.get("n", i).alias("s"))
        least = F.aggregate(units, first, lambda a, j: F.struct(F.when((a["s"] <= ahead) & (F.get("g", j) < F.get("g", a["j"])), j).otherwise(a["j"]).alias("j"), (a["s"] + F.get("n", j)).alias("s")))
        return F.when(i + 1 >= F.size("n"), i).otherwise(least["j"])

    def apart(a: Column, i: Column) -> Column:
        """The least of three grams; only the last ones of a document are null."""
        b, c = (F.get("g", i + k) for k in range(1, WINDOW_UNITS))
        none = F.lit(True)
        return F.when(F.coalesce(a <= b, none) & F.coalesce(a <= c, none), i).when(F.coalesce(b <= c, none), i + 1).otherwise(i + 2)

    window = F.transform("g", lambda x, i: F.when(x.isNull(), F.lit(None).cast("int")).when(F.get("line", i), F.when(F.get("n", i) > ahead, i).otherwise(near(i))).otherwise(apart(x, i)))
    chosen = F.array_distinct(F.filter(window, lambda i: i.isNotNull()))
    rows = rows.select("d", "th", "k", "g", chosen.alias("c"))
    rows = rows.select("d", "th", "k", F.transform("c", lambda i: F.xxhash64(F.get("g", i))).alias("g"), F.col("c").alias("i"))

    def own(c: Column) -> Column:
        before = lambda x, b: F.when(b["g"] == x["g"], b["i"]).otherwise(-1)
        return F.transform(c, lambda x, j: F.struct(x["g"].alias("g"), x["i"].alias("i"), before(x, F.get(c, j - 1)).alias("own")))

    # sorted only where a gram comes again within the document
    again = F.size(F.array_distinct("g")) < F.size("g")
    sorted_ = F.when(again, _let(F.sort_array(F.arrays_zip("g", "i")), own))
    rows = rows.select("d", "th", "k", "g", "i", sorted_.alias("s"))
    field = lambda name, plain: F.when(F.col("s").isNull(), plain).otherwise(F.col(f"s.{name}")).alias(name)
    rows = rows.select("d", "th", "k", field("g", F.col("g")), field("i", F.col("i")), field("own", F.array_repeat(F.lit(-1), F.size("g"))))
    return rows.dropDuplicates(["d", "th"])


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, th, runs): for each document with repeated units, the runs (lo, hi) of them in order, counted from 0."""
    of = checkpointed(selected(docs, doc_id, text))
    grams = of.select("d", "th", F.explode(F.arrays_zip("g", "i", "own")).alias("x")).select("d", "th", "x.g", "x.i", "x.own")
    alone = grams.where("own < 0").drop("own")
    # written first, so that the join can split a gram that very many documents share
    first = alone.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("d", "th", "i")).alias("first")).where("times > 1")
    first = checkpointed(first.select("g", "first"))
    other = alone.join(first, "g").where("d <> first.d OR th <> first.th").select("d", "th", "i", F.col("first.d").alias("d0"), F.col("first.th").alias("th0"), F.expr("i - first.i AS shift"))
    within = grams.where("own >= 0").select("d", "th", "i", F.col("d").alias("d0"), F.col("th").alias("th0"), F.expr("i - own AS shift"))
    stretch = F.floor(F.col("i") / STRETCH).alias("stretch")
    links = other.unionByName(within).groupBy("d", "th", "d0", "th0", "shift", stretch).agg(F.collect_list("i").alias("hits"))
    lo = F.greatest(F.array_min("hits") - REACH, "shift", F.lit(0))
    links = links.select("d", "th", "d0", "th0", "shift", "hits", lo.alias("lo"), (F.array_max("hits") + REACH).alias("hi"))

    # both documents' units of the stretch; where they differ, runs end
    here = links.join(of.select("d", "th", "k"), ["d", "th"]).withColumn("k", F.expr("slice(k, lo + 1, hi - lo + 1)"))
    there = of.select(F.col("d").alias("d0"), F.col("th").alias("th0"), F.col("k").alias("k0"))
    both = here.join(there, ["d0", "th0"]).withColumn("k0", F.expr("slice(k0, lo - shift + 1, hi - lo + 1)"))
    n = F.least(F.size("k"), F.size("k0"))
    differ = _let(F.zip_with("k", "k0", lambda a, b: a == b), lambda same: F.filter(F.transform(same, lambda x, j: F.when(~x, j)), lambda j: j.isNotNull()))
    both = both.select("d", "th", "hits", "lo", F.concat(F.array(F.lit(-1)), F.filter(differ, lambda j: j < n), F.array(n)).alias("ends"))
    gaps = F.zip_with(F.expr("slice(ends, 1, size(ends) - 1)"), F.expr("slice(ends, 2, size(ends) - 1)"), lambda a, b: F.struct((F.col("lo") + a + 1).alias("lo"), (F.col("lo") + b - 1).alias("hi")))
    hit = F.filter(gaps, lambda r: (r["lo"] <= r["hi"]) & F.exists("hits", lambda h: h.between(r["lo"], r["hi"])))
    runs = both.select("d", "th", F.explode(hit).alias("r")).select("d", "th", "r.lo", "r.hi")

    # runs that overlap or meet become one
    doc = Window.partitionBy("d", "th").orderBy("lo")
    reached = F.max("hi").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce(F.col("lo") > reached + 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "text_clean", count: str = "n_deleted", spare: float | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with ``out``, the text without later repeated runs, and ``count``, the units
    deleted. Documents come in order of their ids, null first; ids can be of any type that has an order as text.

    A null text stays null with 0 deleted; a text all of whose units go becomes empty; a line of which all units go
    goes with its line feed. Repeated rows get the same result each. Columns named ``out`` or ``count`` are
    replaced. With ``spare``, a document of whose words more than that share would go is left whole: it is a copy
    of documents rather than one that holds passages, and a later stage can judge it as a document.
    """
    docs = docs.drop(*[c for c in (out, count) if c != text and c != doc_id])
    gone = repeated_runs(docs, doc_id, text).withColumnsRenamed({"d": "__d", "th": "__th", "runs": "__runs"})
    keyed = docs.withColumns({"__d": _document(docs, doc_id), "__th": F.xxhash64(text)})
    joined = keyed.join(gone, ["__d", "__th"], "left")

    def total(p: Column, at: Column) -> Column:
        return F.aggregate(_words(F.transform(at, lambda i: F.btrim(F.get(p, i), F.lit(BLANKS)))), F.lit(0), lambda a, n: a + n)

    def words(p: Column, u: Column, r: Column) -> Column:
        return total(p, F.slice(u["at"], r["lo"] + 1, r["hi"] - r["lo"] + 1))

    def passage(p: Column, u: Column, r: Column) -> Column:
        # a unit has a word at least, so long runs need no count
        return F.when(r["hi"] - r["lo"] + 1 >= PASSAGE_WORDS, True).otherwise(words(p, u, r) >= PASSAGE_WORDS)

    def begins(u: Column, i: Column) -> Column:
        return F.coalesce(F.get(u["nl"], i), F.lit(True))

    def trimmed(p: Column, u: Column, r: Column) -> Column:
        """The run, or its whole lines where it is short; null if they are too few."""
        starts = F.filter(F.sequence(r["lo"], r["hi"] + 1), lambda i: begins(u, i))
        lines = _let(starts, lambda s: F.struct(F.array_min(s).alias("lo"), (F.array_max(s) - 1).alias("hi")))
        enough = _let(lines, lambda x: F.when((x["hi"] >= x["lo"]) & (words(p, u, x) >= NOISE_WORDS), x))
        return F.when(passage(p, u, r), r).otherwise(enough)

    def span(p: Column, u: Column, r: Column) -> Column:
        """Pieces of a run, and whether a line feed stays since its first line stays in part; units and words."""
        feed = ~begins(u, r["lo"]) & F.exists(F.sequence(r["lo"] + 1, r["hi"] + 1), lambda i: begins(u, i) & (i < F.size(u["nl"])))
        return F.struct(F.get(u["at"], r["lo"]).alias("a"), F.get(u["at"], r["hi"]).alias("b"), feed.alias("feed"), (~begins(u, r["lo"])).alias("mid"), (r["hi"] - r["lo"] + 1).alias("units"), (F.lit(0) if spare is None else words(p, u, r)).alias("words"))

    def spans(p: Column, u: Column) -> Column:
        own = F.filter(F.transform("__runs", lambda r: trimmed(p, u, r)), lambda r: r.isNotNull())
        found = _let(own, lambda runs: F.transform(runs, lambda r: span(p, u, r)))
        if spare is None:
            return found
        return _let(found, lambda s: F.when(F.aggregate(s, F.lit(0), lambda a, x: a + x["words"]) <= spare * total(p, u["at"]), s))

    def rest(p: Column, s: Column) -> Column:
        def kept(x: Column, j: Column) -> Column:
            before = F.coalesce(F.get(s, j - 1)["b"], F.lit(-1))
            blank = F.filter(F.slice(p, x["a"] + 1, x["b"] - x["a"] + 1), lambda t: F.btrim(t, F.lit(BLANKS)) == "")
            return F.concat(F.slice(p, before + 2, x["a"] - before - 1), F.when(x["feed"], F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>")), blank)

        after = F.slice(p, F.get(s, F.size(s) - 1)["b"] + 2, F.size(p))
        joined = F.array_join(F.concat(F.flatten(F.transform(s, kept)), after), "")
        # where the last line went, the line feed before it goes too
        ends = _let(F.get(s, F.size(s) - 1), lambda x: (x["b"] == F.size(p) - 1) & ~x["mid"])
        return _let(joined, lambda x: F.when(ends & F.endswith(x, F.lit("\n")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))

    def result(p: Column) -> Column:
        return _let(_let(_units(p), lambda u: spans(p, u)), lambda s: F.when(F.size(s) > 0, F.struct(rest(p, s).alias("x"), F.aggregate(s, F.lit(0), lambda a, x: a + x["units"]).alias("n"))))

    joined = joined.withColumn("__r", F.when(F.col("__runs").isNotNull(), _let(_pieces(text), result)))
    clean = F.when(F.col("__r").isNotNull(), F.col("__r.x")).otherwise(F.col(text))
    joined = joined.withColumns({count: F.coalesce("__r.n", F.lit(0)).cast("long"), "__rest": clean})
    return joined.drop("__d", "__th", "__runs", "__r", *([] if out == text else [out])).withColumn(out, F.col("__rest")).drop("__rest")
