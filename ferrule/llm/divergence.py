"""Source divergence audit by joint count histograms.

Per language, each source's smoothed term distribution is compared with every
other source's and with the whole language's.  For a pair of sources, the terms
are tallied by their two counts; the difference of the two probabilities
depends on the counts alone, so it is evaluated once per combination and
multiplied by the number of terms.  Combinations with a zero are never
enumerated by term: (c, 0) is the number of the first source's terms of count c
less those that the second has too, and (0, 0) is what is left of the
vocabulary.

Texts are counted once, in each task first, so that a common term or a hot
source costs a row a task.  Sources that share a term meet in tiles of about
`tile` sources, so that a term in all sources is dealt to many tasks, and each
unordered pair meets once.  Probabilities are whole billionths, by decimal
arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, ascii_lower

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, PRIOR = 1_000_000_000, 5
GROUP = ["lang", "source"]


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact up to counts of 10**18."""
    over = ((count + PRIOR).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(38,0)")
    under = total.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return F.lit(1) + F.call_function("div", over, under)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, in_docs documents)"""
    terms = docs.select(*GROUP, F.sort_array(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    before = F.concat(F.array(F.lit(None).cast("string")), "term")  # sorted: equal terms are neighbours
    each = terms.withColumn("before", before).select(*GROUP, F.explode_outer(F.arrays_zip("term", "before")).alias("z")).where("z.term is not null")
    first = F.when(F.col("z.term") == F.col("z.before"), 0).otherwise(1)
    return each.select(*GROUP, "z.term", first.alias("first")).groupBy(*GROUP, "term").agg(F.count("*").alias("n"), F.sum("first").alias("in_docs"))


def _meetings(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """(lang, source, other, c, d, k): the number of terms with count c in source and d in other, both over zero, source < other."""
    dealt = cells.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    one = dealt.select("lang", "term", F.col("source").alias("s1"), F.col("n").alias("c1"), F.col("tile").alias("t1"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("t2"))
    two = dealt.select("lang", "term", F.col("source").alias("s2"), F.col("n").alias("c2"), F.col("tile").alias("t2"), F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("t1"))
    met = one.join(two, ["lang", "term", "t1", "t2"]).where((F.col("t1") < F.col("t2")) | (F.col("s1") < F.col("s2")))
    swap = F.col("s1") > F.col("s2")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    met = met.select("lang", either("s1", "s2").alias("source"), either("s2", "s1").alias("other"), either("c1", "c2").alias("c"), either("c2", "c1").alias("d"))
    return met.groupBy(*GROUP, "other", "c", "d").agg(F.count("*").alias("k"))


def _pairs(cells: DataFrame, groups: DataFrame, scratch: Scratch, tile: int) -> DataFrame:
    """(lang, source, other, value) of each unordered pair of a language's sources."""
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    tiles = sources.select("lang", F.ceil(F.col("sources") / tile).alias("tiles"))
    met = scratch.keep(_meetings(cells, tiles), "met")
    # kept terms with each count; what is not there has the count zero
    counts = cells.groupBy(*GROUP, "n").agg(F.count("*").alias("k"))
    mine = groups.select(*GROUP, "terms", F.col("own").alias("own1"), F.col("total").alias("total1"))
    their = groups.select("lang", F.col("source").alias("other"), F.col("own").alias("own2"), F.col("total").alias("total2"))
    pairs = scratch.keep(mine.join(their, "lang").where("source < other"), "pairs")
    key, zero = [*GROUP, "other"], F.lit(0).cast("long")
    second = counts.select("lang", F.col("source").alias("other"), F.col("n").alias("d"), "k")
    tally = met.select(*key, "c", "d", "k")
    tally = tally.union(met.select(*key, "c", zero, -F.col("k"))).union(met.select(*key, zero, "d", -F.col("k"))).union(met.select(*key, zero, zero, "k"))
    tally = tally.union(pairs.select(*key).join(counts, GROUP).select(*key, "n", zero, "k"))
    tally = tally.union(pairs.select(*key).join(second, ["lang", "other"]).select(*key, zero, "d", "k"))
    tally = tally.union(pairs.select(*key, zero, zero, F.col("terms") - F.col("own1") - F.col("own2")))
    tally = tally.groupBy(*key, "c", "d").agg(F.sum("k").alias("k")).where("k > 0")
    p, q = (probability(F.col(c), F.col(total), F.col("terms")) for c, total in (("c", "total1"), ("d", "total2")))
    each = tally.join(pairs, key).select(*key, (F.abs(p - q) * F.col("k")).alias("f"))
    return pairs.select(*key).join(each.groupBy(*key).agg(F.sum("f").alias("value")), key, "left").withColumn("value", F.coalesce("value", zero))


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50, tile: int = 256) -> DataFrame:
    """How far apart the sources of each language are, and which terms mark each source.

    docs has text, lang and source (null counts as empty); other columns are
    ignored.  Terms are runs of letters and of characters beyond ASCII, with
    A-Z lower-cased; each language keeps those in at least `least_docs` of its
    documents.  A group is a language's source, also one without terms.  With
    N occurrences of kept terms and V kept terms, a group gives a term of c
    occurrences the probability p = 1 + floor(10**9 (c + 5) / (N + 5 V)).

    Returns lang, source, part, item, value, rank.  Part `pair`: every other
    source of the language, by the sum of |p - q| over all kept terms (0 if
    there are none).  Part `term`: the `top` terms that the group has and that
    are likelier there than in the language, by the difference.  Ranks count
    from 1 by falling value, then by the item's bytes.

    Repeated rows are documents each; doc_id isn't read.  An empty table gives
    no rows, a language of one source no pairs.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    counted = scratch.keep(_counted(own), "counted")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("in_docs").alias("in_docs")).where(F.col("in_docs") >= least_docs).drop("in_docs")
    cells = scratch.keep(counted.join(kept, ["lang", "term"]), "cells")
    scratch.drop("counted")
    language = cells.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total_lang"))
    sums = cells.groupBy(*GROUP).agg(F.count("*").alias("own"), F.sum("n").alias("total"))
    groups = own.select(*GROUP).distinct().join(sums, GROUP, "left").join(language, "lang", "left")
    groups = scratch.keep(groups.na.fill(0, ["own", "total", "terms", "total_lang"]), "groups")

    value = scratch.keep(_pairs(cells, groups, scratch, tile), "values")
    pair = value.union(value.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pair = pair.select(*GROUP, F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    p, q = (probability(F.col(c), F.col(total), F.col("terms")) for c, total in (("n", "total"), ("n_lang", "total_lang")))
    term = cells.join(groups, GROUP).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = W.partitionBy(*GROUP, "part").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pair, term)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))


SQL = rf"""
with d as materialized (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents
),
tok as materialized (select lang, source, doc, unnest(w) as term from d),
vocab as materialized (select lang, term, count(*) as n_lang from tok group by 1, 2 having count(distinct doc) >= 30),
lg as materialized (select g.lang, count(v.term) as v, coalesce(sum(v.n_lang), 0) as n from (select distinct lang from d) g left join vocab v on g.lang = v.lang group by 1),
grp as materialized (select distinct lang, source from d),
cnt as materialized (select t.lang, t.source, t.term, count(*) as c from tok t join vocab v on t.lang = v.lang and t.term = v.term group by 1, 2, 3),
tot as materialized (select g.lang, g.source, coalesce(sum(c.c), 0) as n from grp g left join cnt c on g.lang = c.lang and g.source = c.source group by 1, 2),
prob as materialized (
  select g.lang, g.source, v.term, coalesce(c.c, 0) as c, 1 + cast(1000000000 as hugeint) * (coalesce(c.c, 0) + 5) // (t.n + 5 * l.v) as p,
    1 + cast(1000000000 as hugeint) * (v.n_lang + 5) // (l.n + 5 * l.v) as q
  from grp g join vocab v on g.lang = v.lang join tot t on t.lang = g.lang and t.source = g.source join lg l on l.lang = g.lang
  left join cnt c on c.lang = g.lang and c.source = g.source and c.term = v.term
),
pair as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join (select p.lang, p.source, o.source as item, sum(abs(p.p - o.p)) as value from prob p join prob o on p.lang = o.lang and p.term = o.term and p.source <> o.source group by 1, 2, 3) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source
),
both_parts as (
  select lang, source, 'pair' as part, item, cast(value as bigint) as value from pair
  union all select lang, source, 'term', term, cast(p - q as bigint) from prob where c > 0 and p > q
),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from both_parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""
