"""Operator 10, mixing sources to target weights by Pareto order sampling.

Targets come from the weights by water-filling under the repetition cap. A
source with target T and size S first takes floor(T/S) whole copies of every
document; the rest is a sample of fixed size, in words: documents are ranked by
random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), and the lowest are taken
up to the rank whose words come nearest to what is still wanted.

p differs within a source: it is proportional to `inclusion`, by default the whole part of
the square root of the document's words, so that longer documents are likelier. Its scale makes the
expected words those wanted; documents whose p reaches 1 are certain, and the scale of the others
is worked out again without them until no more are. The cut is found by iterated
histograms, so a source of any size is never sorted or gathered in one place.

u comes from md5 of seed and doc_id: reruns agree.

Defined cases: null text has size 0; null source is a source of its own, last;
documents of size 0 take 0, very long ones are certain or not like all others; rows with the
same doc_id and size share their rank and are taken together; a source without words has
target 0; an empty table gives no rows; other columns pass through, and columns that clash with
the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hex_key, small, word_count
from .splitters import locate

DIGITS, SCALE = 13, float(2**52)
ADDED = ("size", "source_size", "target", "copies")


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share the sum of sizes by weight, none above cap times its size."""
    total, open_, got = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                got[i] = unit * weights[i]
            break
        for i in full:
            got[i] = cap * float(sizes[i])
            left -= got[i]
            open_.discard(i)
    return got


def pareto_key(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, q, as the 53 bits of q / (1 + q); 0 where p is 1 or more."""
    x = (u + 0.5) / SCALE
    a = x * (F.lit(1.0) - p)
    return F.when(p >= 1, 0).otherwise(F.floor(a / (a + (F.lit(1.0) - x) * p) * 2.0**53)).cast("long")


def inclusion_scales(thin: DataFrame, part: dict[int, float]) -> dict[int, float]:
    """Per source, the scale of `w` at which the expected words are those wanted, certain rows in full.

    thin: g, size, w. Each pass adds rows to the certain ones or is the last.
    """
    scale: dict[int, float] = {}
    sure = {g: -1 for g in part}
    while True:
        if scale:
            table = small(thin.sparkSession, sorted(scale.items()), "g int, scale double")
            rows = thin.join(table, "g").withColumn("sure", F.col("w") * F.col("scale") >= 1)
        else:
            rows = thin.withColumn("sure", F.lit(False))
        certain, rest = F.when(F.col("sure"), F.col("size")), F.when(~F.col("sure"), F.col("w") * F.col("size"))
        found = rows.groupBy("g").agg(F.coalesce(F.sum(certain), F.lit(0)).alias("c"), F.sum(rest).alias("r"), F.count(certain).alias("n")).collect()  # a row a source
        grew = False
        for r in found:
            g = r["g"]
            if g in part and r["n"] > sure[g]:
                grew, sure[g] = True, r["n"]
                scale[g] = (part[g] - float(r["c"])) / float(r["r"]) if r["r"] else scale.get(g, 0.0)
        if not grew:
            return scale


def mix(
    df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: str = "mix", inclusion: str | None = None,
    columns: list[str] | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Rows of df (their `columns`, all by default) with size, source_size, target and copies (0 to cap).

    Repeat a row `copies` times to get the mix. `inclusion` names a column of positive weights.
    The number of sources, not of documents, bounds what the driver holds.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    columns = [c for c in (df.columns if columns is None else columns) if c not in ADDED]
    words = word_count(F.col("text"))
    u = hex_key(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), DIGITS)
    # the caller's columns travel in a struct, so that no name of theirs can clash
    own = F.struct(*columns) if columns else F.lit(None).cast("struct<x:int>")
    asked = df.select(F.col("source").alias("source"), words.alias("size"), u.alias("u"), *([F.col(inclusion).cast("double").alias("w")] if inclusion else []), own.alias("row"))
    rows = asked if inclusion else asked.withColumn("w", F.floor(F.sqrt("size")))
    if "text" in columns:
        thin = scratch.keep(rows.drop("row"), "sizes")
    else:  # nothing heavy: the sizes need no second look at the texts
        thin = rows = scratch.keep(rows, "sizes")
    found = thin.groupBy("source").agg(F.sum("size").alias("s")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"]))  # Python orders strings by code point
    sizes = [int(r["s"] or 0) for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], cap)
    whole = [min(int(t // s), int(cap)) if s else 0 for t, s in zip(goal, sizes)]
    part = {i: t - k * s for i, (t, k, s) in enumerate(zip(goal, whole, sizes)) if t - k * s > 0}
    named = small(spark, [(i, r["source"]) for i, r in enumerate(found)], "g int, source string")

    def numbered(x: DataFrame) -> DataFrame:
        return x.join(named.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    drawn = numbered(thin.select("source", "size", "u", "w")).filter("size > 0 and w > 0")
    scale = inclusion_scales(drawn, part) if part else {}
    scales = small(spark, sorted(scale.items()), "g int, scale double")
    digest = drawn.join(scales, "g").select("g", pareto_key(F.col("u"), F.col("w") * F.col("scale")).alias("key"), F.col("size").alias("w"))
    cut = dict.fromkeys(range(len(found)), -1)
    if part:
        for (i, _), e in locate(digest, {i: [x] for i, x in part.items()}).items():
            if e is None:
                cut[i] = 2**63 - 1
            else:
                upper = e.below + e.weight - part[i] < part[i] - e.below
                cut[i] = e.key if upper else e.key - 1  # taken: key <= cut
    plan = small(
        spark, [(i, sizes[i], goal[i], whole[i], scale.get(i, 0.0), cut[i]) for i in range(len(found))],
        "g int, source_size long, target double, whole int, scale double, cut long",
    )
    taken = (F.col("w") > 0) & (F.col("scale") > 0) & (pareto_key(F.col("u"), F.col("w") * F.col("scale")) <= F.col("cut"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(taken, 1).otherwise(0)).otherwise(0)
    out = numbered(rows).join(plan, "g")
    return out.select(*([F.col("row")[c].alias(c) for c in columns]), "size", "source_size", "target", copies.cast("int").alias("copies"))


def oracle() -> str:
    """DuckDB SQL for the op10 query: water-filling and inclusion scales in closed form, then each source's cut in Pareto order."""
    return r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from documents),
s as (select source, sum(size)::bigint as s, sum(sum(size)) over () as total, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
p as (select *, row_number() over o as k, coalesce(sum(3 * s) over (o rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (o rows between current row and unbounded following) as weights from s window o as (order by s / w, source nulls last)),
first_open as (select * from p where (total - before)::double / weights::double <= 3.0 * s / w order by k limit 1),
t as (select p.source, p.s, case when p.k >= f.k then (f.total - f.before)::double / f.weights::double * p.w::double else 3.0 * p.s end::double as target
  from p left join first_open f on true),
v as (select *, floor(case when s > 0 then least(target / s, 3) else 0 end) as whole from t),
z as (select v.source, target - whole * s as part, w, sum(x.words)::bigint as words
  from (select source, floor(sqrt(size::double))::bigint as w, sum(size) as words from d where size > 0 group by all) x join v on x.source is not distinct from v.source
  where target - whole * s > 0 group by all),
l as (select source, w, (part - coalesce(sum(words) over (a rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(w * words) over (a rows between current row and unbounded following))::double as scale from z window a as (partition by source order by w desc)),
first_fit as (select source, arg_max(scale, w) as scale from l where w::double * scale < 1 group by source),
q as (select d.doc_id, d.source, d.size, v.s, v.target, v.whole, v.target - v.whole * v.s as part, d.u as x,
    coalesce(floor(sqrt(d.size::double)) * f.scale, 1.0) as p from d join v on d.source is not distinct from v.source left join first_fit f on d.source is not distinct from f.source),
r as (select *, case when p >= 1 then 0 when size = 0 then 9007199254740993 else floor((x * (1.0::double - p)) / (x * (1.0::double - p) + (1.0::double - x) * p) * 9007199254740992.0::double)::bigint end as key from q),
c as (select *, sum(size) over (partition by source order by key, doc_id) as upto from r)
select doc_id, size::bigint as size, s as source_size, target,
  (size * (whole + case when part <= 0 then 0 when upto <= part then 1 when upto - size <= part and upto - part < part - (upto - size) then 1 else 0 end))::bigint as taken from c
"""
