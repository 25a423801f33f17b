"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

The mix holds as many words as the input. Sources, ordered by code point with null last, have the weights 5, 2, 1,
repeating; a source's target is its weighted share, at most `most` times its words, the excess going to the others by
weight. The mix is a house of words/block seats, a seat being a block of near `block` words. Seats go to the sources by
the highest quotients target/(2j-1); a source's seats go to groups of its shards, and a group's to its shards, by the
highest quotients of their words. Shards are dealt by a hash of ids and texts, and cut into blocks in a seeded order. A
shard with more seats than blocks takes all of its blocks that often, at most `most` times, and the rest by seeded,
evenly spread positions.

Only quotients near the common divisor are looked at: with n parties a party's seats differ from its exact share by
less than 1 + n/2 times that share, so all other quotients are sure to be in or out.

Null or empty texts have size 0 and nothing is taken of them; repeated rows are documents of their own; very long texts
are one document with many blocks; an empty table gives no row. Other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigframe.llm.common import WORD, cut, read, text_of, whole_rows

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD_WORDS = 250_000
#: Shards of a group.
GROUP = 1024
SEED = "mix-1"


def _seeded(seed: str, what: str) -> Column:
    """A hash of a document's id and text as hex, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col("_id")))


#: Whether a block is one of its shard's extra ones.
_CHOSEN = "(({0} + 1 + s) * extra) div blocks > (({0} + s) * extra) div blocks"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """src, sid (its place in the order), source_size, target for each source of sizes(src, size): water-filling in
    closed form."""
    by = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").isNull(), "src")
    ranked = by.withColumn("_n", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "_n")
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "_n", F.col("_level").alias("level")))).over(every)
    ranked = ranked.withColumn("_level", first["level"])
    return ranked.select("src", F.col("_n").alias("sid"), "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce("_level", F.lit(0.0))).alias("target"))


def apportioned(parties: DataFrame, group: Sequence[str], votes: str, house: str, cap: str, order: Sequence[str]) -> DataFrame:
    """parties with their seats: in each group the `house` seats go to the highest quotients votes/(2j-1), j up to cap;
    ties go by the columns of order, of which a party has values of its own in its group."""
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    d = parties.withColumn("_all", F.sum(F.col(votes).cast("double")).over(every)).withColumn("_n", F.count("*").over(every))
    d = d.withColumn("_q", F.when(F.col("_all") > 0, F.col(votes).cast("double") * F.col(house) / F.col("_all")).otherwise(0.0))
    d = d.withColumn("_k", F.when(F.col("_all") > 0, F.ceil(F.col("_n") / 2.0 * F.col(votes) / F.col("_all"))).otherwise(0) + 2)
    d = d.withColumn("_low", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(F.col("_q") + 0.5) - F.col("_k"))).cast("long"))
    d = d.withColumn("_rest", F.col(house) - F.sum("_low").over(every))
    d = d.withColumn("_over", F.ceil(F.sum(F.greatest(F.lit(0.0), F.col("_q") - F.col(cap))).over(every)))
    d = d.withColumn("_top", F.least(F.col(cap), F.col("_low") + 2 * F.col("_k") + 2 + F.col("_over")).cast("long"))
    asked = F.when((F.col("_top") > F.col("_low")) & (F.col(votes) > 0), F.sequence(F.col("_low") + 1, F.col("_top")))
    d = d.withColumn("_j", F.explode_outer(asked))
    best = every.orderBy(F.desc_nulls_last(F.col(votes).cast("double") / (2 * F.col("_j") - 1)), *order, "_j")
    d = d.withColumn("_won", (F.col("_j").isNotNull() & (F.row_number().over(best) <= F.col("_rest"))).cast("long"))
    return d.groupBy(*parties.columns, "_low").agg(F.sum("_won").alias("_won")).withColumn("seats", F.col("_low") + F.col("_won")).drop("_low", "_won")


def planned(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Each row's place in the mix: doc_id, src, size, source_size, target; its shard with w words in `blocks` blocks
    and a quota of them: whole passes and `extra` blocks, chosen from s on; its words [c0, c1) in the shard's order."""
    if block < 1 or shard_words < block or most < 1 or not weights or min(weights) <= 0:
        raise ValueError("block, shard_words, most and weights must be positive, and a shard no less than a block")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of()))
    sized = cut(docs.select("doc_id", F.col("source").alias("src"), size.alias("size"), own.alias("_id"), *keep))
    goal = targets(sized, weights, most)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / float(shard_words)))
    placed = sized.join(goal, sized["src"].eqNullSafe(goal["src"])).drop(goal["src"])
    placed = placed.withColumn("shard", F.conv(F.substring(_seeded(seed, "shard"), 1, 8), 16, 10).cast("long") % shards)
    # Seats: to sources, to groups of shards, to shards.
    seats = Window.partitionBy(F.lit(0))
    house = goal.withColumn("house", F.floor(F.sum("source_size").over(seats) / float(block) + 0.5)).withColumn("cap", F.lit(1 << 60))
    house = apportioned(house.select("sid", "target", "house", "cap"), [], "target", "house", "cap", ["sid"]).select(F.col("sid").alias("_sid"), F.col("seats").alias("source_seats"))
    shard = placed.groupBy("sid", "shard").agg(F.sum("size").alias("w")).withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("w") / float(block) + 0.5)).cast("long"))
    shard = shard.withColumn("cap", F.col("blocks") * most).withColumn("part", F.expr(f"shard div {GROUP}"))
    parts = shard.groupBy("sid", "part").agg(F.sum("w").alias("votes"), F.sum("cap").alias("cap"))
    parts = parts.join(house, parts["sid"] == house["_sid"]).drop("_sid")
    parts = apportioned(parts, ["sid"], "votes", "source_seats", "cap", ["part"]).select("sid", "part", F.col("seats").alias("part_seats"))
    shard = apportioned(shard.join(parts, ["sid", "part"]), ["sid", "part"], "w", "part_seats", "cap", ["shard"]).select("sid", "shard", "w", "blocks", F.col("seats").alias("quota"))
    placed = placed.withColumn("_r", _seeded(seed, "order")).join(shard, ["sid", "shard"])
    order = Window.partitionBy("sid", "shard").orderBy("_r", F.col("doc_id").isNull(), "doc_id", "size")
    placed = placed.withColumn("c1", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c0", F.col("c1") - F.col("size"))
    placed = placed.withColumn("passes", F.expr("quota div blocks")).withColumn("extra", F.col("quota") % F.col("blocks"))
    # Block j is [j*w div blocks, (j+1)*w div blocks). The extra ones are those where floor((j+s)*extra/blocks) steps,
    # j+s taken around the shard: a seeded, evenly spread choice of exactly `extra` blocks.
    placed = placed.withColumn("s", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:start:"), F.coalesce("src", F.lit("null")), F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("blocks"))

    return placed


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, src, size, source_size, target, shard, quota (blocks of its shard), taken for each row of docs."""
    placed = planned(docs, **settings)
    placed = placed.withColumn("b0", F.expr("((c0 + 1) * blocks - 1) div w")).withColumn("b1", F.expr("(c1 * blocks - 1) div w"))
    chosen = f"filter(sequence(b0, b1), j -> {_CHOSEN.format('j')})"
    part = f"aggregate({chosen}, 0L, (a, j) -> a + least(c1, ((j + 1) * w) div blocks) - greatest(c0, (j * w) div blocks))"
    taken = F.when((F.col("size") > 0) & (F.col("w") > 0), F.col("passes") * F.col("size") + F.when(F.col("extra") > 0, F.expr(part)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "src", "size", "source_size", "target", "shard", "quota", taken.alias("taken"))


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole and, where some of its
    blocks are taken once more, a row with the words in these (n_chars, where there is such a column, to match)."""
    rows = whole_rows(docs).select("row", "k", F.xxhash64("th", "row.source").alias("th"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    again = Window.partitionBy("k", "th").orderBy("k")  # rows that agree in all of these
    plan = planned(rows, keep=("k", "th"), **settings).filter("size > 0 and quota > 0")
    plan = plan.withColumn("n", F.row_number().over(again)).select("k", "th", "n", "passes", "extra", "blocks", "s", "w", "c0")
    joined = rows.select("row", "k", "th", "text").withColumn("n", F.row_number().over(again)).join(plan, ["k", "th", "n"])
    words = r"split(regexp_replace(text, '^[\\x20\\x09-\\x0D]+', ''), '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])')"
    chosen = _CHOSEN.format("(((c0 + i + 1) * blocks - 1) div w)")
    part = F.when(F.col("extra") > 0, F.expr(f"array_join(filter({words}, (x, i) -> {chosen}), '')"))
    joined = joined.select("row", "passes", part.alias("part"))  # once, not in each place that uses it
    some = F.when(F.length("part") > 0, F.array("part")).otherwise(F.expr("cast(array() as array<string>)"))
    out = joined.select("row", F.explode(F.concat(F.expr("array_repeat(cast(null as string), cast(passes as int))"), some)).alias("part"))
    row = F.col("row").withField("text", F.coalesce("part", F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("part").isNull(), F.col("row.n_chars")).otherwise(F.char_length("part").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(row.alias("row")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}


def _seats(name: str, parties: str, group: str, key: str, votes: str, house: str, cap: str) -> str:
    """apportioned() in SQL: tables name_1 to name_5 and name, which has the parties' columns and seats."""
    by, keys = (f"partition by {group} " if group else ""), ", ".join(x for x in (group, key) if x)
    return f"""{name}_1 as (select *, sum({votes}::double) over ({by}) al, count(*) over ({by}) n from {parties}),
{name}_2 as (select *, case when al > 0 then {votes}::double * {house} / al else 0 end q, case when al > 0 then ceil(n / 2.0::double * {votes} / al) else 0 end + 2 k from {name}_1),
{name}_3 as (select *, least({cap}, greatest(0, floor(q + 0.5) - k))::bigint low from {name}_2),
{name}_4 as (select *, {house} - sum(low) over ({by}) rest, least({cap}, low + 2 * k + 2 + ceil(sum(greatest(0, q - {cap})) over ({by})))::bigint top from {name}_3),
{name}_5 as (select {keys}, rest, row_number() over ({by}order by {votes}::double / (2 * j - 1) desc, {key}, j) place from (select *, unnest(range(low + 1, top + 1)) j from {name}_4 where {votes} > 0)),
{name} as (select p.* exclude (al, n, q, k, low, rest, top), p.low + coalesce(t.won, 0) seats from {name}_4 p left join (select {keys}, count(*) won from {name}_5 where place <= rest group by {keys}) t using ({keys}))"""


ORACLES = {
    "op6_mixing": f"""
with d as (select doc_id, source src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) id from documents),
g as (select src, sum(size)::bigint source_size, (row_number() over (order by src is null, src) - 1) sid from d group by src),
r as (select *, case sid % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end w, source_size * {float(MOST)}::double cap from g),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, sid rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(w) over () - coalesce(sum(w) over (order by cap / w, sid rows between unbounded preceding and 1 preceding), 0))::double lv from r),
f as (select lv from l where lv * w <= cap order by cap / w, sid limit 1),
t as (select src, sid, source_size, least(cap, w * coalesce((select lv from f), 0)) target, greatest(1, ceil(source_size / {float(SHARD_WORDS)}))::bigint shards from l),
p as (select d.*, sid, source_size, target, ('0x' || substr(md5('{SEED}:shard:' || id), 1, 8))::bigint % shards shard, md5('{SEED}:order:' || id) r from d join t on d.src is not distinct from t.src),
h as (select sid, target, floor(sum(source_size) over () / {float(BLOCK)} + 0.5)::bigint house, 1152921504606846976 cap from t),
{_seats("hs", "h", "", "sid", "target", "house", "cap")},
sh as (select sid, shard, shard // {GROUP} part, sum(size)::bigint w, greatest(1, floor(sum(size) / {float(BLOCK)} + 0.5))::bigint blocks, {MOST} * greatest(1, floor(sum(size) / {float(BLOCK)} + 0.5))::bigint cap from p group by 1, 2),
pa as (select sh.sid, part, sum(w)::bigint votes, sum(sh.cap)::bigint cap, any_value(hs.seats)::bigint source_seats from sh join hs on sh.sid = hs.sid group by 1, 2),
{_seats("ps", "pa", "sid", "part", "votes", "source_seats", "cap")},
sp as (select sh.*, ps.seats::bigint part_seats from sh join ps on sh.sid = ps.sid and sh.part = ps.part),
{_seats("ss", "sp", "sid, part", "shard", "w", "part_seats", "cap")},
q as (select p.*, sum(size) over (partition by p.sid, p.shard order by r, doc_id is null, doc_id, size rows unbounded preceding)::bigint c1, ss.w, blocks, seats::bigint quota
  from p join ss on p.sid = ss.sid and p.shard = ss.shard),
u as (select *, c1 - size c0, ('0x' || substr(md5('{SEED}:start:' || coalesce(src, 'null') || ':' || shard), 1, 8))::bigint % blocks s from q),
x as (select *, quota // blocks passes, quota % blocks extra from u)
select doc_id, size, source_size, target, case when size > 0 and w > 0 then passes * size + case when extra > 0 then
  coalesce((select sum(least(c1, (j + 1) * w // blocks) - greatest(c0, j * w // blocks)) from unnest(range(((c0 + 1) * blocks - 1) // w, (c1 * blocks - 1) // w + 1)) z(j)
    where (j + 1 + s) * extra // blocks > (j + s) * extra // blocks), 0) else 0 end else 0 end::bigint taken from x
"""
}
