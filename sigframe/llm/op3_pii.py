"""Personal data and the terms that give it away. DataFrame functions only.

Base spans (e-mail, IP, card and phone numbers) are found by pattern and check. Protected entities e are each distinct
value, and what values that never recur have in common: the normalised value, an e-mail's domain, the first numbers of
an IP, the first digits of a card or phone, and the kind itself. A term t (a word of three letters or more, outside base
spans) discloses e as far as t carries e's information: PMI(t, e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)),
from counts of distinct texts over the whole corpus: 1 where t stands in no text without e, 0 where it is independent of
e. From `GENERALISE` on the term is generalised, from `REMOVE` on it is removed, wherever it stands in a text that has e;
texts without e keep it. A term needs `SUPPORT` distinct texts with e, so words that only chance has put beside e stay.

Null texts are empty; empty texts have no spans. Texts that repeat count once in the statistics; each row gets its
result. An empty table gives no row; other columns are kept by sanitise() and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.common import cut, keyed, read, whole_rows
from sigframe.llm.components import spread_join

#: Kinds in their order, patterns, and what a text must hold for the pattern to be tried. Possessive
#: where nothing can be given back: Java would else recurse for each repetition of a group.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}(?![\p{L}\p{N}])"
SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.9
#: Positions are summed in two levels, so that their cost stays near linear in the number of matches.
STEP = 256


def located(df: DataFrame, text: str, pattern: str, out: str, needs: str | None = None) -> DataFrame:
    """df with the matches of a pattern in a column, leftmost first: out, an array of (s, e, v) in code points."""
    src = F.when(F.col(text).rlike(needs), F.col(text)) if needs else F.col(text)
    df = df.withColumn("_x", src)
    df = df.withColumns({"_p": F.split("_x", pattern, -1), "_m": F.regexp_extract_all("_x", F.lit(pattern), F.lit(0))})
    df = df.withColumn("_l", F.expr("transform(_p, (p, i) -> char_length(p) + case when i > 0 then char_length(_m[i - 1]) else 0 end)"))
    df = df.withColumn("_b", F.expr(f"transform(sequence(0, size(_l) div {STEP}), b -> aggregate(slice(_l, b * {STEP} + 1, {STEP}), 0, (a, x) -> a + x))"))
    df = df.withColumn("_c", F.expr("transform(_b, (x, b) -> aggregate(slice(_b, 1, b), 0, (a, y) -> a + y))"))
    start = f"(_c[i div {STEP}] + aggregate(slice(_l, (i div {STEP}) * {STEP} + 1, i % {STEP} + 1), 0, (a, x) -> a + x))"
    made = f"transform(transform(_m, (v, i) -> struct({start} as s, v)), x -> struct(x.s as s, x.s + char_length(x.v) as e, x.v as v))"
    return df.withColumn(out, F.coalesce(F.expr(made), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))).drop("_x", "_p", "_m", "_l", "_b", "_c")


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    f"case when char_length({_DIGITS}) between 12 and 19 then aggregate(split(reverse({_DIGITS}), ''), struct(0 as n, 0 as i), (a, d) -> "
    "case when d = '' then a else struct(a.n + case when a.i % 2 = 0 then cast(d as int) else 2 * cast(d as int) - case when d > '4' then 9 else 0 end end as n, a.i + 1 as i) end, "
    "a -> a.n % 10 = 0) else false end"
)
CHECKS = {"email": "true", "ip": f"x.v rlike '^{BYTE}([.]{BYTE})" + "{3}$'", "card": _LUHN, "phone": f"char_length({_DIGITS}) between 9 and 15"}


#: What stands for an entity beside the kind and the exact value.
_ENTITIES = (
    "transform(array_distinct(flatten(transform(base, x -> concat(array(struct(x.o as o, 'kind' as c, '' as v), struct(x.o as o, 'value' as c, x.v as v)), case "
    "when x.o = 0 then array(struct(x.o as o, 'same' as c, lower(x.v) as v), struct(x.o as o, 'part' as c, lower(substring_index(x.v, '@', -1)) as v)) "
    "when x.o = 1 then array(struct(x.o as o, 'part' as c, substring_index(x.v, '.', 2) as v), struct(x.o as o, 'part' as c, substring_index(x.v, '.', 3) as v)) "
    f"when x.o = 2 then array(struct(x.o as o, 'same' as c, {_DIGITS} as v), struct(x.o as o, 'part' as c, left({_DIGITS}, 6) as v)) "
    f"else array(struct(x.o as o, 'same' as c, {_DIGITS} as v), struct(x.o as o, 'part' as c, left({_DIGITS}, char_length({_DIGITS}) - 7) as v)) end)))), x -> xxhash64(x.o, x.c, x.v))"
)
_TERMS = "array_distinct(transform(regexp_extract_all(rest, '" + TERM.replace("\\", "\\\\") + "', 0), w -> xxhash64(lower(w))))"


def based(docs: DataFrame) -> DataFrame:
    """doc_id, k, th, base: an array of (s, o, e, v), o the kind's place in KINDS, and rest: the text, zeros where base
    spans stand, which neither are terms nor let terms begin or end beside them."""
    df = keyed(docs)
    for i, kind in enumerate(KINDS):
        df = located(df, "text", PATTERNS[kind], kind, NEEDS[kind])
        df = df.withColumn(kind, F.expr(f"transform(filter({kind}, x -> {CHECKS[kind]}), x -> struct(x.s as s, {i} as o, x.e as e, x.v as v))"))
    df = df.withColumn("rest", F.col("text"))
    for kind in KINDS:
        pieces = f"transform({kind}, (x, i) -> concat(substring(rest, case when i = 0 then 1 else {kind}[i - 1].e + 1 end, x.s - case when i = 0 then 0 else {kind}[i - 1].e end), repeat('0', x.e - x.s)))"
        df = df.withColumn("rest", F.expr(f"case when size({kind}) = 0 then rest else concat(array_join({pieces}, ''), substring(rest, element_at({kind}, -1).e + 1)) end"))
    return df.select("doc_id", "k", "th", F.sort_array(F.concat(*KINDS)).alias("base"), "rest")


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """th, terms (an array of (s, e, r), r the disclosure, at least generalise) of texts with an entity that they
    disclose. found: as from based(), rest needed only where base spans are."""
    texts = found.select("th").distinct()
    n = texts.count()
    with_base = found.filter("size(base) > 0").select("th", "base", "rest").dropDuplicates(["th"])
    entity = with_base.select("th", F.explode(F.expr(_ENTITIES)).alias("entity"))
    # An entity in fewer texts than the support, or in all texts, has no term.
    entities = entity.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") < n))
    entity = cut(entity.join(entities, "entity"))
    words = with_base.join(entity.select("th").distinct(), "th", "left_semi").select("th", F.explode(F.expr(_TERMS)).alias("term"))
    every = based(docs).select("th", "rest").dropDuplicates(["th"]).select(F.explode(F.expr(_TERMS)).alias("term"))
    frequency = every.groupBy("term").agg(F.count("*").alias("n_t"))
    # r >= generalise asks for n(t) <= n(t,e) (N / n(e)) ** (1 - generalise), which is largest where t's every text
    # with any entity has e, and e no other text: other terms need no pairs.
    most = F.pow(F.col("n_p").cast("double"), F.lit(generalise)) * F.pow(F.lit(float(n)), F.lit(1 - generalise)) * 1.000001
    able = words.groupBy("term").agg(F.count("*").alias("n_p")).filter(F.col("n_p") >= support).join(frequency, "term").filter(F.col("n_t") <= most)
    words = cut(words.join(able.select("term", "n_t"), "term"))
    pairs = words.join(entity, "th").groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    r = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    scored = cut(pairs.select("entity", "term", r.alias("r")).filter(F.col("r") >= generalise))
    flagged = words.select("th", "term").join(entity.select("th", "entity"), "th").join(scored, ["entity", "term"]).groupBy("th", "term").agg(F.max("r").alias("r"))
    flagged = flagged.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("term", "r"))).alias("flags"))
    at = located(with_base.select("th", "rest").join(flagged, "th"), "rest", TERM, "at")
    terms = F.expr("filter(transform(at, x -> struct(x.s as s, x.e as e, try_element_at(flags, xxhash64(lower(x.v))) as r)), x -> x.r is not null)")
    return at.select("th", terms.alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, k, th, base and terms (an array of (s, e, r)) of each row of docs."""
    found = cut(based(docs).withColumn("rest", F.expr("case when size(base) > 0 then rest end")))
    joined = spread_join(found.drop("rest"), disclosing(docs, found), ["th"], ["k"], "left")
    return joined.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<s:int,e:int,r:double>>)")))


def _told(name: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "term")) + ")"
    return F.expr(f"array_join(transform({name}, x -> concat({kinds}[x.o], ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each row."""
    df = spans(docs).withColumn("_base", F.expr("transform(base, x -> struct(x.s as s, x.o as o, x.e as e))"))
    df = df.withColumn("_every", F.expr(f"sort_array(concat(_base, transform(terms, x -> struct(x.s as s, {len(KINDS)} as o, x.e as e))))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.o = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_told("_base"), 256).alias("base_sha256"), _told("_every").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by [EMAIL], [IP], [CARD], [PHONE], disclosing terms by [TERM] or nothing, and
    n_chars, where there is such a column, set to the new length. Overlapping spans become one, named by the first."""
    names = "array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]')"
    every = (
        f"sort_array(concat(transform(base, x -> struct(x.s as s, x.e as e, {names}[x.o] as n)), "
        f"transform(terms, x -> struct(x.s as s, x.e as e, case when x.r >= {REMOVE} then '' else '[TERM]' end as n))))"
    )
    merged = (
        "aggregate(_every, cast(array() as array<struct<s:int,e:int,n:string>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).e > x.s "
        "then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e, element_at(a, -1).n as n))) else concat(a, array(x)) end)"
    )
    found = spans(docs).filter("size(base) > 0").dropDuplicates(["k", "th"]).withColumn("_every", F.expr(every))
    found = found.select("k", "th", F.expr(merged).alias("spans"))
    joined = whole_rows(docs).join(found, ["k", "th"], "left")
    text = F.expr(
        "concat(array_join(transform(spans, (x, i) -> concat(substring(row.text, case when i = 0 then 1 else spans[i - 1].e + 1 end, x.s - case when i = 0 then 0 else spans[i - 1].e end), x.n)), ''), "
        "substring(row.text, element_at(spans, -1).e + 1))"
    )
    joined = joined.select("row", "spans", F.when(F.col("spans").isNotNull(), text).alias("clean"))
    row = F.col("row").withField("text", F.coalesce("clean", F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.char_length("clean").cast(dict(docs.dtypes)["n_chars"])))
    return joined.select(row.alias("row")).select("row.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}


def _sql() -> str:
    """The same query in DuckDB's SQL, whose patterns need no possessive forms."""
    plain = {k: p.replace("++", "+") for k, p in PATTERNS.items()}
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 0 then {digits}[i]::int else 2 * {digits}[i]::int - case when {digits}[i] > '4' then 9 else 0 end end)) % 10 = 0"
    checks = {"email": "true", "ip": f"regexp_full_match(v, '{BYTE}([.]{BYTE})" + "{3}')", "card": f"length({digits}) between 12 and 19 and {luhn}", "phone": f"length({digits}) between 9 and 15"}

    def found(source: str, column: str, pattern: str) -> str:
        """tid, s, e, v of a pattern's matches."""
        return f"""select tid, s, s + length(v) e, v from (select tid, m[i] v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) s
  from (select tid, m, p, unnest(range(1, len(m) + 1)) i from (select tid, regexp_extract_all({column}, '{pattern}') m, regexp_split_to_array({column}, '{pattern}') p from {source})))"""

    kinds = " union all ".join(f"select tid, s, {i} o, e, v from ({found('u', 't', plain[k])}) where {checks[k]}" for i, k in enumerate(KINDS))
    name = "case o " + " ".join(f"when {i} then '{k}'" for i, k in enumerate((*KINDS, "term"))) + " end"
    told = f"string_agg({name} || ':' || s || ':' || e, ',' order by s, o, e)"
    entities = (
        "o || ':kind' as key from b", "o || ':value:' || v as key from b", "o || ':same:' || lower(v) as key from b where o = 0", "o || ':part:' || lower(regexp_extract(v, '[^@]*$')) as key from b where o = 0",
        "o || ':part:' || array_to_string(string_split(v, '.')[1:2], '.') as key from b where o = 1", "o || ':part:' || array_to_string(string_split(v, '.')[1:3], '.') as key from b where o = 1",
        f"o || ':same:' || {digits} as key from b where o > 1", f"o || ':part:' || {digits}[1:case o when 2 then 6 else length({digits}) - 7 end] as key from b where o > 1",
    )
    run = r"[\p{L}\p{N}]+"
    return f"""
with u as (select t, row_number() over () tid from (select distinct coalesce(text, '') t from documents)),
b as materialized ({kinds}),
g as (select tid, list({{'s': s, 'e': e}}) sp from b group by tid),
w as (select u.tid, case when sp is null then t else array_to_string(list_transform(string_split(t, ''), lambda c, i: case when len(list_filter(sp, lambda x: x.s < i and i <= x.e)) > 0 then '0' else c end), '') end rest from u left join g on u.tid = g.tid),
n as (select count(*)::double n from u),
e as ({" union ".join(f"select tid, {x}" for x in entities)}),
ne as (select key, count(*) n_e from e group by key having count(*) >= {SUPPORT} and count(*) < (select n from n)),
t as (select distinct tid, lower(x) term from (select tid, unnest(regexp_extract_all(rest, '{run}')) x from w) where regexp_full_match(x, '\\p{{L}}{{3,}}')),
nt as (select term, count(*) n_t from t group by term),
p as (select key, term, count(*) n_te from e join t using (tid) join ne using (key) group by 1, 2 having count(*) >= {SUPPORT}),
r as (select key, term from p join ne using (key) join nt using (term), n where ln(n * n_te / (n_t * n_e)) / ln(n / n_e) >= {GENERALISE}),
fl as (select distinct tid, term from r join e using (key) join t using (tid, term)),
h as (select w.* from w where tid in (select tid from fl)),
m as (select q.tid, q.s, 4 o, q.e from ({found('h', 'rest', run)}) q join fl on fl.tid = q.tid and fl.term = lower(q.v)),
c as (select tid, {", ".join(f"count(*) filter (o = {i}) n_{k}" for i, k in enumerate(KINDS))}, {told} told from b group by tid),
a as (select tid, {told} told, count(*) filter (o = 4) n_term from (select tid, s, o, e from b union all select tid, s, o, e from m) group by tid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in KINDS)}, sha256(coalesce(c.told, '')) as base_sha256, coalesce(a.told, '') as spans, coalesce(n_term, 0)::bigint as n_term
from documents d join u on coalesce(d.text, '') = u.t left join c on c.tid = u.tid left join a on a.tid = u.tid
"""


ORACLES = {"op3_pii": _sql()}
