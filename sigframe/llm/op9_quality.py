"""Quality rules and divergence from a language's reference histograms. DataFrame functions only.

Each document gets two histograms: of character classes, and of its language's commonest words. A language's reference
is the sum over all of its documents. A document fails when its Jensen-Shannon distance (base 2, 0 to 1) from the
reference, or the sum of both distances, exceeds a threshold; a histogram with fewer than `least` counts, or a language with fewer than
`least_reference` words in its reference, is not judged. Base rules (too few words, too many repeated words) come first.

Null or empty texts have no words and fail; null or unknown languages form references of their own, with the words of
all lists; repeated rows each get a row and each count; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm.common import WS, cut, read, text_of

#: Some of the commonest words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"),
}
ANY = ("the", "of", "and", "der", "die", "und", "de", "la", "le", "el", "en", "que")
#: Character classes, each a pattern of one character; spaces and what is left (mostly small letters) come after them.
CLASSES = {"upper": "[A-Z]", "point": "[.,;:!?'\"()\\-]", "symbol": "[#*$%&|<>]"}
CHARS = len(CLASSES) + 2
WINDOW = 8
MIN_WORDS = 20
LEAST = 40
LEAST_REFERENCE = 200
#: Thresholds, set where few labelled good documents lie beyond them: of either distance, and of their sum.
MOST_CHARS = 0.19
MOST_WORDS = 0.35
MOST_BOTH = 0.43


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the histograms chars and common (the last count is of other words)."""
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("t"))
    d = d.select("*", F.array_remove(F.split("t", WS), "").alias("words"), F.coalesce(F.element_at(lists, F.coalesce("lang", F.lit(""))), F.array(*map(F.lit, ANY))).alias("list"))
    d = d.select("*", F.size("words").cast("long").alias("n_words"), F.expr("filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
                 F.expr(f"case when size(words) > {WINDOW} then transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) else array() end").cast("array<bigint>").alias("wins"),
                 F.char_length("t").alias("n_chars"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 *[F.regexp_count("t", F.lit(p)).alias(f"n_{k}") for k, p in CLASSES.items()],
                 F.expr("filter(transform(words, w -> lower(w)), w -> array_contains(list, w))").alias("hits"))
    d = d.withColumn("sorted", F.expr("case when size(array_distinct(wins)) < size(wins) then sort_array(transform(wins, (h, i) -> struct(h, i))) end"))
    d = d.withColumn("again", F.expr("sort_array(transform(filter(sorted, (s, i) -> coalesce(s.h = get(sorted, i - 1).h, false) or coalesce(s.h = get(sorted, i + 1).h, false)), s -> s.i))"))
    repeats = F.expr(f"coalesce(aggregate(transform(again, (p, i) -> least({WINDOW}, coalesce(get(again, i + 1) - p, {WINDOW}))), 0, (a, x) -> a + x), 0)")
    return d.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("n_symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"n_{k}").cast("double") for k in CLASSES], (F.col("n_chars") - F.col("word_chars")).cast("double"),
                (F.col("word_chars") - sum((F.col(f"n_{k}") for k in CLASSES), F.lit(0))).cast("double")).alias("chars"),
        F.expr("concat(transform(list, c -> cast(size(filter(hits, w -> w = c)) as double)), array(cast(n_words - size(hits) as double)))").alias("common"),
    )


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two histograms; null where one is empty."""
    total = "aggregate({0}, 0D, (a, x) -> a + x)"
    term = "case when {0} > 0 then {0} * log2(2 * {0} / (x.p + x.q)) else 0D end"
    return F.expr(
        f"case when {total.format(p)} > 0 and {total.format(q)} > 0 then sqrt(greatest(0D, aggregate(zip_with("
        f"transform({p}, v -> v / {total.format(p)}), transform({q}, v -> v / {total.format(q)}), (p, q) -> struct(p, q)), 0D, "
        f"(a, x) -> a + 0.5D * ({term.format('x.p')} + {term.format('x.q')})))) end"
    )


def judge(docs: DataFrame, least: int = LEAST, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS, most_both: float = MOST_BOTH, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """The features of each row of docs with js_chars, js_words, base_failed and kept."""
    f = cut(features(docs))
    wide = len(ANY) + 1
    sums = f.groupBy("lang").agg(*[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(CHARS)], *[F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(wide)])
    reference = sums.select(F.col("lang").alias("l"), F.array(*[f"c{i}" for i in range(CHARS)]).alias("rc"), F.array(*[f"w{i}" for i in range(wide)]).alias("rw"))
    j = f.join(reference, f["lang"].eqNullSafe(reference["l"]), "left").withColumn("js_chars", distance("chars", "rc")).withColumn("js_words", distance("common", "rw"))
    bad = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = (F.col("n_words") >= least) & (F.expr("aggregate(rw, 0D, (a, x) -> a + x)") >= least_reference)
    far = F.coalesce(judged & ((F.col("js_chars") > most_chars) | (F.col("js_words") > most_words) | (F.col("js_chars") + F.col("js_words") > most_both)), F.lit(False))
    return j.select(*f.columns, "js_chars", "js_words", bad.alias("base_failed"), (~bad & ~far).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("lang", "chars", "common", "js_chars", "js_words")


QUERIES = {"op9_quality": op9_quality}


def _sql() -> str:
    """The same query in DuckDB's SQL."""
    quoted = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
    lists = " ".join(f"when '{k}' then {quoted(v)}" for k, v in COMMON.items())
    found = lambda p: "len(regexp_extract_all(t, '" + p.replace("'", "''") + "'))"
    classes = ", ".join(f"{found(p)} as a{i}" for i, p in enumerate(CLASSES.values()))
    n, m = len(CLASSES), len(ANY)
    chars = [*(f"a{i}" for i in range(n)), "length(t) - wc", "wc - (" + " + ".join(f"a{i}" for i in range(n)) + ")"]
    common = [*(f"len(list_filter(lw, lambda x: x = l[{i + 1}]))" for i in range(m)), f"len(w) - len(list_filter(lw, lambda x: list_contains(l, x)))"]
    columns = ", ".join(f"({x})::double as c{i}" for i, x in enumerate(chars)) + ", " + ", ".join(f"({x})::double as w{i}" for i, x in enumerate(common))

    def js(letter: str, k: int) -> str:
        p = [f"(f.{letter}{i} / (" + " + ".join(f"f.{letter}{j}" for j in range(k)) + "))" for i in range(k)]
        q = [f"(r.{letter}{i} / (" + " + ".join(f"r.{letter}{j}" for j in range(k)) + "))" for i in range(k)]
        term = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
        return "sqrt(greatest(0, " + " + ".join(f"0.5 * ({term(a, b)} + {term(b, a)})" for a, b in zip(p, q)) + "))"

    sums = ", ".join(f"sum({c}) as {c}" for c in [*(f"c{i}" for i in range(CHARS)), *(f"w{i}" for i in range(m + 1))])
    total = " + ".join(f"r.w{i}" for i in range(m + 1))
    return f"""
with d as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
  case lang {lists} else {quoted(ANY)} end l, row_number() over () id from documents),
e as (select *, list_transform(w, lambda x: lower(x)) lw, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint wc, {classes},
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
p as (select id, w, unnest(range(1, len(w) - {WINDOW - 2})) i from d where len(w) >= {WINDOW}),
h as (select id, i, count(*) over (partition by id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) n from p),
g as (select id, count(*) n from (select distinct id, unnest(range(i, i + {WINDOW})) i from h where n > 1) group by id),
f as (select e.id, doc_id, lang, len(w)::bigint n_words, wc word_chars, a{n - 1}::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(g.n, 0)::bigint n_repeat_words, {columns}
  from e left join g on e.id = g.id),
r as (select lang, {sums} from f group by lang),
j as (select f.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > 30 * n_words base_failed, n_words >= {LEAST} and {total} >= {LEAST_REFERENCE} judged,
  case when n_words >= {LEAST} then {js('c', CHARS)} end js_chars, case when n_words >= {LEAST} then {js('w', m + 1)} end js_words from f join r on f.lang is not distinct from r.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(judged and (js_chars > {MOST_CHARS} or js_words > {MOST_WORDS} or js_chars + js_words > {MOST_BOTH}), false) as kept from j
"""


ORACLES = {"op9_quality": _sql()}
